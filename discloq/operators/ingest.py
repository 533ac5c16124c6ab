"""Manifest handling: choosing announcements, upserts, what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_matching(candidates: DataFrame, key: str, title: str, date: str, include: str, exclude: str, tie: str) -> DataFrame:
    """Of each key the latest row whose title has ``include`` and not ``exclude``."""
    ok = candidates.filter(F.col(title).rlike(include) & ~F.col(title).rlike(exclude))
    w = Window.partitionBy(key).orderBy(F.desc(date), F.desc(tie))
    return ok.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(manifest: DataFrame, records: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: one row per key, that with the largest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return manifest.unionByName(records).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def by_priority(sources: DataFrame, key: str, priority: str) -> DataFrame:
    """Rows of the first source that has any for the key."""
    return sources.withColumn("_p", F.min(priority).over(Window.partitionBy(key))).filter(F.col(priority) == F.col("_p")).drop("_p")


def with_failures(targets: DataFrame, picked: DataFrame, keys: list[str], seen: DataFrame) -> DataFrame:
    """Every target; those without a pick get ok = false and a note with the candidates seen."""
    out = targets.join(picked.withColumn("ok", F.lit(True)), keys, "left").join(seen, keys, "left")
    return out.withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("note", F.when(~F.col("ok"), F.concat(F.lit("no match among "), F.coalesce("n_seen", F.lit(0)).cast("string"))))


def missing(targets: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return targets.join(present, keys, "left_anti")
