"""Announcement feeds: stored response bodies of exchanges as tables of candidates.

Every parser takes bodies(code, body) and returns candidates(code, title, day, link, priority);
a body that is no such JSON gives no row, a date that can't be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloq.operators.ingest import by_priority, latest_matching, with_failures

COLUMNS = ("code", "title", "day", "link", "priority")


def plain_title(c: Column) -> Column:
    """Without the marks that a search puts around its words."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "</?em>", "")


def _exploded(bodies: DataFrame, body: Column, schema: str, field: str) -> DataFrame:
    return bodies.select("code", F.explode(F.from_json(body, schema)[field]).alias("r"))


def exchange(bodies: DataFrame) -> DataFrame:
    """{"data": [{title, publishTime: "yyyy-MM-dd ...", attachPath}]}"""
    rows = _exploded(bodies, F.col("body"), "data array<struct<title string, publishTime string, attachPath string>>", "data")
    day = F.expr("try_to_date(substring(r.publishTime, 1, 10), 'yyyy-MM-dd')")
    return rows.select("code", plain_title(F.col("r.title")).alias("title"), day.alias("day"), F.col("r.attachPath").alias("link"), F.lit(1).alias("priority"))


def platform(bodies: DataFrame) -> DataFrame:
    """{"announcements": [{announcementTitle, announcementTime: epoch ms, adjunctUrl}]}"""
    rows = _exploded(bodies, F.col("body"), "announcements array<struct<announcementTitle string, announcementTime long, adjunctUrl string>>", "announcements")
    day = F.to_date(F.timestamp_millis(F.col("r.announcementTime")))
    return rows.select("code", plain_title(F.col("r.announcementTitle")).alias("title"), day.alias("day"), F.col("r.adjunctUrl").alias("link"), F.lit(2).alias("priority"))


def nested(bodies: DataFrame) -> DataFrame:
    """{"result": "<JSON array as a string>"} of {TITLE, DATE_TIME: "dd/MM/yyyy ...", FILE_LINK}"""
    inner = F.from_json("body", "result string")["result"]
    rows = bodies.select("code", F.explode(F.from_json(inner, "array<struct<TITLE string, DATE_TIME string, FILE_LINK string>>")).alias("r"))
    day = F.expr("try_to_date(substring(r.DATE_TIME, 1, 10), 'dd/MM/yyyy')")
    return rows.select("code", plain_title(F.col("r.TITLE")).alias("title"), day.alias("day"), F.col("r.FILE_LINK").alias("link"), F.lit(1).alias("priority"))


def manifest(targets: DataFrame, candidates: DataFrame, include: str, exclude: str) -> DataFrame:
    """One row per target(code): the latest fitting announcement of the first source that has
    any, or ok = false and a note that tells how many candidates were seen."""
    first = by_priority(candidates, "code", "priority")
    picked = latest_matching(first, "code", "title", "day", include, exclude, "link").select("code", "title", "day", "link")
    return with_failures(targets, picked, ["code"], first.groupBy("code").agg(F.count("*").alias("n_seen"))).drop("n_seen")


def with_issuer_id(targets: DataFrame, issuers: DataFrame) -> DataFrame:
    """targets(code) with the platform's id of the issuer, from issuers(code, issuer_id)."""
    return targets.join(issuers.groupBy("code").agg(F.min("issuer_id").alias("issuer_id")), "code", "left")
