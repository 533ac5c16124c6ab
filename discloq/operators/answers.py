"""Extractive answers: scored sentences, deduplicated, in turns where there are several groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloq.functions import text as X

SHORTEST = 6


def candidates(hits: DataFrame, query_terms: Column, numeric: Column, focus: Column, latin: bool = False) -> DataFrame:
    """hits(qid, ci, text, ...) as scored sentences (si, sentence, score, has_num).

    Hit density, bonuses for numbers and for numbers with a focus term, decay by place in the
    text and in the hits, and a malus for lines that only lead in. A hit with a true has_table
    is cut into lines, and gets a bonus if it has a focus term or there is none. ``latin`` cuts
    after .!? too."""
    cut, topic = X.sentences(F.col("text"), latin), F.lit(0.0)
    if "has_table" in hits.columns:
        cut = F.when(F.col("has_table"), F.split("text", "\n")).otherwise(cut)
        topic = F.when(F.col("has_table") & ((F.size(focus) == 0) | F.exists(focus, lambda w: F.contains("text", w))), 0.15).otherwise(0.0)
    units = hits.select("*", topic.alias("_topic"), F.posexplode(F.filter(cut, lambda s: F.trim(s) != "")).alias("si", "unit"))
    units = units.withColumn("sentence", F.trim(F.regexp_replace("unit", r"(?U)^\s+|\s+$", ""))).filter(F.length("sentence") >= SHORTEST)
    terms = F.array_distinct(X.tokens(F.col("sentence")))
    units = units.withColumn("_t", terms).filter(F.size("_t") > 0).withColumn("_o", F.size(F.array_intersect("_t", query_terms)))
    num = X.has_number(F.col("sentence"))
    on_focus = (F.size(focus) == 0) | F.exists(focus, lambda w: F.contains("sentence", w))
    units = units.filter((F.col("_o") > 0) | (numeric & num)).withColumn("has_num", num)
    lead = F.col("sentence").rlike("(：|:|如下)$")
    score = F.col("_o") / F.sqrt(F.size("_t").cast("double")) + F.when(numeric & num, 0.45).otherwise(0.0) + F.when(numeric & num & on_focus, 0.55).otherwise(0.0)
    score = score + 0.25 / (1 + F.col("si")) + 0.30 / (1 + F.col("ci")) - F.when(lead, 0.45).otherwise(0.0)
    return units.withColumn("score", F.round(score + F.col("_topic"), 9)).withColumn("is_focus", on_focus).drop("_t", "_o", "_topic", "unit")


def best(cands: DataFrame, most: int = 6) -> DataFrame:
    """The best sentences of each query, each text once."""
    keyed = cands.withColumn("key", X.dedupe_key(F.col("sentence")))
    once = Window.partitionBy("qid", "key").orderBy(F.desc("score"), "ci", "si")
    keyed = keyed.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "ci", "si")
    return keyed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def in_turns(cands: DataFrame, group: str, most: int = 6) -> DataFrame:
    """Groups in turns, the one with the best sentence first, focus sentences first in each."""
    w = Window.partitionBy("qid", group)
    cands = cands.withColumn("_turn", F.row_number().over(w.orderBy(F.desc("is_focus"), F.desc("score"), "ci", "si"))).withColumn("_top", F.max("score").over(w)).filter(F.col("_turn") <= most)
    keyed = cands.withColumn("key", X.dedupe_key(F.col("sentence")))
    order = ["_turn", F.desc("_top"), group, "ci", "si"]
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "key").orderBy(*order))).filter("_n = 1")
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("place") <= most).drop("_n", "_turn", "_top")


def renumbered(picked: DataFrame) -> DataFrame:
    """Citation numbers 1..n over the hits used."""
    return picked.withColumn("n", F.dense_rank().over(Window.partitionBy("qid").orderBy("ci")))
