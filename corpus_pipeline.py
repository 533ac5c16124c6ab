"""A corpus pipeline in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm import contamination, exact, language, near, packing
from discloq.llm.common import table
from discloq.session import written

#: A language is taken from this probability on; a text below it, or without a letter, goes.
LEAST_SCORE = 0.3


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but doc_id and text under neutral names, which clash with no
    operator's own, and what they are called."""
    names = {c: f"_own{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the network knows."""
    net = language.train(*language.training_rows(docs))
    plain, names = set_aside(docs)
    found = language.predict_documents(plain, net, keep=tuple(plain.columns))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(plain.columns).withColumnsRenamed(names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: of those that have the doc_id that stays (or none,
    where none of the group has one) the longest, then the greatest text and other columns."""
    plain, names = set_aside(docs)
    kept = exact.exact_dedup(plain).filter("kept")
    row = F.struct(*(F.col(c) for c in plain.columns))
    order = F.struct(F.length("text").alias("a"), F.col("text").alias("b"), F.to_json(row).alias("c"))
    groups = kept.filter("group_size > 1").groupBy("text_sha256").agg(F.max_by(row, order).alias("row")).select("row.*")
    return kept.filter("group_size = 1").select(plain.columns).unionByName(groups).withColumnsRenamed(names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, of five-word shingles and a similarity of 0.8 or
    more: links of SimHash within its radius, then all others, each verified. It has the
    component's smallest doc_id; rows that repeat its doc_id and text stay."""
    gone = written(near.near_copies(docs), "near-copies")
    return docs.join(gone, near.row_key(docs) == gone["key"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; rows go by their doc_id and text, either of which
    may be null."""
    keyed = docs.select(near.row_key(docs).alias("doc_id"), "text")
    hits = written(contamination.find_passages(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct(), "passages")
    return docs.join(hits, near.row_key(docs) == hits["key"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: SQL can't train or apply the first stage's network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
