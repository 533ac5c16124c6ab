"""Exact dedup by two Bloom passes, in DataFrame operations only.

The first pass counts, in a Bloom filter of 256 cells a row, the cells that two rows hit. It is
kept sparse: cell numbers, pre-aggregated in each task, are all that moves, which is 8 bytes a
row before compression. (A dense filter in each of T tasks would move 32 T bytes a row.)
The second pass tests every row against a Bloom filter of those cells: rows without their bit
are certainly unique and pass straight through; only the others shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.common import HOT_SHARE, table
from discloq.session import written

#: Cells for each row in the first pass, bits for each repeated cell in the second.
CELLS_A_ROW, BITS_A_CELL = 256, 64
#: The bits of the second pass are broadcast, so they are at most 2**27, as 2**21 longs. With
#: more than that many repeated texts more unique rows shuffle too; results don't change.
MOST_BITS = 1 << 27
SPACE = r"[\x20\x09-\x0D]"
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), "UTF-8"), 256)


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("_sha"), F.lit(cells))


def repeated_cells(signed: DataFrame, cells: int) -> DataFrame:
    """(_cell): the cells hit at least twice."""
    return signed.groupBy(_cell(cells).alias("_cell")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_cell")


def _bit(cell: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(cell), F.lit(bits))


def bits_of(found: DataFrame, bits: int) -> DataFrame:
    """(_word, _set): a Bloom filter of the cells, 64 bits to a word."""
    placed = found.select(_bit(F.col("_cell"), bits).alias("_bit"))
    return placed.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias("_set"))


def possibly_repeated(rows: DataFrame, words: DataFrame, cells: int, bits: int) -> DataFrame:
    """``rows`` with _maybe: the bit of the cell of _sha is set."""
    rows = rows.withColumn("_bit", _bit(_cell(cells), bits)).withColumn("_word", F.shiftright("_bit", 6))
    rows = rows.join(F.broadcast(words), "_word", "left")
    return rows.withColumn("_maybe", F.expr("shiftright(coalesce(_set, 0L), cast(_bit & 63 as int)) & 1") == 1).drop("_bit", "_word", "_set")


def exact_dedup(docs: DataFrame, carry: bool = True) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; with ``carry``, after its own
    columns (own columns of those names are replaced), else after doc_id.

    Of equal texts the one with the most code points stays, then the smallest doc_id. A null
    doc_id loses against any other. Rows that repeat a doc_id with an equal text are one
    document: each counts in group_size and they share its decision. Own columns may have any
    other name: they are set aside while the work is done.
    """
    own = {f"_own{k}": c for k, c in enumerate(docs.drop(*OUT).columns if carry else ["doc_id"])}
    signed = written(docs.select("doc_id", digest(F.col("text")).alias("_sha"), F.length(F.coalesce("text", F.lit(""))).alias("_long")), "exact")
    total = signed.count()
    cells = 1 << (CELLS_A_ROW * max(1, total)).bit_length()
    found = written(repeated_cells(signed, cells), "exact-cells")
    bits = min(MOST_BITS, 1 << max(16, (BITS_A_CELL * found.count()).bit_length()))
    words = written(bits_of(found, bits), "exact-bits")
    maybe = possibly_repeated(signed, words, cells, bits).filter("_maybe")
    best = F.max(F.struct("_long", (-F.col("doc_id")).alias("_less")))
    groups = written(maybe.groupBy("_sha").agg(F.count("*").alias("_size"), best.alias("_best")).select("_sha", "_size", (-F.col("_best._less")).alias("_keep")), "exact-groups")
    limit = max(32, total // HOT_SHARE)
    rows = docs.select("doc_id", *(F.col(f"`{c}`").alias(k) for k, c in own.items()), digest(F.col("text")).alias("_sha")) if carry else signed.select("doc_id", F.col("doc_id").alias("_own0"), "_sha")
    rows = possibly_repeated(rows, words, cells, bits)
    # groups above the limit: at most HOT_SHARE of them
    rows = rows.join(F.broadcast(groups.filter(F.col("_size") > limit)), "_sha", "left")
    straight = rows.filter(~F.col("_maybe") | F.col("_size").isNotNull())
    others = rows.filter(F.col("_maybe") & F.col("_size").isNull()).drop("_size", "_keep")
    others = others.join(groups.filter(F.col("_size") <= limit), "_sha")
    out = straight.unionByName(others)
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return out.select(
        *(F.col(k).alias(c) for k, c in own.items()), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry=False)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
