"""What the corpus operators share: reading, hot-key joins, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.session import written

#: A key with over 1/HOT_SHARE of the rows is hot. So at most HOT_SHARE keys are, whatever the
#: size of the input: that bounds what a hot-key join broadcasts.
HOT_SHARE = 500
#: So many edges a single task can hold; rounds over fewer need no care for hot nodes.
FEW_EDGES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``lookup`` (one row per ``key``; ``size`` says how many of ``rows``
    have it, ``total`` how many rows there are).

    Hot keys, at most HOT_SHARE of them, are broadcast, so that their rows don't meet in one
    task; all others go through an ordinary join in which no key has over total / HOT_SHARE
    rows. ``how`` is ``left`` or ``inner``. A null key finds nothing.
    """
    limit = max(32, total // HOT_SHARE)
    hot = lookup.filter(F.col(size) > limit)
    first = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    values = [c for c in lookup.columns if c != key]
    in_hot = first.filter(F.col("_hot")).drop("_hot")
    rest = first.filter(F.col("_hot").isNull()).drop("_hot", *values)
    joined = rest.join(lookup.filter(F.col(size) <= limit), key, how)
    return in_hot.unionByName(joined)


def sampled(df: DataFrame, key: Column, label: str, per_label: int, most_labels: int = 256) -> DataFrame:
    """About ``per_label`` rows of each value of ``label``, chosen by a hash of ``key``.

    Label counts come from one pre-aggregated pass; the ``most_labels`` most frequent labels
    take part. The same rows come out whatever the partitioning.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    top = counts.orderBy(F.desc("count"), label).limit(most_labels).collect()
    if not top:
        return df.limit(0)
    spark = df.sparkSession
    limits = spark.createDataFrame(
        [(r[label], int(min(1.0, per_label / r["count"]) * (1 << 30)) + 1) for r in top],
        f"{label} {dict(df.dtypes)[label]}, _below long",
    )
    chosen = F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) < F.col("_below")
    return df.join(F.broadcast(limits), label).filter(chosen).drop("_below")


def _meet(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    return rows.join(low, "u") if total <= FEW_EDGES else join_hot(rows, low, "u", "n", total, "inner")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: (node, component), where
    the component is its smallest node. Nodes without an edge aren't returned.

    Alternates large-star and small-star steps, which keeps the number of edges from growing
    and halves paths; each round is written to the shared folder. Sums of ids tell when
    nothing changes any more.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before, total = None, 2 * now.count()
    for _ in range(rounds):
        # large star: each larger neighbour of a node links to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _meet(both, low, total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: smaller neighbours and the node itself link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = _meet(large, low, total).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, 2 * state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("u")).distinct().join(found, "u", "left_anti").select("u", F.col("u").alias("component"))
    return found.unionByName(roots).withColumnRenamed("u", "node")
