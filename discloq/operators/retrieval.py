"""Lexical, vector, fused and grouped retrieval for a table of queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discloq import dictionaries as D
from discloq.functions import text as X
from discloq.session import written


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf). Tokens are rows before they are filtered, so the filter is compiled."""
    whole = F.transform(X.domain_hits(F.col(text)), lambda w: F.concat(F.lit("\u0001"), w))  # marked: not cut into pairs
    rows = docs.select(key, F.explode(F.concat(X.token_runs(F.col(text)), whole)).alias("run"))
    cut = F.when(F.col("run").startswith("\u0001"), F.array(F.expr("substring(run, 2)"))).otherwise(X.han_pairs(F.lower("run")))
    rows = rows.select(key, F.explode(cut).alias("term"))
    return rows.filter(X.is_token(F.col("term"))).groupBy(key, "term").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf); idf is always positive."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(n_docs)
    return df.withColumn("idf", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


@dataclass
class LexicalIndex:
    """postings(key, term, tf), lengths(key, len), the number of documents and their mean length."""

    postings: DataFrame
    lengths: DataFrame
    n: int
    average: float


def lexical_index(docs: DataFrame, key: str = "doc_id") -> LexicalIndex:
    """The index of docs(key, text); its tables are written, so that any number of searches read
    them."""
    posts = written(postings(docs, key), "postings")
    lengths = written(posts.groupBy(key).agg(F.sum("tf").alias("len")), "lengths")
    n = docs.count()
    return LexicalIndex(posts, lengths, n, (lengths.agg(F.sum("len")).first()[0] or 0) / max(n, 1))


def bm25_scores(index: LexicalIndex, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(qid, key, score_bm25) of every document with a term of the query.

    Statistics are those of the whole corpus. ``queries`` are (qid, text) or, with further terms
    that are taken as they are, (qid, text, extra)."""
    posts, n, average = index.postings, index.n, index.average
    extra = F.coalesce("extra", F.array().cast("array<string>")) if "extra" in queries.columns else F.array().cast("array<string>")
    terms = F.explode(F.concat(X.tokens(F.col("text")), extra))
    wanted = queries.select("qid", terms.alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    k1, b = D.BM25_K1, D.BM25_B
    # one row per (term, document) that some query wants, before it meets the queries
    useful = posts.join(wanted.select("term").distinct(), "term", "left_semi")
    weight = useful.join(term_stats(useful, n), "term").join(index.lengths, key)
    norm = k1 * (1 - b + b * F.col("len") / F.lit(average))
    weight = weight.select(key, "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("w"))
    return weight.join(wanted, "term").groupBy("qid", key).agg(F.round(F.sum(F.col("w") * F.col("qtf")), 9).alias("score_bm25"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", pool: int = D.POOL) -> DataFrame:
    """(qid, key, score_bm25, rank_bm25): the ``pool`` best documents of each query(qid, text);
    equal scores are ranked by key."""
    return ranked(bm25_scores(lexical_index(docs, key), queries, key), key, "bm25", pool)


def ranked(scored: DataFrame, key: str, name: str, pool: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(f"score_{name}"), key)
    return scored.withColumn(f"rank_{name}", F.row_number().over(order)).filter(F.col(f"rank_{name}") <= pool)


def vector_search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", pool: int = D.POOL) -> DataFrame:
    """(qid, key, score_vector, rank_vector) by the dot product with queries(qid, vector). The
    query set is stated and meets all vectors."""
    return ranked(vector_scores(vectors, queries, key), key, "vector", pool)


def vector_scores(vectors: DataFrame, queries: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.crossJoin(queries).select("qid", key, F.round(X.dot(F.col("embedding"), F.col("vector")), 9).alias("score_vector"))


def fuse(lexical: DataFrame, vector: DataFrame, key: str, top: int, k: int = D.RRF_K, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Reciprocal-rank fusion; ties keep lexical order, then vector order."""
    both = lexical.join(vector, [*by, key], "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", F.round(part("rank_bm25") + part("rank_vector"), 6))
    both = both.withColumn("retriever", F.concat_ws("+", F.when(F.col("rank_bm25").isNotNull(), "bm25"), F.when(F.col("rank_vector").isNotNull(), "vector")))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("rank_bm25"), F.asc_nulls_last("rank_vector"), key)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def metadata_filter(docs: DataFrame, companies=(), kinds=(), sections=(), segments=()) -> DataFrame:
    """Strict filter before ranking; an empty list filters nothing."""
    for column, values in (("company", companies), ("kind", kinds), ("segment", segments)):
        if values:
            docs = docs.filter(F.col(column).isin(*values))
    return docs.filter(X.contains_any(F.col("section"), list(sections))) if sections else docs


def cover(hits: DataFrame, groups: int, top: int, group: str = "company", rank: str = "rank_bm25", key: str = "doc_id", pool: int = D.COVER_POOL, focus: str | None = None) -> DataFrame:
    """Grouped retrieval over hits(qid, key, group, rank): of each group's best ``pool`` at most
    ceil(top / groups), interleaved by rank within the group, then filled up by overall rank.
    ``focus`` names a flag that a group's hits must have where any of the group has it."""
    inner = Window.partitionBy("qid", group).orderBy(rank, key)
    quota = -(-top // groups)
    pooled = hits.withColumn("_place", F.row_number().over(inner)).filter(F.col("_place") <= pool)
    if focus:
        pooled = pooled.withColumn("_any", F.max(F.col(focus).cast("int")).over(Window.partitionBy("qid", group))).filter((F.col("_any") == 0) | F.col(focus))
        pooled = pooled.drop("_any")
    chosen = pooled.withColumn("_turn", F.row_number().over(inner)).filter(F.col("_turn") <= quota).drop("_place")
    first = chosen.withColumn("_part", F.lit(0))
    rest = hits.join(first.select("qid", key), ["qid", key], "left_anti").withColumn("_turn", F.col(rank)).withColumn("_part", F.lit(1))
    order = Window.partitionBy("qid").orderBy("_part", "_turn", F.when(F.col("_part") == 0, F.col(group)), key)
    return first.unionByName(rest).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).drop("_turn").withColumn("cover_group", F.when(F.col("_part") == 0, F.col(group))).drop("_part")
