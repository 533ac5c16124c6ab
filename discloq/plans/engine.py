"""Search and answers for a table of questions at once.

Chunks are (chunk_id, text, company, kind, section, segment, page_start, has_table), vectors
(chunk_id, embedding), questions (qid, text) and, for vector search, (..., vector). A question
may have its own filters, arrays only_companies and only_kinds; null or empty filters nothing.
Missing columns of chunks are empty.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discloq import dictionaries as D
from discloq.functions import text as X
from discloq.operators import answers, retrieval

MODES = ("hybrid", "bm25", "vector", "cover", "hybrid+cover")
META = {"company": "''", "kind": "''", "section": "''", "segment": "''", "page_start": "0", "has_table": "false"}
KEY = "chunk_id"
#: Of an answer without a scored sentence: so much of the first hit.
FALLBACK = 220
SHOWN, CONTEXT = 300, 1400


class Engine:
    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, aliases: dict[str, str] = D.ALIASES):
        for name, default in META.items():
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, F.expr(default))
        self.chunks, self.vectors, self.aliases = chunks, vectors, aliases

    @cached_property
    def index(self) -> retrieval.LexicalIndex:
        return retrieval.lexical_index(self.chunks.select(KEY, "text"), KEY)

    def eligible(self, companies=(), kinds=(), sections=(), segments=()) -> DataFrame:
        return retrieval.metadata_filter(self.chunks, companies, kinds, sections, segments).select(KEY, "company", "kind")

    def _lists(self, queries: DataFrame, mode: str, filters: dict, own: bool) -> tuple[DataFrame | None, DataFrame | None]:
        """Scores of each retriever among eligible chunks; with ``own``, of the companies that
        each query names only."""
        ok = self.eligible(**filters)
        limits = {c: at for c, at in (("only_companies", "company"), ("only_kinds", "kind"), ("companies", "company")) if c in queries.columns and (own or c != "companies")}

        def among(scores):
            scores = scores.join(ok, KEY)
            if limits:
                scores = scores.join(queries.select("qid", *limits), "qid")
            for c, at in limits.items():
                fits = F.array_contains(c, F.col(at))
                scores = scores.filter(fits if c == "companies" else F.coalesce(F.size(c) < 1, F.lit(True)) | fits)
            return scores.drop(*limits, "kind")

        lexical = vector = None
        if mode != "vector":
            asked = queries.select("qid", "text", X.expand_synonyms(F.col("text")).alias("extra"))
            lexical = among(retrieval.bm25_scores(self.index, asked, KEY))
        if mode != "bm25":
            if self.vectors is None or "vector" not in queries.columns:
                raise ValueError(f"{mode} needs vectors of chunks and questions")
            vector = among(retrieval.vector_scores(self.vectors, queries.filter("vector is not null").select("qid", "vector"), KEY))
        return lexical, vector

    def _ranked(self, queries: DataFrame, mode: str, top: int, filters: dict, by: tuple[str, ...] = ("qid",)) -> DataFrame:
        """(qid, company, chunk_id, score, rank_bm25, rank_vector, score_bm25, score_vector,
        retriever, rank), the ``top`` best of each value of ``by``."""
        lexical, vector = self._lists(queries, mode, filters, "company" in by)
        if lexical is not None:
            lexical = retrieval.ranked(lexical, KEY, "bm25", D.POOL, by)
        if vector is not None:
            vector = retrieval.ranked(vector, KEY, "vector", D.POOL, by)
        if mode == "hybrid":
            return retrieval.fuse(lexical, vector.drop(*({"company"} - set(by))), KEY, top, by=by)
        found, name, other = (lexical, "bm25", "vector") if mode == "bm25" else (vector, "vector", "bm25")
        return found.filter(F.col(f"rank_{name}") <= top).select(
            "*", F.round(f"score_{name}", 6).alias("score"), F.col(f"rank_{name}").alias("rank"), F.lit(name).alias("retriever"),
            F.lit(None).cast("int").alias(f"rank_{other}"), F.lit(None).cast("double").alias(f"score_{other}"),
        )

    def search(self, queries: DataFrame, mode: str = "hybrid", top: int = 8, focus_off: bool = False, base: str = "hybrid", **filters) -> DataFrame:
        """Hits: (qid, rank, chunk with its columns, score, ranks and scores, retriever, cite,
        cover_group). ``filters`` (companies, kinds, sections, segments) hold before ranking.

        ``cover`` splits a question that names two companies or more: each company's best are
        found by the question without names, must have a focus term where any of them has,
        and take turns; the rest is filled from the plain search. ``base`` is what it searches
        by. ``focus_off`` leaves the focus out, to find what it costs."""
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if mode in ("cover", "hybrid+cover"):
            return self._shown(self._cover(queries, base, top, focus_off, filters))
        return self._shown(self._ranked(queries, mode, top, filters).withColumn("cover_group", F.lit(None).cast("string")))

    def _cover(self, queries: DataFrame, mode: str, top: int, focus_off: bool, filters: dict) -> DataFrame:
        known = self.chunks.agg(F.collect_set("company").alias("_known"))  # one row
        listed = filters.get("companies")
        names = F.array(*map(F.lit, listed)) if listed else X.detect_names(F.col("text"), self.aliases)
        if "only_companies" in queries.columns:
            names = F.when(F.size("only_companies") > 0, F.col("only_companies")).otherwise(names)
        asked = queries.crossJoin(F.broadcast(known)).withColumn("companies", F.filter(names, lambda c: F.array_contains("_known", c))).drop("_known")
        asked = asked.withColumn("companies", F.when(F.size("companies") > 1, F.col("companies")).otherwise(F.array().cast("array<string>")))
        split = asked.filter(F.size("companies") > 0).withColumn("focus", X.focus_terms(F.col("text")))
        split = split.withColumn("text", X.strip_names(F.col("text"), self.aliases))
        found = self._ranked(split, mode, D.COVER_POOL, filters, ("qid", "company"))
        found = found.join(split.select("qid", "companies", "focus"), "qid").join(self.chunks.select(KEY, F.col("text").alias("_text")), KEY)
        of_group = Window.partitionBy("qid", "company")
        on_focus = F.lit(True) if focus_off else F.exists("focus", lambda w: F.contains("_text", w))
        found = found.withColumn("_on", on_focus).withColumn("_any", F.bool_or("_on").over(of_group)).filter(F.col("_on") | ~F.col("_any"))
        quota = F.ceil(F.lit(top) / F.size("companies"))
        found = found.withColumn("_turn", F.row_number().over(of_group.orderBy("rank"))).filter(F.col("_turn") <= quota)
        found = found.withColumn("_seat", F.array_position("companies", F.col("company"))).withColumn("cover_group", F.col("company"))
        plain = self._ranked(queries, mode, 2 * top, filters).withColumn("cover_group", F.lit(None).cast("string"))
        rest = plain.join(found.select("qid", KEY), ["qid", KEY], "left_anti").withColumn("_part", F.lit(1)).withColumn("_turn", F.col("rank")).withColumn("_seat", F.lit(0))
        columns = ["qid", "company", KEY, "score", "rank_bm25", "rank_vector", "score_bm25", "score_vector", "retriever", "cover_group", "_part", "_turn", "_seat"]
        if "company" not in rest.columns:
            rest = rest.join(self.chunks.select(KEY, "company"), KEY)
        all_ = found.withColumn("_part", F.lit(0)).select(columns).unionByName(rest.select(columns))
        order = Window.partitionBy("qid").orderBy("_part", "_turn", "_seat", KEY)
        return all_.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("_part", "_turn", "_seat")

    def _shown(self, hits: DataFrame) -> DataFrame:
        full = hits.drop("company").join(self.chunks, KEY)
        return full.withColumn("cite", X.citation(F.col("company"), F.col("kind"), F.col("section"), F.col("page_start")))

    def answer(self, queries: DataFrame, mode: str = "hybrid", top: int = 8, **options) -> DataFrame:
        """One row a question: (qid, answer, bullets, citations, n_hits). Bullets are at most six
        sentences of the hits; where several companies are grouped they take turns. Without a
        scored sentence the first hit's beginning stands. No hit: empty arrays."""
        hits = self.search(queries, mode, top, **options).withColumn("ci", F.col("rank") - 1)
        asked = queries.select("qid", F.array_distinct(X.tokens(F.col("text"))).alias("terms"), X.contains_any(F.col("text"), D.NUMBER_ASKED).alias("num_q"), X.focus_terms(F.col("text")).alias("focus"))
        cands = answers.candidates(hits.join(asked, "qid"), F.col("terms"), F.col("num_q"), F.col("focus"))
        grouped = hits.groupBy("qid").agg((F.countDistinct("cover_group") > 1).alias("_many"))
        cands = cands.join(grouped, "qid")
        picked = answers.best(cands.filter(~F.col("_many"))).select("qid", "ci", "sentence", "score", "has_num", "place")
        picked = picked.unionByName(answers.in_turns(cands.filter("_many"), "company").select("qid", "ci", "sentence", "score", "has_num", "place"))
        first = hits.filter("ci = 0").join(picked.select("qid").distinct(), "qid", "left_anti")
        begins = F.translate(F.substring("text", 1, FALLBACK), "\n", " ")
        picked = picked.unionByName(first.select("qid", "ci", begins.alias("sentence"), F.lit(1.0).alias("score"), F.lit(False).alias("has_num"), F.lit(1).alias("place")))
        picked = answers.renumbered(picked).join(hits.select("qid", "ci", "cite", "company", KEY), ["qid", "ci"])
        shown = F.when(F.length("sentence") > SHOWN, F.concat(F.substring("sentence", 1, SHOWN), F.lit("…"))).otherwise(F.col("sentence"))
        bullet = F.struct("place", shown.alias("text"), "n", "cite", F.col("has_num").alias("has_number"), F.round("score", 4).alias("score"))
        cite = F.struct("n", "cite", "company", KEY)
        per = picked.groupBy("qid").agg(F.array_sort(F.collect_list(bullet)).alias("bullets"), F.array_sort(F.collect_set(cite)).alias("citations"), F.count_if("has_num").alias("_nums"))
        top1 = hits.groupBy("qid").agg(F.min_by("cite", "rank").alias("_top"), F.count("*").alias("n_hits"))
        who = F.array_join(F.array_distinct(F.transform("citations", lambda c: c["company"])), "、")
        head = F.concat(F.lit("依据 "), F.size("citations").cast("string"), F.lit(" 个知识块（"), who, F.lit("），最相关来源："), F.col("_top"), F.lit("。"))
        found = F.when(F.col("_nums") > 0, F.concat(F.lit(" 检出 "), F.col("_nums").cast("string"), F.lit(" 条含数字的关键证据，见下方标注。"))).otherwise(" ⚠ 未检出明确数字，该问题可能需看完整表格。")
        out = asked.select("qid", "num_q").join(per, "qid", "left").join(top1, "qid", "left")
        return out.select(
            "qid", F.coalesce(F.concat(head, F.when(F.col("num_q"), found).otherwise("")), F.lit("")).alias("answer"), F.coalesce("bullets", F.expr("array()")).alias("bullets"),
            F.coalesce("citations", F.expr("array()")).alias("citations"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        )

    def context(self, hits: DataFrame) -> DataFrame:
        """(qid, context): the numbered, cut texts that a language model would be given."""
        part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("cite"), F.lit("\n"), F.substring("text", 1, CONTEXT))
        rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("_l"))
        return rows.select("qid", F.array_join(F.transform("_l", lambda s: s["t"]), "\n\n").alias("context"))

