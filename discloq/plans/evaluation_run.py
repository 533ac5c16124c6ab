"""A full evaluation: questions by modes, judged by hits and by obligations, failures attributed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloq.functions import text as X
from discloq.operators import evaluation as E
from discloq.plans.engine import Engine
from discloq.session import written

DEPTHS = (5, 8)


def asked(questions: DataFrame) -> DataFrame:
    own = [F.col(c).alias(f"only_{c}") for c in ("companies", "kinds")]
    return questions.select("qid", F.col("q").alias("text"), *own, *(["vector"] if "vector" in questions.columns else []))


def obligations(questions: DataFrame) -> DataFrame:
    o = questions.select("qid", "companies", "kinds", "must_contain", F.explode("obligations").alias("o"))
    return o.select("qid", F.col("o.id").alias("id"), F.col("o.subject").alias("subject"), F.col("o.item").alias("item"), F.coalesce("o.values", F.array().cast("array<string>")).alias("values"), F.col("o.gap_hint").alias("hint"), "companies", "kinds", "must_contain")


def names(engine: Engine, spark) -> DataFrame:
    return spark.createDataFrame([(n, [n, a]) for n, a in engine.aliases.items()] or [("", [""])], "subject string, names array<string>")


def run_mode(engine: Engine, questions: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(runs, verdicts) of one mode: a row per question, and a row per obligation."""
    spark, queries, duties = questions.sparkSession, asked(questions), obligations(questions)
    hits = written(engine.search(queries, mode, 8), "hits")
    said = written(engine.answer(queries, mode, 8), "answers")
    runs = questions.select("qid", "shape", "type", F.col("must_contain").alias("_must"), F.col("soft_must_contain").alias("_soft"))
    for depth in DEPTHS:
        runs = runs.join(E.hit_texts(hits, depth).withColumnRenamed("blob", f"_b{depth}"), "qid", "left")
        runs = runs.withColumn(f"hit{depth}", F.forall(E.groups_hit(F.col(f"_b{depth}"), F.col("_must")), lambda x: x))
        runs = runs.withColumn(f"soft_gaps{depth}", F.size(F.filter(E.groups_hit(F.col(f"_b{depth}"), F.col("_soft")), lambda x: ~x)))
    runs = runs.join(E.hit_texts(hits, 5, False), "qid", "left").withColumn("hit5_text", F.forall(E.groups_hit(F.col("blob"), F.col("_must")), lambda x: x))
    runs = runs.join(hits.groupBy("qid").agg(F.min_by("cite", "rank").alias("top1_cite")), "qid", "left").withColumn("hit_class", E.hit_class(F.col("hit5"), F.col("hit8")))
    plain = duties.select("qid", "id", "subject", "values")
    alias = names(engine, spark)
    verdicts = E.judge_obligations(E.answer_items(said), plain, alias)
    for depth in DEPTHS:
        items = hits.filter(F.col("rank") <= depth).select("qid", "text", "company")
        verdicts = verdicts.join(E.judge_obligations(items, plain, alias).select("qid", "id", F.col("status").alias(f"status{depth}")), ["qid", "id"])
    if mode == "cover":
        open_ = engine.search(queries, mode, 8, focus_off=True).select("qid", "text", "company")
        without = E.judge_obligations(open_, plain, alias).select("qid", "id", (F.col("status") == "已覆盖").alias("ablation_ok"))
        verdicts = verdicts.join(without, ["qid", "id"])
    else:
        verdicts = verdicts.withColumn("ablation_ok", F.lit(False))
    done = lambda c: F.count_if(F.col(c) == "已覆盖")
    sums = verdicts.groupBy("qid").agg(F.count("*").alias("total"), done("status").alias("covered"), done("status5").alias("covered5"), done("status8").alias("covered8"))
    runs = runs.drop("_must", "_soft", "blob", "_b5", "_b8").join(sums, "qid", "left").fillna(0, ["total", "covered", "covered5", "covered8"]).join(said.select("qid", "answer", "bullets", "citations"), "qid")
    return runs.withColumn("mode", F.lit(mode)), verdicts.withColumn("mode", F.lit(mode))


def evaluate(engine: Engine, questions: DataFrame, modes: tuple[str, ...] = E.MODES) -> tuple[DataFrame, DataFrame]:
    """(runs, verdicts) of all modes; both are written."""
    both = [run_mode(engine, questions, m) for m in modes]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return written(union([r for r, _ in both]), "runs"), written(union([v for _, v in both]), "verdicts")


def attribute(engine: Engine, questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(qid, mode, id, subject, item, status, code): why an obligation isn't covered.

    The corpus is read once for all obligations, which are few: does a chunk of the subject, and
    of the question's companies and kinds, have a value, or one of the question's wordings."""
    duties = obligations(questions)
    corpus = engine.chunks.select("company", "kind", "text", X.norm_number(F.col("text")).alias("_norm"))
    ours = lambda c, at: F.coalesce(F.size(c) < 1, F.lit(True)) | F.array_contains(c, F.col(at))
    wanted = duties.select("qid", "id", "subject", "companies", "kinds", F.filter(F.transform("values", X.norm_number), lambda v: v != "").alias("values"), F.flatten(F.coalesce("must_contain", F.expr("array(array(''))"))).alias("words"))
    has = F.exists("values", lambda v: F.contains("_norm", v)) & (F.col("subject").isNull() | (F.col("subject") == F.col("company"))) & ours("companies", "company") & ours("kinds", "kind")
    uses = (F.col("subject") == F.col("company")) & ours("kinds", "kind") & F.exists("words", lambda w: F.contains("text", w))
    # a stated set of obligations meets every chunk once; only flags leave the scan
    seen = corpus.crossJoin(F.broadcast(wanted)).select("qid", "id", has.alias("has"), uses.alias("uses")).groupBy("qid", "id").agg(F.bool_or("has").alias("in_corpus"), F.bool_or("uses").alias("alias_there"))
    # detection knows the companies of the table of names; the corpus may have others
    unknown = engine.chunks.select("company").distinct().filter("company is not null and company != ''").filter(~F.col("company").isin(*engine.aliases))
    asked = questions.select("qid", "q")
    named = unknown.join(F.broadcast(asked), F.contains("q", "company")).groupBy("qid").agg(F.count("*").alias("_missed"))
    rows = verdicts.filter("status <> '已覆盖'").join(duties.select("qid", "id", "subject", "item", "hint", F.size(F.flatten(F.coalesce("must_contain", F.expr("array()")))).alias("_words")), ["qid", "id"])
    rows = rows.join(seen, ["qid", "id"], "left").join(named, "qid", "left").fillna(False, ["in_corpus", "alias_there"]).fillna(0, ["_missed"])
    there = F.col("alias_there") | (F.col("_words") == 0)
    code = E.gap_code(F.col("hint"), F.col("in_corpus"), F.col("_missed") > 0, F.col("ablation_ok"), F.col("value_hit"), F.col("attributed"), F.col("status8"), F.col("subject"), there)
    return rows.select("qid", "mode", "id", "subject", "item", "status", code.alias("code"))


def scores(runs: DataFrame, *by: str) -> DataFrame:
    """Hit rates and ratios of sums of obligations, by mode unless told otherwise."""
    ratio = lambda c: F.round(F.sum(c) / F.greatest(F.sum("total"), F.lit(1)), 3).alias(f"{c}_share")
    rate = lambda c, n: F.round(F.avg(F.col(c).cast("int")), 3).alias(n)
    return runs.groupBy(*(by or ("mode",))).agg(rate("hit5", "hit_rate"), rate("hit8", "hit_rate8"), rate("hit5_text", "hit_rate_text"), F.sum("total").alias("total"), ratio("covered"), ratio("covered5"), ratio("covered8"))


def ledger(runs: DataFrame) -> DataFrame:
    """One row, ``markdown``: a table of all runs by number of question and mode."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("/"))
    verdict = E.verdict(F.col("covered"), F.col("total"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "qid", "mode", "hit_class", F.concat_ws("/", "covered", "total"), verdict, cell("top1_cite")), F.lit(" |"))
    key = F.struct(F.regexp_replace("qid", r"\D", "").try_cast("int").alias("no"), "qid", "mode", line.alias("line"))
    head = "| 题号 | 路线 | 检索 | 义务 | 判定 | 首位来源 |\n|---|---|---|---|---|---|\n"
    return runs.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["line"]), "\n")).alias("markdown"))
