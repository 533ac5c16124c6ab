"""Scoring by evidence obligation, attribution of failures, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloq.functions import text as X

MODES = ("hybrid", "bm25", "vector", "cover")
# fixed values: obligations covered by the answers of each mode, (qid, shape, total, *modes)
FROZEN = (
    ("Q01", "全局", 5, 1, 0, 1, 3), ("Q02", "全局", 8, 1, 1, 2, 3), ("Q03", "多跳", 3, 1, 2, 1, 2), ("Q04", "局部", 4, 4, 4, 4, 4),
    ("Q05", "局部", 2, 1, 1, 1, 1), ("Q06", "局部", 3, 2, 2, 2, 2), ("Q07", "局部", 5, 2, 2, 0, 2), ("Q08", "局部", 3, 3, 0, 3, 3),
    ("Q09", "局部", 3, 1, 1, 0, 1), ("Q10", "全局", 6, 1, 2, 0, 1),
)
# fixed values: why an obligation isn't covered
GAP_REASONS = {"A": "语料未披露该口径", "B": "公司名漏识别", "C": "焦点词误杀", "D": "召回不足", "E": "口径不一致", "F": "数值无归宿", "G": "语料表格未抽取（提取缺口）", "H": "答案未取到已召回的证据（组装/选句）"}


def frozen_runs(spark) -> DataFrame:
    """(qid, shape, total, mode, covered)."""
    rows = [(q, s, t, m, c) for q, s, t, *cs in FROZEN for m, c in zip(MODES, cs)]
    return spark.createDataFrame(rows, "qid string, shape string, total int, mode string, covered int")


def verdict(covered: Column, total: Column) -> Column:
    return F.when(total <= 0, "—").when(covered >= total, "正确").when(covered > 0, "部分正确").otherwise("错误")


def coverage(runs: DataFrame, *by: str) -> DataFrame:
    """Ratio of sums, not mean of ratios."""
    return runs.groupBy(*by).agg(F.sum("covered").alias("covered"), F.sum("total").alias("total")).withColumn("coverage", F.round(F.col("covered") / F.greatest(F.col("total"), F.lit(1)), 3))


def judge_groups(items: DataFrame, groups: DataFrame) -> DataFrame:
    """items(qid, blob) and groups(qid, group_no, variants): does each group have a variant in the
    blob, and do all groups of the query."""
    hit = items.join(groups, "qid").withColumn("hit", F.exists("variants", lambda v: F.contains("blob", v)))
    return hit.groupBy("qid").agg(F.bool_and("hit").alias("all_hit"), F.sum(F.col("hit").cast("int")).alias("n_hit"), F.count("*").alias("n_groups"))


def judge_obligations(items: DataFrame, obligations: DataFrame, aliases: DataFrame) -> DataFrame:
    """items(qid, text, company), obligations(qid, id, subject, values), aliases(subject, names).

    Covered: an item has a value and is attributed: the obligation has no subject, the company is
    the subject, or there is no company and the text names the subject. Partly: a value only."""
    text = X.norm_number(F.col("text"))
    o = obligations.join(aliases, "subject", "left").withColumn("values", F.filter(F.transform("values", X.norm_number), lambda v: v != ""))
    pairs = o.join(items.withColumn("text", text), "qid", "left")
    value = F.coalesce(F.exists("values", lambda v: F.contains("text", v)), F.lit(False))
    named = F.col("company").isNull() & F.coalesce(F.exists("names", lambda n: F.contains("text", n)), F.lit(False))
    own = F.col("subject").isNull() | F.coalesce(F.col("company") == F.col("subject"), F.lit(False)) | named
    out = pairs.groupBy("qid", "id").agg(F.max(value).alias("value_hit"), F.max(value & own).alias("attributed"))
    return out.withColumn("status", F.when(F.col("attributed"), "已覆盖").when(F.col("value_hit"), "部分").otherwise("缺"))


def gap_code(hint: Column, in_corpus: Column, company_missed: Column, ablation_ok: Column, value_hit: Column, attributed: Column, top8: Column, subject: Column, alias_there: Column) -> Column:
    """The order is the meaning."""
    return (
        F.when(hint.isNotNull(), hint).when(~in_corpus, "A").when(company_missed, "B").when(ablation_ok, "C")
        .when(value_hit & ~attributed, "F").when(top8 == "已覆盖", "H").when(subject.isNotNull() & ~alias_there, "E").otherwise("D")
    )


def gap_counts(gaps: DataFrame, examples: int = 6) -> DataFrame:
    """How often each code occurs, absent ones with 0, and the first examples."""
    codes = gaps.sparkSession.createDataFrame(list(GAP_REASONS.items()), "code string, reason string")
    found = gaps.groupBy("code").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("id")), 1, examples).alias("examples"))
    return codes.join(found, "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# fixed values: share of questions hit in the first run, kept for comparison
FIRST_RUN = {"hybrid": 0.60, "bm25": 0.70, "vector": 0.60, "cover": None}


def groups_hit(blob: Column, groups: Column) -> Column:
    """For each group of wordings: is one of them in the text. No group: an empty array."""
    return F.transform(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda w: F.contains(F.coalesce(blob, F.lit("")), w)))


def hit_texts(hits: DataFrame, depth: int, with_meta: bool = True) -> DataFrame:
    """(qid, blob): the texts of each question's first ``depth`` hits, each behind its company,
    kind and section."""
    part = F.concat_ws("\n", F.concat_ws(" ", "company", "kind", "section"), "text") if with_meta else F.col("text")
    rows = hits.filter(F.col("rank") <= depth).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("_l"))
    return rows.select("qid", F.array_join(F.transform("_l", lambda s: s["t"]), "\n").alias("blob"))


def hit_class(hit5: Column, hit8: Column) -> Column:
    return F.when(hit5, "命中").when(hit8, "仅Top8命中").otherwise("未命中")


def answer_items(answers: DataFrame) -> DataFrame:
    """(qid, text, company) of what an answer says: its head without a company, its bullets with
    the company that they cite."""
    head = answers.select("qid", F.col("answer").alias("text"), F.lit(None).cast("string").alias("company"))
    bullets = answers.select("qid", F.explode("bullets").alias("b"))
    return head.unionByName(bullets.select("qid", F.col("b.text").alias("text"), X.cited_company(F.col("b.cite")).alias("company")))


def against_first_run(scores: DataFrame) -> DataFrame:
    """scores(mode, hit_rate) beside the first run's and the difference in points."""
    first = scores.sparkSession.createDataFrame(list(FIRST_RUN.items()), "mode string, first double")
    return scores.join(first, "mode", "left").withColumn("points", F.round((F.col("hit_rate") - F.col("first")) * 100, 1))


def rationale(covered: Column, total: Column, right: Column, partly: Column, absent: Column, codes: Column) -> Column:
    """One sentence: the verdict, then what was answered, unattributed and absent (arrays of
    strings), and the codes of failures. Empty parts go."""
    part = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, "、"), F.lit("。")))
    head = F.concat(F.lit("cover "), covered.cast("string"), F.lit("/"), total.cast("string"), F.lit("，判定 "), verdict(covered, total), F.lit("。"))
    return F.concat_ws(" ", head, part("已答对：", right), part("数值未归宿：", partly), part("未答出：", absent), part("归因：", codes))
