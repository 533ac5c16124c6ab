"""The engine and the evaluation over a small corpus, embedding against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from discloq.operators import embedding
from discloq.plans import evaluation_run as R
from discloq.plans.engine import Engine
from discloq.sources.tables import QUESTIONS, index_meta

CHUNKS = [
    ("a1", "顺丰控股单票收入2.17元；单票成本1.90元。其他内容无关。", "顺丰控股", "年报", "第三节", 3, False),
    ("a2", "顺丰控股的公司治理情况说明，没有数字。", "顺丰控股", "年报", "第四节", 9, False),
    ("b1", "圆通速递票均收入为2.05元，同比下降。", "圆通速递", "年报", "第三节", 5, False),
    ("b2", "| 项目 | 金额 |\n|---|---|\n| 单票收入 | 2.05 |", "圆通速递", "半年报", "第三节", 6, True),
    ("c1", "韵达股份市占率12.5%，业务量增长。", "韵达股份", "年报", "第三节", 7, False),
]


@pytest.fixture(scope="module")
def engine(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text string, company string, kind string, section string, page_start int, has_table boolean")
    vectors = spark.createDataFrame([(c[0], [float(i == j) for j in range(5)]) for i, c in enumerate(CHUNKS)], "chunk_id string, embedding array<float>")
    return Engine(chunks, vectors)


def asked(spark, *texts):
    return spark.createDataFrame([(i, t, [0.0, 1.0, 0.0, 0.0, 0.0]) for i, t in enumerate(texts)], "qid int, text string, vector array<float>")


def test_modes_and_filters(spark, engine):
    q = asked(spark, "单票收入是多少")
    ids = lambda **o: [r["chunk_id"] for r in engine.search(q, **o).orderBy("rank").collect()]
    assert set(ids(mode="bm25")) == {"a1", "b1", "b2"}  # b1 by its synonym
    assert ids(mode="vector", top=1) == ["a2"]
    assert set(ids(mode="bm25", companies=["圆通速递"])) == {"b1", "b2"}
    assert ids(mode="bm25", kinds=["半年报"]) == ["b2"]
    assert ids(mode="bm25", sections=["第四"]) == []
    assert set(ids(mode="hybrid")) == {c[0] for c in CHUNKS}
    row = engine.search(q, "hybrid").filter("chunk_id = 'a1'").first()
    assert row["retriever"] == "bm25+vector" and row["cite"] == "顺丰控股·年报·第三节·P3页"
    with pytest.raises(ValueError):
        engine.search(q, "other")
    with pytest.raises(ValueError):
        Engine(engine.chunks).search(q, "hybrid")


def test_question_filters(spark, engine):
    q = asked(spark, "单票收入", "单票收入").withColumn("only_companies", F.when(F.col("qid") == 0, F.array(F.lit("圆通速递")))).withColumn("only_kinds", F.array().cast("array<string>"))
    got = {(r["qid"], r["chunk_id"]) for r in engine.search(q, "bm25").collect()}
    assert got == {(0, "b1"), (0, "b2"), (1, "a1"), (1, "b1"), (1, "b2")}


def test_cover(spark, engine):
    q = asked(spark, "顺丰控股和圆通速递的单票收入是多少", "顺丰控股的单票收入")
    rows = engine.search(q, "cover", 4).orderBy("qid", "rank").collect()
    first = [(r["chunk_id"], r["cover_group"]) for r in rows if r["qid"] == 0]
    assert first[0][1] == "顺丰控股" and first[1][1] == "圆通速递" and len(first) == 4
    assert "a2" not in [c for c, g in first if g]  # no focus term, and a1 has one
    off = engine.search(q, "cover", 4, focus_off=True).filter("qid = 0 and cover_group is not null").collect()
    assert "a2" in [r["chunk_id"] for r in off]
    plain = engine.search(q, "hybrid", 4).filter("qid = 1").orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows if r["qid"] == 1] == [r["chunk_id"] for r in plain]


def test_answers(spark, engine):
    q = asked(spark, "单票收入是多少", "", "顺丰控股和圆通速递的单票收入是多少")
    got = {r["qid"]: r for r in engine.answer(q, "bm25").collect()}
    assert got[0]["bullets"][0]["has_number"] and "依据" in got[0]["answer"] and len(got[0]["citations"]) >= 2
    assert got[1]["answer"] == "" and got[1]["bullets"] == [] and got[1]["citations"] == []
    turns = {r["qid"]: r for r in engine.answer(q, "cover").collect()}
    assert {b["cite"].split("·")[0] for b in turns[2]["bullets"][:2]} == {"顺丰控股", "圆通速递"}
    context = engine.context(engine.search(q, "bm25", 2)).filter("qid = 0").first()["context"]
    assert context.startswith("[1] ") and "\n\n[2] " in context


def test_evaluation(spark, engine):
    duty = lambda i, s, v, hint=None: (i, s, "单票收入", "2025", v, "", hint)
    rows = [
        ("Q2", "单票收入是多少", "数值", "局部", None, None, [["单票收入", "票均收入"]], [["没有的词"]], [duty("Q2-1", "顺丰控股", ["2.17"]), duty("Q2-2", "韵达股份", ["2.17"]), duty("Q2-3", "韵达股份", ["9.99"])]),
        ("Q10", "市占率", "数值", "全局", ["韵达股份"], None, [["无此词"]], None, [duty("Q10-1", None, ["12.5%"]), duty("Q10-2", "韵达股份", [], "G")]),
    ]
    questions = spark.createDataFrame(rows, QUESTIONS)
    runs, verdicts = R.evaluate(engine, questions, ("bm25",))
    by = {r["qid"]: r for r in runs.collect()}
    assert (by["Q2"]["hit_class"], by["Q2"]["covered"], by["Q2"]["total"], by["Q2"]["soft_gaps5"]) == ("命中", 1, 3, 1)
    assert (by["Q10"]["hit_class"], by["Q10"]["covered"], by["Q10"]["total"]) == ("未命中", 1, 2)
    codes = {r["id"]: r["code"] for r in R.attribute(engine, questions, verdicts).collect()}
    assert codes == {"Q2-2": "A", "Q2-3": "A", "Q10-2": "G"}
    # a company of the corpus that the table of names lacks, named in the question
    chunks = engine.chunks.withColumn("company", F.replace("company", F.lit("韵达股份"), F.lit("无名快运")))
    unmet = verdicts.filter("id = 'Q2-1'").withColumn("status", F.lit("缺"))
    codes = [R.attribute(type(engine)(chunks, engine.vectors, engine.aliases), questions.withColumn("q", F.concat("q", F.lit(x))), unmet).first()["code"] for x in ("", " 无名快运")]
    assert codes[0] != "B" and codes[1] == "B"
    score = R.scores(runs).first()
    assert (score["hit_rate"], score["covered_share"]) == (0.5, 0.4)
    assert R.ledger(runs).first()["markdown"].split("\n")[2].startswith("| Q2 | bm25 | 命中 | 1/3 | 部分正确 |")


def test_meta(engine):
    row = index_meta(engine.chunks).first()
    assert (row["n_chunks"], row["n_tables"], row["kinds"]) == (5, 1, ["半年报", "年报"])


def test_svd(spark):
    texts = ["aa bb cc", "aa bb", "cc dd aa", "dd bb", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    weights = embedding.tfidf(docs, "doc_id").collect()
    a = np.zeros((5, 1 + max(r["j"] for r in weights)))
    for r in weights:
        a[r["doc_id"], r["j"]] = r["w"]
    assert np.allclose(np.linalg.norm(a[:4], axis=1), 1) and not a[4].any()
    _, _, vt = np.linalg.svd(a)
    want = a @ vt[:2].T
    want = want[:4] / np.linalg.norm(want[:4], axis=1, keepdims=True)
    got = np.array([r["embedding"] for r in embedding.svd_vectors(docs, "doc_id", dim=2).orderBy("doc_id").collect()])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-5)
