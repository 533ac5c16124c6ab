"""TF-IDF of all documents."""

import math
from collections import Counter

import pytest

from discloq import registry
from discloq.operators import embedding

SF = "/root/testdata/sf0.001"


def weights(texts):
    """{key: {gram: weight}} of grams of two or three characters that two texts or more have."""
    tf = {}
    for k, text in texts.items():
        found = Counter()
        for w in (text or "").lower().split():
            found.update(f" {w} "[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n))
        tf[k] = found
    df = Counter(g for c in tf.values() for g in c)
    out = {}
    for k, c in tf.items():
        x = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        norm = math.sqrt(sum(v * v for v in x.values()))
        if x:
            out[k] = {g: v / norm for g, v in x.items()}
    return out


def test_grams_of_documents(spark):
    want = weights(dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    got = {r["doc_id"]: r for r in registry.QUERIES["tfidf_document_grams"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 150
    for k, x in want.items():
        assert got[k]["n_grams"] == len(x) and abs(got[k]["total"] - sum(x.values())) < 1e-5 and abs(got[k]["largest"] - max(x.values())) < 1e-5


def test_grams_of_odd_texts(spark):
    """Null and empty texts, keys that are null or shared, blanks of all kinds, letters beyond 16
    bits; few rows move, none for each gram of each text."""
    rows = [(1, "Aa bb\n\n bb"), (2, "  aa\tbb\x0bc "), (3, None), (4, ""), (5, "a"), (6, "𝒳𝒴 營收 a"), (7, "營收\x0c𝒳𝒴"), (None, "aa zq"), (9, "aa"), (9, "bb aa zq"), (10, " \n ")]
    docs = spark.createDataFrame(rows, "k long, text string")
    tf = {}
    for k, t in rows:
        for w in (t or "").lower().split():
            tf.setdefault(k, Counter()).update(f" {w} "[i : i + n] for n in (2, 3) for i in range(len(w) + 3 - n))
    df, want = Counter(g for c in tf.values() for g in c), {}
    for k, c in tf.items():
        x = {g: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        norm = math.sqrt(sum(v * v for v in x.values()))
        want[k] = {g: v / norm for g, v in x.items()}
    found = {}
    for r in embedding.tfidf(docs, "k").collect():
        found.setdefault(r["k"], {})[r["gram"]] = r["w"]
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    totals = {r["k"]: tuple(r)[1:] for r in embedding.tfidf_totals(docs, "k").collect()}
    assert totals == {k: pytest.approx((len(x), sum(x.values()), max(x.values()))) for k, x in want.items()}
    plan = embedding.tfidf_totals(docs.filter("k < 9"), "k")._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("piece", [1, 2, 3, 7])
def test_texts_cut_anywhere(monkeypatch, piece):
    texts = ["", " ", "a", " a", "a ", "  ab \n cd  ", "abc", "a b c  d", "營收𝒳 a\t\t" * 5]
    want = [tuple(x.tolist() for x in embedding._counted(t)) for t in texts]
    assert [len(x[0]) for x in want[:4]] == [0, 0, 3, 3] and embedding._names(embedding._counted("ab")[0]) == [" a", "ab", "b ", " ab", "ab "]
    monkeypatch.setattr(embedding, "PIECE", piece)
    assert [tuple(x.tolist() for x in embedding._counted(t)) for t in texts] == want
