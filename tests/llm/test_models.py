"""The two classifiers against plain restatements: convolution, window sums."""

import numpy as np
import pytest

from discloq.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_letters_are_of_category_l():
    assert not any(map(language.has_letter, ["", "² ½ ① Ⅷ", "12_3 !?", "٣"]))
    assert all(map(language.has_letter, ["1a", "ñ", "你", "ª", "ß²"]))


def test_folded_tables_are_the_plain_convolution():
    net = language.train(["the cat sat on the mat", "el gato se sienta aqui", "le chat est assis la"] * 4, ["en", "es", "fr"] * 4, steps=2)
    texts = ["the gato sat", "x", "é" * 300, "word " * 120, "a\0b"]
    x, owner, covered = language.windows(texts)
    plain = np.zeros((len(x), len(language.WIDTHS) * language.FILTERS))
    for r, row in enumerate(np.concatenate([x, np.zeros((len(x), 3), np.uint8)], 1)):
        k = 0
        for w in net.filters:
            sums = [sum(net.embed[row[i + j]] @ w[j] for j in range(len(w))) for i in range(language.LENGTH)]
            plain[r, k : k + language.FILTERS] = np.max(sums, 0)
            k += language.FILTERS
    plain = np.maximum(plain + net.shift, 0)
    assert np.allclose(net.pooled(x), plain, atol=1e-3)
    logits = plain @ net.dense + net.base
    for t in range(len(texts)):
        mean = np.average(logits[owner == t], axis=0, weights=covered[owner == t])
        p = np.exp(mean - mean.max())
        label, score = (v[t] for v in net.predict(texts))
        assert label == net.labels[int(p.argmax())] and abs(score - p.max() / p.sum()) < 1e-3


def test_margin_is_the_largest_window_sum():
    rng = np.random.default_rng(8)
    model = toxicity.Model(rng.normal(0, 1, len(toxicity.ORDERS) << toxicity.BITS).astype(np.float32), -0.5)
    texts = ["", "A short one", "ünï cödé " * 9, "x" * 5, "many words of a longer text, with some more of them"]
    got = model.margins(texts)
    for t, margin in zip(texts, got):
        alone, _ = toxicity.features([t])
        per_place = sum(model.weights[row] for row in alone).astype(float)
        sums = [per_place[max(0, e - toxicity.WINDOW + 1) : e + 1].sum() for e in range(len(per_place))]
        assert abs(max(sums) - 0.5 - model.margins([t])[0]) < 1e-3
        assert margin >= model.margins([t])[0] - 1e-3  # beside others a window may begin in the padding between
    assert ((model.score(texts) >= 0) & (model.score(texts) <= 1)).all()


@pytest.mark.parametrize("long", ["x", "word "])
def test_very_long_texts(long):
    model = toxicity.Model(np.zeros(len(toxicity.ORDERS) << toxicity.BITS, np.float32), 0.0)
    assert model.score([long * 400_000, ""]).tolist() == [0.5, 0.5]
    net = language.train(["the cat", "el gato"] * 4, ["en", "es"] * 4, steps=1)
    assert len(net.predict([long * 100_000])[0]) == 1


def test_toxic_documents_held_out(spark):
    got = toxicity.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert len(got) > 50
    right = sum(r["predicted"] == r["toxic"] for r in got)
    caught = sum(r["predicted"] for r in got if r["toxic"]) / max(1, sum(r["toxic"] for r in got))
    assert right / len(got) > 0.9 and caught > 0.6, (right, len(got), caught)
