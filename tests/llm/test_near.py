"""The pipeline's near-dedup against brute force over all pairs."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from discloq.llm import near, simhash

SF = "/root/testdata/sf0.001"


def parts(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def survivors(rows):
    sets, root = [parts(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()), key=repr)


@pytest.mark.parametrize("block", [1024, 2])
def test_finds_every_pair(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng, rows = random.Random(5), [(900, ""), (901, None), (902, "one two"), (903, "One  two"), (904, "one three")]
    for k in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 60, 300]))]
        if k % 3 == 0:
            base = [f"line{i}" for i in range(30)] + base[:40]
        for c in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=repr)
    assert got == survivors(rows) and len(got) < len(rows) - 20


def test_pair_beyond_simhash_radius(spark):
    """Documents 6 and 145 or 1 and 177: similarity 0.83, one of them nine bits apart."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id in (1, 6, 145, 177)")
    texts = dict(docs.select("doc_id", "text").collect())
    bits = [(simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() for a, b in ((6, 145), (1, 177))]
    assert max(bits) > simhash.RADIUS
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == {1, 6}


def test_missing_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long), (None, f"{long} end"), (5, f"{long} more"), (5, "a text that nothing else is like")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect())) == sorted(rows[2:])


def test_sketches_rule_no_similar_pair_out():
    rng, sets = np.random.default_rng(3), []
    for n in (1, 7, 40, 300, 3000, 40_000):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        sets += [base, np.append(base[: max(1, n * 9 // 10)], rng.integers(0, 1 << 62, n // 12)), rng.integers(0, 1 << 62, n)]
    counts = np.stack([np.bincount(s & (near.SKETCH - 1), minlength=near.SKETCH) for s in sets])
    sketch = np.where(counts.max(1, keepdims=True) < 256, counts, 255).astype(np.uint8)
    i, j = map(np.array, zip(*itertools.combinations(range(len(sets)), 2)))
    ok = near._sketched(sketch, np.array([len(s) for s in sets]), i, j)
    alike = [5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert ok[np.array(alike)].all() and sum(alike) >= 5
    assert ok.sum() < len(i) // 2


def test_group_of_many_buckets_comes_once():
    """A group of 90 in 15 buckets: 90 different rows, not the 60075 pairs of all buckets."""
    m, buckets = 90, 15
    cls = np.tile(np.arange(m), buckets)
    sketch = pa.array([b"\x05" * near.SKETCH] * len(cls), pa.binary())
    cols = [np.repeat(np.arange(buckets), m), np.full(len(cls), 320 << 32), cls, cls]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), sketch], near.COMP)
    out = pa.Table.from_batches(near._groups(near.SKETCH)(iter([batch])))
    assert out.num_rows == m * buckets and out.group_by(near.MEMBER).aggregate([]).num_rows == m
    assert set(out["m"].to_pylist()) == {m}


def test_group_makes_no_pairs(spark, monkeypatch):
    """Of 120 texts that are almost similar, by twos similar: 2885 pairs that cells don't rule out,
    but no table of pairs has more than a few rows a text."""
    rng, rows, made = random.Random(11), [], []
    base = [f"w{i}" for i in range(300)]
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(10, 290), 4):
            text[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, f"end{k}"]))]
    keep = near.written

    def counted(df, tag):
        out = keep(df, tag)
        if out.columns == ["a", "b"]:
            made.append((out.count(), tag))
        return out

    monkeypatch.setattr(near, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=repr)
    assert got == survivors(rows) and len(got) <= len(rows) // 2
    assert made and max(made)[0] <= 8 * len(rows), made


@pytest.mark.parametrize("parts", [1, 3])
def test_forest_joins_what_all_links_join(spark, parts):
    """Sets of one cluster, whole and by pairs of three blocks, against all pairs: as far as links
    and common components reach, in fewer links than rows."""
    rng, sets = np.random.default_rng(7), []
    for n in (1, 5, 40, 700):
        for _ in range(5):
            base = np.unique(rng.integers(-(1 << 62), 1 << 62, n) * (256 if n == 700 else 1))  # 700 in one cell
            sets += [base, *(np.unique(np.append(base[rng.random(len(base)) < 0.93], rng.integers(0, 1 << 62, 1 + n // 40))) for _ in range(6))]
    m = len(sets)
    comp = np.where(rng.random(m) < 0.2, 5000 + rng.integers(0, 9, m), np.arange(m))

    def joined(links):
        root = np.arange(m)
        for i, j in [*links, *((i, j) for i, j in itertools.combinations(range(m), 2) if comp[i] == comp[j])]:
            root[root == root[j]] = root[i]
        return {frozenset(np.nonzero(root == r)[0].tolist()) for r in set(root.tolist())}

    similar = [(i, j) for i, j in itertools.combinations(range(m), 2) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    rows = [(0, len(s) << 32, k, int(comp[k]), s.tobytes()) for k, s in enumerate(sets)]
    df = near.by_blocks(spark.createDataFrame(rows, "s long, size long, cls long, comp long, set binary"), near.F.lit(parts))
    links = df.repartition(4, "s").sortWithinPartitions("s", "cls").mapInArrow(near._forest, near.PAIR).collect()
    assert {tuple(sorted(x)) for x in links} <= set(similar)
    assert joined(links) == joined(similar) and len(similar) > len(links) and len(links) < parts * m
    if parts == 1:
        a, b = near._spanning(np.arange(m), np.arange(m), [s.tobytes() for s in sets])
        assert len(a) < m and {tuple(sorted(x)) for x in zip(a, b)} <= set(similar)
