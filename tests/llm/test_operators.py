"""The corpus operators on small fixtures: brute force, round trips, edge cases."""

import gzip
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from discloq.llm import contamination, exact, language, links, packing, queries, simhash, suffixes, tokens, toxicity, warc
from discloq.llm.common import components, join_hot

SF = "/root/testdata/sf0.001"
COPY = "the quick brown fox jumps over the lazy dog near the river bank at noon today. "
EDGES = [
    (1, COPY + "first tail of the text"), (2, COPY.upper() + " x"), (3, None), (4, ""), (5, " \t\n"), (6, "a"), (7, "zz " + COPY), (8, "zz " + COPY), (8, "zz " + COPY),
    (9, COPY + "first  tail of the text"), (10, "é ü 你好 " * 30), (11, "ab" * 3000), (12, "%%% 123 *** 456"), (None, COPY + "null"), (None, None), (13, "word " * 4000), (14, "<|endoftext|> a  b\n\n c <|endoftext|>"),
]


def table(spark, rows=EDGES, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.lit("s"))
    # columns with names that operators use
    return df.withColumn("kept", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("_sha", F.lit("x")) if extra.get("clash") else df


def all_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(exact.SQL)
    got = queries.QUERIES["op3_exact_dedup"](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_exact_dedup_edges(spark):
    df = table(spark).withColumn("kept", F.lit("mine"))
    got = exact.exact_dedup(df).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["keep_id"] for k in (3, 4, 5, None) for r in by[k] if not (r["text"] or "").strip()} == {5}  # most code points
    assert by[9][0]["kept"] and not by[1][0]["kept"] and by[1][0]["keep_id"] == 9
    assert by[7][0]["keep_id"] == 7 and [r["kept"] for r in by[8]] == [False, False] and by[7][0]["group_size"] == 3
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact, "MOST_BITS", 64)  # every row is possibly repeated
    few = {tuple(r) for r in exact.exact_dedup(all_docs(spark), carry=False).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in exact.exact_dedup(all_docs(spark), carry=False).collect()}


def test_token_counts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hard = ["a  b", " a b ", "a \n b", " x y", "it's  we'll", "x  y", "\x1c a", "a\tb c", "<|endoftext|>", "a <|endoftext|> b", "é" * 99 + " z"]
    rows = [(i, x) for i, x in enumerate(hard)] + EDGES + [(r["doc_id"], r["text"]) for r in all_docs(spark).collect()]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for r, (d, x) in zip(got, rows):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert tuple(r) == (d, len((x or "").encode()), n, n > 1024), x


def test_remembered_gives_all_pieces_when_full():
    seen = tokens.Remembered(lambda words: [len(w) for w in words], keep=3, spare=2)
    for batch in ({"a", "bb"}, {"bb", "ccc", "d" * 99}, {"e", "ff", "ggg"}, {"a", "e", "hh", "i"}, set(), {"e", "a"}):
        assert seen.table(batch) == {w: len(w) for w in batch}
    assert "d" * 99 not in seen.known


def test_packing(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(r["doc_id"], r["text"]) for r in all_docs(spark).collect()] + [(900 + i, x) for i, (_, x) in enumerate(EDGES)] + [(990, "Á B <|ENDOFTEXT|> <|endoftext|> it's ΣΑΣ")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {}
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[d, k] = (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 2048 + 2
    assert packing.pack_documents(table(spark).limit(0)).count() == 0


def test_best_fit_takes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(x) for x in (6, 5, 4, 5, 9, 8, 2)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (3, 0), (3, 8)]


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(x) for _, x in rows]
    low = [d if d is not None else 1 << 60 for d, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return {(d, f"{f:016x}", None if c == 1 << 60 else c) for (d, _), f, c in zip(rows, fps, low)}


@pytest.mark.parametrize("most", [4096, 8])
def test_simhash(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BUCKET", most)
    monkeypatch.setattr(simhash.links, "__defaults__", (4, most))
    words = [f"w{i % 97}x{i * i % 89}" for i in range(400)]
    near = [(100 + k, " ".join(words[:k] + ["changed"] + words[k:])) for k in range(1, 25)]
    rows = EDGES + near + [(r["doc_id"] + 1000, r["text"]) for r in all_docs(spark).limit(60).collect()]
    got = {tuple(r) for r in simhash.near_dups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_components(rows)


def test_covering_masks():
    ms = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(bits & m == 0 for m in ms)


@pytest.mark.parametrize("few", [1 << 18, 0])  # with 0, hot nodes are joined apart
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("discloq.llm.common.FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_join_hot(spark):
    rows = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k long, v long")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    assert join_hot(rows, sizes, "k", "n", 1000).count() == 1000
    assert join_hot(rows, sizes.filter("k < 950"), "k", "n", 1000, "inner").count() == 950


@pytest.mark.parametrize("hot,sizes", [(100_000, {}), (2, {"range_bytes": 999}), (100_000, {"range_bytes": 5000, "FLUSH": 1, "PART": 3000, "MOST_TASKS": 3}), (3, {"FLUSH": 1, "PART": 1})])
def test_suffix_dedup(spark, monkeypatch, hot, sizes):
    """Whatever the number of ranges, tasks, chunks and blobs."""
    for name in sizes.keys() - {"range_bytes"}:
        monkeypatch.setattr(suffixes, name, sizes[name])
    sizes = {k: v for k, v in sizes.items() if k == "range_bytes"}
    rows = EDGES + [(r["doc_id"] + 1000, r["text"]) for r in all_docs(spark).limit(80).collect()]
    rows = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first, want = {}, []
    for d, x in sorted(rows, key=lambda r: r[0]):
        b = (x or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    for d, x in rows:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, suffixes.remove_repeats(df, hot_docs=hot, **sizes).collect())) == sorted(want)


def test_suffix_dedup_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 64)
    texts = [b"0123456789" * 3 + COPY.encode() * 2, b"x" * 37 + COPY.encode()]
    found = [set(), set()]
    for joined, starts, owner, offset in suffixes.parts_of(texts):
        h, place, first, count, doc, _ = suffixes.anchors(joined, starts)
        for f, c, d in zip(first, count, doc):
            found[owner[d]] |= set(range(f - starts[d] + offset[d], f - starts[d] + offset[d] + c))
    assert found == [set(range(len(t) - 49)) for t in texts]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 7, 10, 50, 200):
        for k in (1, 2, 4, 200):
            s = rng.integers(1, k + 1, n)
            assert suffixes.suffix_order(s).tolist() == sorted(range(n), key=lambda i: tuple(s[i:]))


def test_suffix_dedup_null_ids_and_empty(spark):
    df = table(spark, [(None, COPY), (None, COPY + "more"), (5, COPY)])
    got = sorted(r["n_removed"] for r in suffixes.remove_repeats(df).collect())
    assert got[0] == 0 and got[1:] == [len(COPY), len(COPY)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_contamination(spark):
    item = "An item of the benchmark that asks: which river is the longest, and why? It has some more words so that edits fit."
    docs = [(1, "before. " + item + " after"), (2, item.replace("longest", "lonest").upper()), (3, COPY * 20), (4, None), (5, ""), (6, "x " * 5000 + item + " y" * 5000), (None, item), (7, item[:40])]
    items = spark.createDataFrame([(10, item), (11, None), (12, "short"), (13, "unrelated text of some length that no document has at all")], "item_id long, text string")
    df = table(spark, docs)
    for block in (8_000_000, 100):  # the second takes several scans
        got = contamination.find_passages(df, items, block=block).collect()
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(1, 10, 0), (2, 10, 1), (6, 10, 0), (None, 10, 0)}
    text = dict(docs)
    for r in got:
        if r["doc_id"] in (1, 6):
            assert text[r["doc_id"]].encode()[r["start_byte"] : r["end_byte"]].decode() == item[:-1]
    assert contamination.find_passages(df, items.limit(0)).count() == 0 == contamination.find_passages(df.limit(0), items).count()


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(30):
        item, text = rng.integers(97, 100, 20).astype(np.uint8), rng.integers(97, 100, 45).astype(np.uint8)
        cost = np.zeros(46, int)
        for i, c in enumerate(item):
            new = np.empty(46, int)
            new[0] = i + 1
            for j in range(45):
                new[j + 1] = min(cost[j] + (c != text[j]), cost[j + 1] + 1, new[j] + 1)
            cost = new
        got = contamination.align(item, text, -25, 50, 20)
        assert got[0] == cost.min() and cost[got[2]] == got[0]


def test_urls(spark):
    pages = [(1, "http://A.Example.com/en/x", None), (2, "https://www.example.com/en/", ""), (3, None, None), (4, "nope", "x"), (5, "http://h.net/fr/1", ""), (6, "http://h.net/fr/2", ""), (7, "http://h.net/x", ""),
             (8, "http://e.org?q", '<a href="http://h.net/z">'), (9, "http://com/#a", ""), (10, "ftp://b.com/x?y", '<a class=x href=//e.org/>'), (11, "http://h.net/fr/1", ""), (12, "http://k.net/fr/a", ""), (13, "http://k.net/q", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in links.judge_urls(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][3] == "block" and got[13] == ("k.net", "/q", None, "block")
    # trust from b.com reaches e.org, and h.net through it: 0.75 - 0.85 * 0.85 is below the threshold
    assert got[8] == ("e.org", "", None, "allow") and got[7] == ("h.net", "/x", None, "allow")
    con = duckdb.connect()
    con.register("p", df.toPandas())
    con.sql("CREATE VIEW pages AS SELECT * FROM p")
    want = {r[0]: r[1:] for r in con.sql(links.sql()).fetchall()}
    assert want == got
    assert links.judge_urls(df.limit(0)).count() == 0


def test_distrust_reaches_far_and_hubs(spark):
    """Four chains of eleven links to blocked hosts: 4 * 0.85 ** 11 = 0.67; a hub of many links."""
    pages, n = [], 0
    for c in range(4):
        names = ["far.org", *(f"h{c}x{k}.org" for k in range(10)), f"b{c}.net"]
        for a, b in zip(names, names[1:]):
            pages.append((n := n + 1, f"http://{a}/", f'<a href="http://{b}/">'))
        pages.append((n := n + 1, f"http://b{c}.net/fr/", ""))
    pages.append((n := n + 1, "http://hub.org/", "".join(f'<a href="http://t{k}.org/">' for k in range(300))))
    pages.append((n := n + 1, "http://t7.org/", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in links.judge_urls(df).filter("rule is null").collect()}
    assert got["far.org"] == "block" and got["hub.org"] == got["t7.org"] == "allow"


def test_archive_folder_without_scheme(spark):
    assert warc.located(spark, "hdfs://n/x") == "hdfs://n/x" and warc.located(spark, "file:/x") == "file:/x"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert warc.located(spark, "/a/b") == "file:///a/b"
        conf.set("fs.defaultFS", "hdfs://name:8020")
        assert warc.located(spark, "/a/b") == "hdfs://name:8020/a/b"
    finally:
        conf.set("fs.defaultFS", before)


def test_warc(spark, tmp_path):
    pages = [(5, "http://a/\n b", "x" * 200), (3, None, "x" * 200), (4, "http://c", "y" * 99), (2, "http://d", "y" * 99), (1, "http://e", None), (9, "u", "é" * 120), (9, "u", "é" * 120), (None, "n", "x" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for run in ("a", "b"):
        entries = warc.write_archives(df, f"file://{tmp_path}/{run}", roll_bytes=600, tasks=2)
    assert len(entries) > 2 and sum(e["records"] for e in entries) == len(pages)
    for e in entries:  # the same bytes each time, and nothing temporary is left
        assert (tmp_path / "a" / e["file"]).read_bytes() == (tmp_path / "b" / e["file"]).read_bytes()
    assert len(list((tmp_path / "a").iterdir())) >= len(entries) + 1 and not list((tmp_path / "a").glob("*.tmp"))
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 9) == [(-1, 200, "revisit", 3), (1, 0, "response", None), (2, 99, "response", None), (3, 200, "response", None), (4, 99, "response", None), (5, 200, "revisit", 3)]
    assert [r["html"] for r in got if r["page_id"] == 9] == ["é" * 120] * 2
    assert all(r["payload_digest"] == hashlib.sha256((dict((p, h) for p, _, h in pages)[r["page_id"]] or "").encode()).hexdigest() for r in got)
    path = next((tmp_path / "a").glob("*.warc.gz"))
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")
    assert warc.write_archives(df.limit(0), f"file://{tmp_path}/c") == [] and warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0


def test_toxicity_learns_and_handles_edges(spark):
    rng = np.random.default_rng(3)
    words = ["river", "house", "tree", "morning", "water", "stone", "green", "light", "small", "road"]
    text = lambda bad, n: " ".join([*rng.choice(words, n // 2), *(["idiot"] if bad else []), *rng.choice(words, n // 2)])
    y = np.arange(300) % 2
    model = toxicity.fit([text(b, 60) for b in y], y)
    assert (model.score([text(1, 2000), text(1, 4)]) > 0.5).all() and (model.score([text(0, 2000), text(0, 4), ""]) < 0.3).all()
    got = toxicity.score_documents(table(spark), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert toxicity.fit([], np.array([])).score(["x"])[0] < 0.3 < toxicity.fit(["x"], np.array([1])).score(["y"])[0]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.train(*language.training_rows(docs))
    got = language.predict_documents(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    edges = language.predict_documents(table(spark, clash=True), net, keep=("doc_id", "text", "kept", "score")).collect()
    assert {r["lang_pred"] for r in edges if r["doc_id"] in (3, 4, 5, 12)} == {"und"} and len(edges) == len(EDGES)
    assert language.predict_documents(table(spark).limit(0), net).count() == 0
    assert language.train([], []).predict(["abc"])[0] == ["und"]
