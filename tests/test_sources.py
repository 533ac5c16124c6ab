"""Feeds, files, shards, settings and sectioning."""

import json
import re

import pytest
from pyspark.sql import functions as F

from discloq import dictionaries as D
from discloq.operators import sectioning
from discloq.sources import config, feeds, tables
from test_functions import pack


def test_feeds(spark):
    bodies = lambda *rows: spark.createDataFrame(rows, "code string, body string")
    inner = json.dumps([{"TITLE": "年報", "DATE_TIME": "31/03/2026 16:30", "FILE_LINK": "/x"}, {"TITLE": "b", "DATE_TIME": "bad"}])
    got = feeds.nested(bodies(("1", json.dumps({"result": inner})), ("2", "no json"), ("3", None))).collect()
    assert [(r["code"], r["title"], str(r["day"])) for r in got] == [("1", "年報", "2026-03-31"), ("1", "b", "None")]
    body = json.dumps({"announcements": [{"announcementTitle": "2025年<em>年度报告</em>", "announcementTime": 1774915200000, "adjunctUrl": "u"}]})
    got = feeds.platform(bodies(("1", body), ("2", '{"announcements": null}'))).collect()
    assert [(r["title"], str(r["day"])) for r in got] == [("2025年年度报告", "2026-03-31")]
    body = json.dumps({"data": [{"title": "年度报告", "publishTime": "2026-03-30 00:00:00", "attachPath": "p"}]})
    first = feeds.exchange(bodies(("1", body)))
    assert [str(r["day"]) for r in first.collect()] == ["2026-03-30"]
    targets = spark.createDataFrame([("1",), ("9",)], "code string")
    rows = {r["code"]: r for r in feeds.manifest(targets, first, "年度报告", "摘要").collect()}
    assert rows["1"]["ok"] and rows["1"]["link"] == "p" and not rows["9"]["ok"] and rows["9"]["note"] == "no match among 0"
    ids = spark.createDataFrame([("1", "gssz1")], "code string, issuer_id string")
    assert {r["code"]: r["issuer_id"] for r in feeds.with_issuer_id(targets, ids).collect()} == {"1": "gssz1", "9": None}


def test_files(spark, tmp_path):
    (tmp_path / "big.pdf").write_bytes(b"x" * 300)
    (tmp_path / "small.pdf").write_bytes(b"x")
    files = tables.binaries(spark, str(tmp_path), least=200)
    assert [(r["length"], len(r["sha1"])) for r in files.collect()] == [(300, 40)]
    (tmp_path / "m.json").write_text(json.dumps([{"code": "1", "file": files.first()["path"], "ok": True}, {"code": "2", "file": "gone", "ok": True}]))
    manifest = tables.read_json(spark, str(tmp_path / "m.json"), tables.MANIFEST)
    assert [r["code"] for r in tables.complete(manifest, files).collect()] == ["1"]
    tables.write_json(manifest, str(tmp_path / "out"))
    assert spark.read.schema(tables.MANIFEST).json(str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.json").write_text('[{"code": "1", "size_mb": "abc"}]')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST|malformed"):
        tables.read_json(spark, str(tmp_path / "bad.json"), tables.MANIFEST).collect()


def test_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    assert tables.shards(spark, path) is None
    tables.write_missing_shards(rows.filter("k = 1"), path, ["k", "h"])
    tables.write_missing_shards(rows, path, ["k", "h"])
    tables.write_missing_shards(rows.withColumn("h", F.when(F.col("k") == 1, "c").otherwise(F.col("h"))), path, ["k", "h"])
    assert sorted((r["k"], r["h"]) for r in tables.shards(spark, path).collect()) == [(1, "a"), (1, "c"), (2, "b")]


def test_page_blocks(spark):
    html = "<html><h1 class='t'>A <b>b</b></h1>\n<p>one\n two</p><p> </p><table><tr><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert [(r["tag"], r["text"]) for r in tables.page_blocks(pages).orderBy("ord").collect()] == [("h1", "A b"), ("p", "one two"), ("td", "x")]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# note\nexport A='x y'\nB = 2 # two\nC\n=3\nD=\"q\"\n")
    held = {"B": "own"}
    assert config.load_settings(tmp_path / ".env", held) == {"A": "x y", "B": "2", "D": "q"}
    assert held == {"A": "x y", "B": "own", "D": "q"}
    assert config.load_settings(tmp_path / "none", held) == {}


def chunked(blocks, titled):
    """A restatement: blocks (page, y, ord, text, is_table) of one report."""
    out, buf, state = [], [], {"sec": sectioning.UNNAMED, "no": 0, "sub": ""}

    def flush(table=False):
        text = "\n".join(t for _, t in buf).strip()
        if len(text) >= 12:
            for piece in [text] if table else pack_cn(text):
                out.append((state["sec"], state["no"], state["sub"], buf[0][0], buf[-1][0], table, piece))
        buf.clear()

    for page, y, _, text, table in sorted(blocks, key=lambda b: (b[0], round(b[1], 1), b[4], b[2])):
        if table:
            flush()
            buf.append((page, text))
            flush(True)
            continue
        m = re.match(sectioning.SECTION, text)
        number = "一二三四五六七八九十".index(m[1]) + 1 if m else 0
        if m and "...." not in text and number >= state["no"] and y < 260:
            flush()
            state.update(sec=text.strip(), no=number, sub="")
            continue
        bare = re.sub(r"\s", "", text)
        if titled and len(text) <= 30 and text[-1:] not in tuple("。，：") and y < 300 and any(bare.startswith(t) for t in D.SECTION_TITLES):
            flush()
            state.update(sec=text.strip(), sub="")
        if buf and re.match(sectioning.SUBSECTION, text) and len(text) < 45 and not text.endswith("。"):
            state["sub"] = text.strip()
        buf.append((page, text))
    flush()
    return out


def pack_cn(text):
    if len(text) <= 700:
        return [text]
    parts, buf = [], ""
    for s in re.split(r"(?<=[。！？；\n])", text):
        if buf and len(buf) + len(s) > 700:
            parts.append(buf)
            buf = buf[-100:] + s if len(buf) > 100 else s
        else:
            buf += s
        while len(buf) > 1100:
            parts.append(buf[:1100])
            buf = buf[1000:]
    return [p.strip() for p in [*parts, buf] if p.strip()]


@pytest.mark.parametrize("titled", [False, True])
def test_chunks_of_reports(spark, titled):
    long = "物流业务保持增长，收入结构持续优化。" * 80
    blocks = [
        (1, 50.0, 0, "第三节 管理层讨论 ........ 12", False), (1, 90.0, 1, "封面文字，内容足够长了吧。", False), (2, 40.0, 0, "第二节 公司简介", False), (2, 80.0, 1, "公司简介的正文，长度超过十二个字。", False),
        (2, 100.0, 2, "一、基本情况", False), (2, 120.0, 3, long, False), (2, 119.96, 4, "| a | b |\n|---|---|\n| 1 | 2 |", True), (3, 200.0, 0, "第一节 释义", False), (3, 210.0, 1, "财务摘要", False),
        (3, 220.0, 2, "摘要的正文也足够长，可以成块。", False), (3, 230.0, 3, "二、其他", False), (3, 400.0, 4, "第三节 页面下方不算标题", False), (4, 10.0, 0, "第三节 管理层讨论与分析", False), (4, 20.0, 1, "短", False), (5, 10.0, 0, "第四节 重要事项", False), (5, 30.0, 1, "重要事项的正文，同样足够长。", False),
    ]
    rows = spark.createDataFrame([("r", *b) for b in blocks] + [("empty", 1, 1.0, 0, None, None)], "report string, page int, y double, ord int, text string, is_table boolean")
    got = sectioning.chunk_reports(rows, F.lit(titled)).orderBy("chunk_id").collect()
    mine = [(r["section"], r["section_no"], r["subsection"], r["page_start"], r["page_end"], r["has_table"], r["text"]) for r in got]
    assert mine == chunked(blocks, titled)
    assert [r["chunk_id"] for r in got] == [f"r_{i + 1:04d}" for i in range(len(got))]
    assert pack("") == []
