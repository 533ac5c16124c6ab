"""Every registered query against its SQL, at sf0.001."""

import duckdb
import pytest

from discloq import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr([same(v) for v in r]) for r in got.select(*columns).collect())
    its = sorted(repr([same(v) for v in r]) for r in want.select(*columns).fetchall())
    assert mine == its


def test_frozen_totals(spark):
    rows = {r["mode"]: (r["covered"], r["total"], r["coverage"]) for r in registry.QUERIES["mode_scores_ratio_of_sums"](spark, SF).collect()}
    assert rows == {"hybrid": (17, 42, 0.405), "bm25": (15, 42, 0.357), "vector": (14, 42, 0.333), "cover": (22, 42, 0.524)}
    verdicts = {r["mode"]: (r["correct"], r["partly"], r["wrong"]) for r in registry.QUERIES["verdict_rollup"](spark, SF).collect()}
    assert verdicts == {"cover": (2, 8, 0), "hybrid": (2, 8, 0), "bm25": (1, 7, 2), "vector": (2, 5, 3), "合计": (7, 28, 5)}
