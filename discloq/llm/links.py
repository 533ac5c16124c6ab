"""URL filters by link-graph propagation, in DataFrame operations only.

Rules decide the urls that they fit. For all others the host decides: trust spreads along host
edges from hosts that allow rules name, distrust spreads against them from hosts that block
rules name, and a host whose distrust exceeds its trust by the threshold is blocked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.common import join_hot, table
from discloq.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, THRESHOLD = 0.85, 0.5
#: Propagation ends when no score changes by more.
TOLERANCE = 1e-4
#: Steps that the SQL unrolls.
SQL_ROUNDS = 60
#: Rules are one expression, so their number is bounded.
MOST_RULES = 1000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)")).otherwise("")
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest fitting rule, else nulls; of equally long ones the
    first given."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, score): seed + damping * what comes along edges(a, b, share), from
    seeds(host, score), until no score changes by more than the tolerance. This is personalised
    PageRank divided by 1 - damping, so a seed counts 1 whatever the number of seeds.

    Only what changed moves on: each step's additions are written, and summed at the end.
    Hosts of very many edges are joined apart."""
    total = edges.count()
    degrees = written(edges.groupBy("a").agg(F.count("*").alias("n")), "degrees")
    steps = [seeds]
    while True:
        sent = steps[-1].withColumnRenamed("host", "a").join(degrees, "a")
        came = join_hot(edges, sent, "a", "n", total, "inner").groupBy(F.col("b").alias("host"))
        steps.append(written(came.agg(F.sum(F.col("share") * F.col("score") * damping).alias("score")), "rank"))
        most = steps[-1].agg(F.max("score")).first()[0]
        if most is None or most <= tolerance:
            return reduce(DataFrame.unionByName, steps).groupBy("host").agg(F.sum("score").alias("score"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url, html).

    A host's seed of trust (distrust) is the share of its rows that rules allow (block). Rows
    without a host and hosts without any score are allowed. Null html has no link; links to a
    page's own host don't count. Repeated rows count as often as they are there.
    """
    host, path = host_path(F.col("_url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url"), "html").select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = written(rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("_by")), "urls")
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("_n"), F.avg((F.coalesce("_by", F.lit("")) == "allow").cast("double")).alias("trust"),
        F.avg((F.coalesce("_by", F.lit("")) == "block").cast("double")).alias("distrust"), F.count(F.when(F.col("_by").isNull(), 1)).alias("_open"),
    )
    hosts = written(hosts, "hosts")
    links = rows.filter(F.col("html").contains("//")).select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("_to"))
    links = links.select(F.col("host").alias("a"), F.translate("_to", UPPER, LOWER).alias("b")).filter("a != b and a != ''").groupBy("a", "b").agg(F.count("*").alias("n"))
    links = written(links, "host-edges")
    scores = hosts.select("host", "trust", "distrust")
    if not links.isEmpty():
        total = links.count()
        share = (F.col("n") / F.col("t")).alias("share")

        def shared(end: str) -> DataFrame:
            sums = written(links.groupBy(end).agg(F.sum("n").alias("t"), F.count("*").alias("m")), "host-sums")
            return join_hot(links, sums, end, "m", total, "inner")

        ahead = written(shared("a").select("a", "b", share), "ahead")
        back = written(shared("b").select(F.col("b").alias("a"), F.col("a").alias("b"), share), "back")
        trust = spread(hosts.filter("trust > 0").select("host", F.col("trust").alias("score")), ahead, damping, tolerance)
        distrust = spread(hosts.filter("distrust > 0").select("host", F.col("distrust").alias("score")), back, damping, tolerance)
        scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        scores = scores.fillna(0.0, ["trust", "distrust"])
    bad = F.when((F.col("host") != "") & (F.col("distrust") - F.col("trust") >= threshold), "block").otherwise("allow")
    by_host = hosts.select("host", "_open").join(scores.select("host", bad.alias("_host_says")), "host")
    total = hosts.agg(F.sum("_open")).first()[0] or 0
    fixed = judged.filter("_by is not null").select("page_id", "host", "path", "rule", F.col("_by").alias("verdict"))
    free = join_hot(judged.filter("_by is null"), by_host, "host", "_open", total)
    return fixed.unionByName(free.select("page_id", "host", "path", "rule", F.coalesce("_host_says", F.lit("allow")).alias("verdict")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def sql(rules=RULES, damping: float = DAMPING, rounds: int = SQL_ROUNDS, threshold: float = THRESHOLD) -> str:
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, k) for k, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule = " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits)
    by = " ".join(f"WHEN {f} THEN '{k}'" for f, _, k in fits)
    steps = []
    for kind, edges in (("trust", "ahead"), ("distrust", "back")):
        steps.append(f"{kind}0 AS (SELECT host, {kind} AS score FROM hosts WHERE {kind} > 0)")
        for k in range(1, rounds + 1):
            steps.append(
                f"{kind}{k} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {kind}0 UNION ALL "
                f"SELECT e.b, sum(e.share * s.score * {damping}) FROM {edges} e JOIN {kind}{k - 1} s ON e.a = s.host GROUP BY e.b) GROUP BY host)"
            )
    link = LINK.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
v AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM u),
w AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM v),
j AS (SELECT *, CASE {rule} END AS rule, CASE {by} END AS by_rule FROM w),
hosts AS (SELECT host, avg(CASE WHEN by_rule = 'allow' THEN 1.0 ELSE 0.0 END) AS trust,
                 avg(CASE WHEN by_rule = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j GROUP BY host),
found AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS b FROM j),
links AS (SELECT a, b, count(*) AS n FROM found WHERE a <> b AND a <> '' GROUP BY a, b),
ahead AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM links),
back AS (SELECT b AS a, a AS b, n / sum(n) OVER (PARTITION BY b) AS share FROM links),
{", ".join(steps)},
says AS (SELECT h.host, CASE WHEN h.host <> '' AND coalesce(d.score, 0) - coalesce(t.score, 0) >= {threshold} THEN 'block' ELSE 'allow' END AS verdict
         FROM hosts h LEFT JOIN trust{rounds} t ON h.host = t.host LEFT JOIN distrust{rounds} d ON h.host = d.host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.by_rule, s.verdict) AS verdict FROM j JOIN says s ON j.host = s.host
"""
