"""Registered queries over the driver's tables, each with its SQL.

``documents`` stands for chunks (``source`` is the company, ``lang`` the report kind),
``benchmark`` for questions, ``conversations`` for ordered blocks, ``orders`` for announcements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from discloq import dictionaries as D
from discloq.functions import text as X
from discloq.operators import answers, chunking, evaluation, ingest, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("company"), F.col("lang").alias("kind"), "n_chars")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


_STOP = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
_KEEP = f"term NOT IN ({_STOP}) AND (length(term) > 1 OR regexp_matches(term, '^[0-9a-z]$')) AND NOT regexp_matches(term, '^[0-9]{{9,}}$')"
_TOKENS = "lower(unnest(regexp_extract_all({text}, '[0-9][0-9,.]*%?|[\\p{{L}}]+')))"
_POSTS = f"""
raw AS (SELECT doc_id, {_TOKENS.format(text='text')} AS term FROM documents),
posts AS (SELECT doc_id, term, count(*) AS tf FROM raw WHERE {_KEEP} GROUP BY ALL)"""
_BM25 = f"""{_POSTS},
stat AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
len AS (SELECT doc_id, sum(tf) AS len FROM posts GROUP BY doc_id),
one AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM posts) AS total),
qraw AS (SELECT item_id AS qid, {_TOKENS.format(text='text')} AS term FROM benchmark),
qterm AS (SELECT qid, term, count(*) AS qtf FROM qraw WHERE {_KEEP} GROUP BY ALL),
w AS (SELECT p.doc_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (total / n))) AS w
      FROM posts p JOIN stat USING (term) JOIN len USING (doc_id) CROSS JOIN one),
sc AS (SELECT qid, doc_id, round(sum(w * qtf), 9) AS s FROM w JOIN qterm USING (term) GROUP BY ALL),
lex AS (SELECT qid, doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS r FROM sc QUALIFY r <= 200)"""
_VEC = """
qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT qid, vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], v), 9) AS s FROM embeddings CROSS JOIN qv),
vec AS (SELECT qid, doc_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS r FROM vs QUALIFY r <= 200)"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(chunks(spark, sf_dir), questions(spark, sf_dir))


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    wanted = questions(spark, sf_dir).join(vectors, F.col("qid") == F.col("doc_id")).select("qid", F.col("embedding").alias("vector"))
    return retrieval.vector_search(vectors, wanted, "doc_id")


@query(f"WITH {_POSTS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM posts GROUP BY term")
def tok_df(spark, sf_dir):
    return retrieval.postings(chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH {_BM25} SELECT qid, doc_id, round(s, 6) AS score, r::INTEGER AS rank FROM lex WHERE r <= 20")
def bm25_topk(spark, sf_dir):
    return lexical(spark, sf_dir).filter("rank_bm25 <= 20").select("qid", "doc_id", F.round("score_bm25", 6).alias("score"), F.col("rank_bm25").alias("rank"))


@query(f"WITH {_VEC} SELECT qid, doc_id, round(s, 6) AS score, r::INTEGER AS rank FROM vec WHERE r <= 20")
def vector_topk(spark, sf_dir):
    return vector(spark, sf_dir).filter("rank_vector <= 20").select("qid", "doc_id", F.round("score_vector", 6).alias("score"), F.col("rank_vector").alias("rank"))


_HYBRID = f"""{_BM25}, {_VEC},
f AS (SELECT qid, doc_id, l.r AS rl, v.r AS rv, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + v.r), 0), 6) AS score
      FROM lex l FULL JOIN vec v USING (qid, doc_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rl NULLS LAST, rv NULLS LAST, doc_id) AS rank FROM f QUALIFY rank <= 20)"""


@query(f"WITH {_HYBRID} SELECT qid, doc_id, score, coalesce(rl, 0)::INTEGER AS rank_bm25, coalesce(rv, 0)::INTEGER AS rank_vector, rank::INTEGER AS rank, concat_ws('+', CASE WHEN rl IS NOT NULL THEN 'bm25' END, CASE WHEN rv IS NOT NULL THEN 'vector' END) AS retriever FROM h")
def hybrid_search(spark, sf_dir):
    return retrieval.fuse(lexical(spark, sf_dir), vector(spark, sf_dir), "doc_id", 20).select("qid", "doc_id", "score", F.coalesce("rank_bm25", F.lit(0)).alias("rank_bm25"), F.coalesce("rank_vector", F.lit(0)).alias("rank_vector"), "rank", "retriever")


_COVER = f"""{_BM25}, c AS (SELECT qid, l.doc_id, source AS company, r, row_number() OVER (PARTITION BY qid, source ORDER BY r, l.doc_id) AS t FROM lex l JOIN documents d ON d.doc_id = l.doc_id),
a AS (SELECT qid, doc_id, company, r, CASE WHEN t <= 1 THEN 0 ELSE 1 END AS part, CASE WHEN t <= 1 THEN t ELSE r END AS turn FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, turn, CASE WHEN part = 0 THEN company END, doc_id) AS place FROM a)"""


@query(f"WITH {_COVER} SELECT qid, doc_id, company, place::INTEGER AS place, CASE WHEN part = 0 THEN company END AS cover_group FROM p WHERE place <= 20")
def cover_quota_roundrobin(spark, sf_dir):
    hits = lexical(spark, sf_dir).join(chunks(spark, sf_dir).select("doc_id", "company"), "doc_id")
    return retrieval.cover(hits, 20, 20).select("qid", "doc_id", "company", "place", "cover_group")


@query(f"WITH {_COVER} SELECT qid, sum(part)::BIGINT AS backfilled, count(*) AS hits FROM p WHERE place <= 30 GROUP BY qid")
def cover_backfill(spark, sf_dir):
    hits = lexical(spark, sf_dir).join(chunks(spark, sf_dir).select("doc_id", "company"), "doc_id")
    return retrieval.cover(hits, 30, 30).groupBy("qid").agg(F.count(F.when(F.col("cover_group").isNull(), 1)).alias("backfilled"), F.count("*").alias("hits"))


@query("SELECT doc_id, source AS company, lang AS kind FROM documents WHERE source IN ('src1', 'src5') AND lang IN ('en', 'de') AND (contains(text, 'the') OR contains(text, 'und'))")
def meta_mask_filter(spark, sf_dir):
    found = retrieval.metadata_filter(chunks(spark, sf_dir).withColumn("section", F.col("text")), companies=("src1", "src5"), kinds=("en", "de"), sections=("the", "und"))
    return found.select("doc_id", "company", "kind")


_LINES = "lines AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"


def doc_lines(spark, sf_dir):
    split = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("_p", "line"))
    return split.select("doc_id", "source", F.trim("line").alias("line"), (F.col("_p") + 1).alias("ord"))


@query(f"""WITH {_LINES}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM lines GROUP BY source)
SELECT source, line, count(DISTINCT doc_id) AS n_pages FROM lines WHERE length(line) < 90 GROUP BY source, line
HAVING count(DISTINCT doc_id) >= greatest(3, 0.05 * (SELECT pages FROM n WHERE n.source = lines.source))""")
def boilerplate_lines(spark, sf_dir):
    return chunking.boilerplate(doc_lines(spark, sf_dir), "source", "doc_id", share=0.05)


@query(f"""WITH {_LINES}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM lines GROUP BY source),
bad AS (SELECT source, line FROM lines JOIN n USING (source) WHERE length(line) < 90 GROUP BY source, line, pages HAVING count(DISTINCT doc_id) >= greatest(3, 0.25 * pages))
SELECT doc_id, min(ord)::INTEGER AS ord, length(line) AS n_chars FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^[-—\\s]*\\d{{1,4}}[-—\\s]*$')
AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = lines.source AND bad.line = lines.line) GROUP BY doc_id, line""")
def dedupe_first_line(spark, sf_dir):
    return chunking.clean_lines(doc_lines(spark, sf_dir), "source", "doc_id").select("doc_id", "ord", F.length("line").cast("long").alias("n_chars"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(trim(text, ' ')) >= 12")
def short_chunk_filter(spark, sf_dir):
    return chunks(spark, sf_dir).filter(F.length(F.trim("text")) >= 12).select("doc_id", "n_chars")


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format(text='text')} AS term FROM documents) SELECT doc_id, count(*) AS n_all, count(*) FILTER (WHERE {_KEEP}) AS n_kept FROM t GROUP BY doc_id")
def stopword_filter(spark, sf_dir):
    both = chunks(spark, sf_dir).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(f"({X.TOKEN})"), F.lit(1))).cast("long").alias("n_all"), F.size(X.tokens(F.col("text"))).cast("long").alias("n_kept"))
    return both.filter("n_all > 0")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
FROM orders WHERE regexp_matches(o_orderpriority, '[1-3]-') AND NOT regexp_matches(o_orderpriority, 'MEDIUM|LOW')) WHERE n = 1""")
def title_include_exclude_latest(spark, sf_dir):
    return ingest.latest_matching(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", "[1-3]-", "MEDIUM|LOW", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def manifest_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return ingest.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def missing_targets_anti(spark, sf_dir):
    done = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return ingest.missing(read(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query("""SELECT c_custkey, o.k IS NOT NULL AS ok, coalesce(o.k, -1) AS picked, CASE WHEN o.k IS NULL THEN 'no match among ' || coalesce(s.n, 0) END AS note FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey""")
def failed_record_capture(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    picked = orders.filter("o_orderpriority = '1-URGENT'").groupBy("c_custkey").agg(F.max("o_orderkey").alias("picked"))
    seen = orders.groupBy("c_custkey").agg(F.count("*").alias("n_seen"))
    return ingest.with_failures(read(spark, sf_dir, "customer").select("c_custkey"), picked, ["c_custkey"], seen).select("c_custkey", "ok", F.coalesce("picked", F.lit(-1)).alias("picked"), "note")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE contains(text, '|')) AS n_tables, count(DISTINCT source) AS companies, round(avg(n_chars), 1) AS mean_chars,
median(n_chars) AS median_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars, sum(n_chars)::BIGINT AS total_chars FROM documents""")
def corpus_stats_median(spark, sf_dir):
    return chunks(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("text").contains("|"), 1)).alias("n_tables"), F.countDistinct("company").alias("companies"), F.round(F.avg("n_chars"), 1).alias("mean_chars"),
        F.median("n_chars").alias("median_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.sum("n_chars").alias("total_chars"),
    )


@query("SELECT kind, company, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, company)::INTEGER AS place FROM (SELECT lang AS kind, source AS company, count(*) AS n FROM documents GROUP BY ALL)")
def kind_histogram(spark, sf_dir):
    n = chunks(spark, sf_dir).groupBy("kind", "company").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "company")))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS section FROM conversations")
def section_forward_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return chunking.forward_fill(rows, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", F.coalesce("section", F.lit(-1)).alias("section"))


@query("""WITH c AS (SELECT *, CASE WHEN role = 'user' THEN length(text) % 7 END AS no FROM conversations),
b AS (SELECT *, max(no) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT conv_id, turn, coalesce(last_value(CASE WHEN best IS NULL OR no >= best THEN no END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1)::INTEGER AS section FROM b""")
def section_monotone_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("no", F.when(F.col("role") == "user", F.length("text") % 7))
    return chunking.forward_fill(rows, "conv_id", ["turn"], F.col("no"), F.col("no")).select("conv_id", "turn", F.coalesce("section", F.lit(-1)).alias("section"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations)
SELECT conv_id, island::BIGINT AS island, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS n_chars, string_agg(role, '>' ORDER BY turn) AS roles FROM i GROUP BY ALL""")
def gaps_islands_buffers(spark, sf_dir):
    runs = chunking.islands(read(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return runs.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text").cast("long")).alias("n_chars"), roles.alias("roles"))


@query("SELECT doc_id, format('{}_{}_{:04d}', source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)) AS chunk_id FROM documents")
def chunk_seq_id(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("company", "kind").orderBy("doc_id"))
    return chunks(spark, sf_dir).select("doc_id", F.format_string("%s_%s_%04d", "company", "kind", n).alias("chunk_id"))


@query("SELECT doc_id, concat_ws('·', source, lang, 'P' || (doc_id % 90 + 1) || '页') AS cite, source AS company FROM documents")
def cite_string(spark, sf_dir):
    cite = F.concat_ws("·", "company", "kind", F.concat(F.lit("P"), (F.col("doc_id") % 90 + 1).cast("string"), F.lit("页")))
    return chunks(spark, sf_dir).select("doc_id", cite.alias("cite"), X.cited_company(cite).alias("company"))


@query("SELECT item_id, regexp_replace(text, '[\\s,，、　 ]', '', 'g') AS norm, substr(regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g'), 1, 24) AS key FROM benchmark")
def norm_number_text(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.norm_number(F.col("text")).alias("norm"), X.dedupe_key(F.col("text")).alias("key"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM pages""")
def html_strip_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_markup(F.col("html")).alias("text"))


# the texts have no 。, so each ". " is made one
_SENT = """s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS si, trim(unnest(l), ' ' || chr(10) || chr(9) || chr(13)) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(replace(text, '. ', '。'), '([。！？])', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents))"""


@query(f"WITH {_SENT} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS n_chars FROM s WHERE length(sentence) >= 6 GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    s = chunks(spark, sf_dir).select("doc_id", F.explode(X.sentences(F.replace("text", F.lit(". "), F.lit("。")))).alias("s")).select("doc_id", F.regexp_replace("s", r"^[ \n\t\r]+|[ \n\t\r]+$", "").alias("s"))
    return s.filter(F.length("s") >= 6).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s").cast("long")).alias("n_chars"))


def answer_candidates(spark, sf_dir):
    hits = lexical(spark, sf_dir).filter("rank_bm25 <= 8").select("qid", "doc_id", (F.col("rank_bm25") - 1).alias("ci")).join(chunks(spark, sf_dir).select("doc_id", "text", "company"), "doc_id")
    terms = questions(spark, sf_dir).select("qid", F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    # the texts have no 。, so sentences end at .!? too
    return answers.candidates(hits.join(terms, "qid"), F.col("terms"), F.lit(False), F.array().cast("array<string>"), latin=True)


_CAND = f"""{_BM25},
hits AS (SELECT qid, doc_id, source AS company, text, r - 1 AS ci FROM lex JOIN documents USING (doc_id) WHERE r <= 8),
un AS (SELECT qid, doc_id, company, ci, list_filter(string_split(regexp_replace(regexp_replace(text, '([。！？])', '\\1' || chr(1), 'g'), '([.!?])(\\s|\\z)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: trim(z, ' ') <> '') AS l FROM hits),
ex AS (SELECT qid, doc_id, company, ci, generate_subscripts(l, 1) - 1 AS si, trim(unnest(l), ' ' || chr(10) || chr(9) || chr(13)) AS sentence FROM un),
tk AS (SELECT DISTINCT qid, ci, si, {_TOKENS.format(text='sentence')} AS term FROM ex WHERE length(sentence) >= 6),
ov AS (SELECT t.qid, ci, si, count(*) AS n, count(q.term) AS o FROM tk t LEFT JOIN qterm q ON q.qid = t.qid AND q.term = t.term WHERE {_KEEP.replace('term ', 't.term ').replace('(term', '(t.term')} GROUP BY ALL),
cand AS (SELECT e.qid, e.company, e.ci, e.si, e.sentence, substr(regexp_replace(sentence, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 1, 24) AS key,
         round(o / sqrt(n) + 0.25::DOUBLE / (1 + si) + 0.3::DOUBLE / (1 + ci) - CASE WHEN regexp_matches(sentence, '(：|:|如下)$') THEN 0.45::DOUBLE ELSE 0 END, 9) AS score
         FROM ex e JOIN ov USING (qid, ci, si) WHERE o > 0)"""


@query(f"""WITH {_CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, ci, si) AS n1 FROM cand),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ci, si) AS place FROM k WHERE n1 = 1)
SELECT qid, place::INTEGER AS place, sentence, round(score, 6) AS score, dense_rank() OVER (PARTITION BY qid ORDER BY ci)::INTEGER AS n FROM b WHERE place <= 6""")
def sentence_score_top6(spark, sf_dir):
    return answers.renumbered(answers.best(answer_candidates(spark, sf_dir))).select("qid", "place", "sentence", F.round("score", 6).alias("score"), "n")


@query(f"""WITH {_CAND}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, company ORDER BY score DESC, ci, si) AS turn, max(score) OVER (PARTITION BY qid, company) AS top FROM cand),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY turn, top DESC, company, ci, si) AS n1 FROM t WHERE turn <= 6),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, top DESC, company, ci, si) AS place FROM k WHERE n1 = 1)
SELECT qid, place::INTEGER AS place, company, sentence FROM b WHERE place <= 6""")
def sentence_roundrobin_by_company(spark, sf_dir):
    return answers.in_turns(answer_candidates(spark, sf_dir), "company").select("qid", "place", "company", "sentence")


# fixed questions for the functions that need the domain's words
_ASKED = ("顺丰控股和圆通速递的单票收入是多少？", "韵达的市占率与业务量", "京东物流毛利率 如何", "中外运 归母净利润")
_VALUES = ", ".join(f"('{q}')" for q in _ASKED)


_NAMED = (*_ASKED, "ROE顺丰EPS", "、顺丰控股。", "没有公司名的问题？")


def asked(spark, rows=_ASKED):
    return spark.createDataFrame([(q,) for q in rows], "q string")


def _list(items, test):
    return "list_filter([" + ", ".join(f"CASE WHEN {test(w)} THEN '{w}' END" for w in items) + "], lambda z: z IS NOT NULL)"


_EXPAND = " || ".join(f"CASE WHEN {' OR '.join(f'''contains(q, '{w}')''' for w in g)} THEN {_list(g, lambda w: f'''NOT contains(q, '{w}')''')} ELSE [] END" for g in D.SYNONYMS)


@query(f"SELECT q, array_to_string({_EXPAND}, '|') AS extra FROM (VALUES {_VALUES}) t(q)")
def synonym_expand(spark, sf_dir):
    return asked(spark).select("q", F.array_join(X.expand_synonyms(F.col("q")), "|").alias("extra"))


_STRIPPED = "q"
for _n, _a in D.ALIASES.items():
    _STRIPPED = f"replace(replace({_STRIPPED}, '{_n}', ' '), '{_a}', ' ')"


@query(f"""SELECT q, array_to_string({_list(D.ALIASES, lambda n: f"contains(q, '{n}') OR contains(q, '{D.ALIASES[n]}')")}, '|') AS companies,
coalesce(nullif(trim(regexp_replace({_STRIPPED}, '[\\s　 ]+', ' ', 'g'), ' ，,、。？?'), ''), q) AS sub_q FROM (VALUES {", ".join(f"('{q}')" for q in _NAMED)}) t(q)""")
def alias_detect_strip(spark, sf_dir):
    return asked(spark, _NAMED).select("q", F.array_join(X.detect_names(F.col("q")), "|").alias("companies"), X.strip_names(F.col("q")).alias("sub_q"))


_WORDS = sorted(dict.fromkeys([*D.DOMAIN_WORDS, *(w for g in D.SYNONYMS for w in g)]), key=lambda w: -len(w))
_WHOLE = " || ".join(f"CASE WHEN {' OR '.join(f'''contains(hay, '{w}')''' for w in g)} THEN [{', '.join(f'''{chr(39)}{w}{chr(39)}''' for w in g)}] ELSE [] END" for g in D.SYNONYMS)


@query(f"""WITH h AS (SELECT q, concat_ws(' ', q, array_to_string({_EXPAND}, ' ')) AS hay FROM (VALUES {_VALUES}) t(q)),
l AS (SELECT q, {_WHOLE} || {_list(_WORDS, lambda w: f"contains(hay, '{w}')")} AS all_words FROM h),
u AS (SELECT q, unnest(all_words) AS w, generate_subscripts(all_words, 1) AS pos FROM l),
d AS (SELECT q, w, min(pos) AS pos FROM u GROUP BY q, w), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pos) AS k FROM d)
SELECT q, string_agg(w, '|' ORDER BY k) AS focus FROM n WHERE k <= 6 GROUP BY q""")
def focus_terms_cap6(spark, sf_dir):
    return asked(spark).select("q", F.array_join(X.focus_terms(F.col("q")), "|").alias("focus"))


_FROZEN = ", ".join(f"('{q}', '{s}', {t}, '{m}', {c})" for q, s, t, *cs in evaluation.FROZEN for m, c in zip(evaluation.MODES, cs))
_RUNS = f"runs AS (SELECT * FROM (VALUES {_FROZEN}) t(qid, shape, total, mode, covered))"
_VERDICT = "CASE WHEN total <= 0 THEN '—' WHEN covered >= total THEN '正确' WHEN covered > 0 THEN '部分正确' ELSE '错误' END"


@query(f"WITH {_RUNS} SELECT mode, sum(covered)::BIGINT AS covered, sum(total)::BIGINT AS total, round(sum(covered) / greatest(sum(total), 1), 3) AS coverage FROM runs GROUP BY mode")
def mode_scores_ratio_of_sums(spark, sf_dir):
    return evaluation.coverage(evaluation.frozen_runs(spark), "mode")


@query(f"WITH {_RUNS} SELECT shape, sum(covered)::BIGINT AS covered, sum(total)::BIGINT AS total, round(sum(covered) / greatest(sum(total), 1), 3) AS coverage FROM runs WHERE mode = 'cover' GROUP BY shape")
def shape_scores(spark, sf_dir):
    return evaluation.coverage(evaluation.frozen_runs(spark).filter("mode = 'cover'"), "shape")


@query(f"""WITH {_RUNS}, v AS (SELECT mode, {_VERDICT} AS verdict FROM runs)
SELECT coalesce(mode, '合计') AS mode, count(*) FILTER (WHERE verdict = '正确') AS correct, count(*) FILTER (WHERE verdict = '部分正确') AS partly, count(*) FILTER (WHERE verdict = '错误') AS wrong FROM v GROUP BY ROLLUP (mode)""")
def verdict_rollup(spark, sf_dir):
    v = evaluation.frozen_runs(spark).withColumn("verdict", evaluation.verdict(F.col("covered"), F.col("total")))
    count = lambda name: F.count(F.when(F.col("verdict") == name, 1))
    return v.rollup("mode").agg(count("正确").alias("correct"), count("部分正确").alias("partly"), count("错误").alias("wrong")).withColumn("mode", F.coalesce("mode", F.lit("合计")))


@query(f"WITH {_RUNS} SELECT qid, {', '.join(f'''max(covered) FILTER (WHERE mode = '{m}') AS {m}''' for m in evaluation.MODES)} FROM runs GROUP BY qid")
def question_mode_pivot(spark, sf_dir):
    return evaluation.frozen_runs(spark).groupBy("qid").pivot("mode", list(evaluation.MODES)).agg(F.max("covered"))


@query("""WITH o AS (SELECT doc_id AS id, source AS subject, regexp_extract(text, '[\\p{L}]{5,}', 0) AS v, doc_id % 3 AS k FROM documents),
i AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'other' ELSE source END AS company, regexp_replace(text, '[\\s,，、　 ]', '', 'g') AS t FROM documents),
j AS (SELECT o.id, o.v <> '' AND k <> 0 AND contains(t, o.v) AS hit, company = subject AS own FROM o JOIN i USING (id))
SELECT id, CASE WHEN hit AND coalesce(own, false) THEN '已覆盖' WHEN hit THEN '部分' ELSE '缺' END AS status FROM j""")
def obligation_status(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = F.regexp_extract("text", r"[\p{L}]{5,}", 0)
    values = F.when(F.col("doc_id") % 3 != 0, F.array(first)).otherwise(F.array().cast("array<string>"))
    o = d.select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("id"), F.col("source").alias("subject"), values.alias("values"))
    i = d.select(F.col("doc_id").alias("qid"), "text", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "other").otherwise(F.col("source")).alias("company"))
    names = d.select(F.col("source").alias("subject")).distinct().withColumn("names", F.array(F.concat(F.lit("$"), "subject")))
    return evaluation.judge_obligations(i, o, names).select("id", "status")


_FLAGS = "CASE WHEN doc_id % 11 = 0 THEN 'G' END AS hint, doc_id % 2 = 0 AS in_corpus, doc_id % 13 = 0 AS missed, doc_id % 5 = 0 AS abl, doc_id % 3 = 0 AS hit, doc_id % 9 = 0 AS att, CASE WHEN doc_id % 7 = 0 THEN '已覆盖' ELSE '缺' END AS top8, CASE WHEN doc_id % 4 = 0 THEN source END AS subject, doc_id % 8 = 0 AS alias_there"
_CODE = "CASE WHEN hint IS NOT NULL THEN hint WHEN NOT in_corpus THEN 'A' WHEN missed THEN 'B' WHEN abl THEN 'C' WHEN hit AND NOT att THEN 'F' WHEN top8 = '已覆盖' THEN 'H' WHEN subject IS NOT NULL AND NOT alias_there THEN 'E' ELSE 'D' END"


def gaps(spark, sf_dir):
    flags = read(spark, sf_dir, "documents").selectExpr("doc_id", *(f.strip() for f in _FLAGS.split(", ")))
    code = evaluation.gap_code(*(F.col(c) for c in ("hint", "in_corpus", "missed", "abl", "hit", "att", "top8", "subject", "alias_there")))
    return flags.select("doc_id", code.alias("code"))


@query(f"SELECT doc_id, {_CODE} AS code FROM (SELECT doc_id, {_FLAGS} FROM documents)")
def gap_cascade_case(spark, sf_dir):
    return gaps(spark, sf_dir)


@query(f"""WITH g AS (SELECT doc_id AS id, {_CODE} AS code FROM (SELECT doc_id, {_FLAGS} FROM documents)),
c AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in evaluation.GAP_REASONS.items())}) t(code, reason)),
n AS (SELECT code, count(*) AS n, array_to_string((list_sort(list(DISTINCT id)))[1:6], ',') AS examples FROM g GROUP BY code)
SELECT code, reason, coalesce(n, 0) AS n, examples FROM c LEFT JOIN n USING (code)""")
def gap_counts_zero_filled(spark, sf_dir):
    return evaluation.gap_counts(gaps(spark, sf_dir).withColumnRenamed("doc_id", "id")).withColumn("examples", F.array_join("examples", ","))


@query("""WITH g AS (SELECT item_id AS qid, [split_part(text, ' ', 1), split_part(text, ' ', 2)] AS v, text FROM benchmark), b AS (SELECT doc_id AS qid, text AS blob FROM documents)
SELECT qid, bool_and(contains(blob, w)) AS all_hit, sum(contains(blob, w)::INTEGER)::BIGINT AS n_hit, count(*) AS n_groups FROM (SELECT qid, unnest(v) AS w FROM g) JOIN b USING (qid) GROUP BY qid""")
def judge_groups_bool_and(spark, sf_dir):
    words = F.split("text", " ")
    groups = questions(spark, sf_dir).select("qid", F.posexplode(F.slice(words, 1, 2)).alias("group_no", "w")).select("qid", "group_no", F.array("w").alias("variants"))
    return evaluation.judge_groups(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("blob")), groups)


@query("""SELECT source AS company, count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS covered, count(*) FILTER (WHERE quality = 0) AS absent,
array_to_string(list_sort(list(DISTINCT lang) FILTER (WHERE quality = 1)), '·') AS kinds FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def company_breakdown(spark, sf_dir):
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy(F.col("source").alias("company")).agg(
        F.count("*").alias("n"), F.count(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)).alias("covered"), F.count(F.when(F.col("quality") == 0, 1)).alias("absent"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("quality") == 1, F.col("lang")))), "·").alias("kinds"),
    )


@query(f"""WITH g AS (SELECT source, {_CODE} AS code FROM (SELECT source, doc_id, {_FLAGS} FROM documents)), n AS (SELECT source, code, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, code) AS k FROM n)
SELECT source AS company, sum(n)::BIGINT AS missed, string_agg(code, ',' ORDER BY k) FILTER (WHERE k <= 2) AS top_codes FROM r GROUP BY source""")
def miss_summary(spark, sf_dir):
    n = gaps(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("company")), "doc_id").groupBy("company", "code").agg(F.count("*").alias("n"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, 2), lambda s: s["code"])
    return n.groupBy("company").agg(F.sum("n").alias("missed"), F.array_join(top, ",").alias("top_codes"))


@query("SELECT array_to_string(list_sort(list(DISTINCT source)), '|') AS companies, array_to_string(list_sort(list(DISTINCT lang)), '|') AS kinds, count(*) AS n FROM documents")
def distinct_sorted_lists(spark, sf_dir):
    lists = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return chunks(spark, sf_dir).agg(lists("company").alias("companies"), lists("kind").alias("kinds"), F.count("*").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS disclosed FROM customer")
def corpus_exists_semi(spark, sf_dir):
    found = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("disclosed", F.lit(True))
    return read(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left").withColumn("disclosed", F.coalesce("disclosed", F.lit(False)))


@query("SELECT o_custkey, o_orderkey, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("o_custkey", "o_orderkey", "n")


@query("SELECT doc_id, 'P' || (doc_id % 9) || CASE WHEN doc_id % 9 <> doc_id % 5 THEN '·P' || (doc_id % 5) ELSE '' END AS pages FROM documents")
def page_list_extract(spark, sf_dir):
    cites = F.concat(F.lit("x·P"), (F.col("doc_id") % 9).cast("string"), F.lit("页, y·P"), (F.col("doc_id") % 5).cast("string"), F.lit("页, P"), (F.col("doc_id") % 9).cast("string"))
    return chunks(spark, sf_dir).select("doc_id", X.page_list(cites).alias("pages"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-9) AS norm FROM e)
SELECT vec_id, round(v[1] / norm, 6) AS first, round(list_inner_product(list_transform(v, lambda x: x / norm), list_transform(v, lambda x: x / norm)), 6) AS self FROM n""")
def l2_normalize(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").withColumn("v", X.l2_normalised(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return v.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(X.dot(F.col("v"), F.col("v")), 6).alias("self"))


@query("""SELECT n_nationkey, '| ' || n_name || ' | ' || r_name || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || n_nationkey || ' | ' || r_regionkey || ' |' AS md
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_markdown(spark, sf_dir):
    j = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda c: F.col(c).cast("string")
    grid = F.array(F.array(text("n_name"), F.lit(""), text("r_name")), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(text("n_nationkey"), F.lit(None).cast("string"), text("r_regionkey")))
    return j.select("n_nationkey", X.markdown_table(grid).alias("md"))


@query()
def chunk_packing(spark, sf_dir):
    """A fold that SQL has no form for; tests hold it against a restatement in Python."""
    pieces = chunks(spark, sf_dir).select("doc_id", F.posexplode(chunking.packed(F.col("text"), r"(?<=[.!?\n])")).alias("piece", "text"))
    return pieces.select("doc_id", "piece", F.length("text").alias("n_chars"), F.sha1(F.col("text").cast("binary")).alias("sha1"))
