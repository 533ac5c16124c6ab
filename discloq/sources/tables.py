"""Readers and writers of files: manifests, shards with resume, binaries, pages, questions, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "code string, name string, exchange string, segment string, kind string, title string, day string, file string, size_mb double, sha1 string, ok boolean, note string"
QUESTIONS = (
    "qid string, q string, type string, shape string, companies array<string>, kinds array<string>, must_contain array<array<string>>, soft_must_contain array<array<string>>, "
    "obligations array<struct<id: string, subject: string, item: string, period: string, values: array<string>, src: string, gap_hint: string>>"
)
#: A smaller file is an error page, not a report.
LEAST_BYTES = 200_000


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records; a record that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, one file a partition, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def binaries(spark: SparkSession, path: str, glob: str = "*.pdf", least: int = LEAST_BYTES) -> DataFrame:
    """(path, length, sha1) of the files that are long enough; short ones aren't opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.filter(F.col("length") >= least).select("path", "length", F.sha1("content").alias("sha1"))


def complete(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows that are ok and whose file is there."""
    return manifest.filter("ok").join(files.select(F.col("path").alias("file")), "file", "left_semi")


BLOCK = r"(?s)<(h[1-6]|p|li|td|th)[^>]*>(.*?)</"


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, text) of the text blocks of pages(page_id, html), in order."""
    tags = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("ord", "b"))
    text = F.trim(F.regexp_replace(F.regexp_replace("b.text", "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return rows.select("page_id", "ord", F.col("b.tag").alias("tag"), text.alias("text")).filter("text <> ''")


def page_dump(lines: DataFrame, doc: str, page: str, order: str, text: str = "text") -> DataFrame:
    """(doc, dump): the text of each document with a mark before each page."""
    pages = lines.groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda s: s["t"]), "\n")
    pages = pages.select(doc, page, F.concat(F.lit("[PAGE "), F.col(page).cast("string"), F.lit("]\n"), body).alias("_p"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), F.col("_p").alias("p")))), lambda s: s["p"])
    return pages.groupBy(doc).agg(F.array_join(whole, "\n").alias("dump"))


def shards(spark: SparkSession, path: str) -> DataFrame | None:
    """All shards as one table, or None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_missing_shards(rows: DataFrame, path: str, key: list[str], parts: list[str] | None = None) -> None:
    """Appends the rows whose ``key`` has no shard yet, in folders by ``parts``. With a hash of
    the content in ``key``, changed rows are written again; a rerun after a failure adds only
    what is missing."""
    done = shards(rows.sparkSession, path)
    todo = rows if done is None else rows.join(done.select(*key).distinct(), key, "left_anti")
    writer = todo.write.mode("append")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def stored_index(postings: DataFrame, term_stats: DataFrame, doc_stats: DataFrame, path: str) -> None:
    """The lexical index as three tables; postings are sorted by term, so a search reads the row
    groups of its terms only."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    term_stats.write.mode("overwrite").parquet(f"{path}/terms")
    doc_stats.write.mode("overwrite").parquet(f"{path}/documents")


def index_meta(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, of table chunks, and the sorted lists of what can be filtered."""
    listed = lambda c: F.array_sort(F.collect_set(c)).alias({"company": "companies", "kind": "kinds", "section": "sections"}[c])
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.coalesce("has_table", F.lit(False))).alias("n_tables"), *map(listed, ("company", "kind", "section")))
