"""Reports as chunks: sections, sub-headings, buffers and packing over ordered blocks.

Blocks are (report, page, y, ord, text, is_table). Order is always a column; each report is one
window partition, as a report's blocks are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloq import dictionaries as D
from discloq.functions import text as X
from discloq.operators.chunking import packed

NUMERAL = "[一二三四五六七八九十]+"
#: What comes before a header's own words, of which there are TITLE characters at most.
SECTION, SUBSECTION, TITLE = rf"^第\s*({NUMERAL})\s*节[\s:：]*", rf"^{NUMERAL}\s*、\s*", 40
UNNAMED = "正文/未标注章节"
SHORTEST = 12


def _headed(text: Column, pattern: str) -> Column:
    return text.rlike(pattern) & (F.length(F.regexp_replace(text, pattern, "")) <= TITLE)


def section_number(text: Column, y: Column) -> Column:
    """Number of a numbered section header near the top of a page, else null; lines of a table
    of contents don't count."""
    return F.when(_headed(text, SECTION) & ~text.contains("....") & (y < 260), X.cn_number(F.regexp_extract(text, SECTION, 1)))


def section_title(text: Column, y: Column, titles: list[str] = D.SECTION_TITLES) -> Column:
    """The longest known title that a short line near the top begins with, else null."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    fits = reduce(lambda c, t: c.when(bare.startswith(t), t), sorted(titles, key=lambda t: -len(t)), F.when(F.lit(False), ""))
    return F.when((F.length(text) <= 30) & ~text.rlike("[。，：]$") & (y < 300), fits)


def sub_heading(text: Column) -> Column:
    return F.when(_headed(text, SUBSECTION) & (F.length(text) < 45) & ~text.endswith("。"), F.trim(text))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds _at: place by page, height to one digit, text before tables, and ``ord``."""
    w = Window.partitionBy("report").orderBy("page", F.round("y", 1), "is_table", "ord")
    return blocks.withColumn("_at", F.row_number().over(w))


def chunk_reports(blocks: DataFrame, titled: Column | None = None) -> DataFrame:
    """(report, chunk_id, section, section_no, subsection, page_start, page_end, has_table,
    n_chars, text).

    ``titled`` says which reports have titles instead of numbered sections. A numbered header
    counts only if its number isn't below those before it; it starts a section and is no text.
    A title starts a section and is text. Tables are chunks of their own and aren't cut. Chunks
    under 12 characters go.
    """
    titled = F.lit(False) if titled is None else titled
    text = F.col("text")
    rows = reading_order(blocks.withColumn("is_table", F.coalesce("is_table", F.lit(False))).withColumn("text", F.coalesce("text", F.lit(""))))
    ahead = Window.partitionBy("report").orderBy("_at")
    before, upto = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(Window.unboundedPreceding, 0)
    prose = ~F.col("is_table")
    rows = rows.withColumn("_no", F.when(prose, section_number(text, F.col("y"))))
    rows = rows.withColumn("_head", F.coalesce(F.col("_no") >= F.greatest(F.coalesce(F.max("_no").over(before), F.lit(0)), F.lit(0)), F.lit(False)))
    rows = rows.withColumn("_title", F.when(prose & ~F.col("_head") & titled, section_title(text, F.col("y"))))
    new = F.col("_head") | F.col("_title").isNotNull()
    rows = rows.withColumn("_new", new)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("_new"), F.trim("text")), True).over(upto), F.lit(UNNAMED)))
    rows = rows.withColumn("section_no", F.coalesce(F.max(F.when(F.col("_head"), F.col("_no"))).over(upto), F.lit(0)))
    rows = rows.withColumn("_s", F.sum(F.col("_new").cast("int")).over(upto))
    start = F.col("_new") | F.col("is_table") | F.coalesce(F.lag("is_table").over(ahead), F.lit(True))
    rows = rows.withColumn("_island", F.sum(start.cast("int")).over(upto)).filter(~F.col("_head"))
    # a sub-heading counts only inside a buffer; the chunk carries the last one of its section
    inside = Window.partitionBy("report", "_island").orderBy("_at")
    rows = rows.withColumn("_sub", F.when(prose & (F.row_number().over(inside) > 1), sub_heading(text)))
    parts = F.array_sort(F.collect_list(F.struct("_at", "text")))
    buffers = rows.groupBy("report", "_s", "_island", "section", "section_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("_text"), F.bool_or("is_table").alias("has_table"),
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max_by("_sub", F.when(F.col("_sub").isNotNull(), F.col("_at"))).alias("_sub"),
    )
    section = Window.partitionBy("report", "_s").orderBy("_island").rowsBetween(Window.unboundedPreceding, 0)
    buffers = buffers.withColumn("subsection", F.coalesce(F.last("_sub", True).over(section), F.lit("")))
    whole = F.regexp_replace("_text", r"(?U)^\s+|\s+$", "")
    buffers = buffers.withColumn("_text", whole).filter(F.length("_text") >= SHORTEST)
    pieces = buffers.select("*", F.posexplode(F.when(F.col("has_table"), F.array("_text")).otherwise(packed(F.col("_text")))).alias("_p", "text"))
    seq = F.row_number().over(Window.partitionBy("report").orderBy("_island", "_p"))
    return pieces.withColumn("chunk_id", F.format_string("%s_%04d", "report", seq)).select(
        "report", "chunk_id", "section", "section_no", "subsection", "page_start", "page_end", "has_table", F.length("text").alias("n_chars"), "text"
    )
