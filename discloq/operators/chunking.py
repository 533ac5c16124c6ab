"""Cleaning, sectioning and packing of page text; order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloq import dictionaries as D


def boilerplate(lines: DataFrame, group: str, page: str, line: str = "line", share: float = 0.25, least: int = 3, longest: int = 90) -> DataFrame:
    """(group, line) of short lines on at least max(least, share of pages) pages of the group."""
    pages = lines.groupBy(group).agg(F.countDistinct(page).alias("_pages"))
    counts = lines.filter(F.length(line) < longest).groupBy(group, line).agg(F.countDistinct(page).alias("n_pages"))
    return counts.join(pages, group).filter(F.col("n_pages") >= F.greatest(F.lit(least), F.col("_pages") * share)).drop("_pages")


def clean_lines(lines: DataFrame, group: str, page: str, line: str = "line") -> DataFrame:
    """Lines without boilerplate, page numbers and repeats within a page (first by ``ord``)."""
    kept = lines.filter(F.trim(line) != "").filter(~F.col(line).rlike(r"^[-—\s]*\d{1,4}[-—\s]*$") & ~F.col(line).rlike(r"^第\s*\d+\s*页$"))
    kept = kept.join(boilerplate(lines, group, page, line).select(group, line), [group, line], "left_anti")
    first = Window.partitionBy(group, page, line).orderBy("ord")
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def outside_boxes(blocks: DataFrame, boxes: DataFrame, page: list[str], slack: float = 2.0) -> DataFrame:
    """Blocks (x0, y0, x1, y1) that lie in none of the page's boxes (bx0, by0, bx1, by1)."""
    inside = (F.col("x0") >= F.col("bx0") - slack) & (F.col("y0") >= F.col("by0") - slack) & (F.col("x1") <= F.col("bx1") + slack) & (F.col("y1") <= F.col("by1") + slack)
    same = [F.col(f"b.{c}") == F.col(f"t.{c}") for c in page]
    condition = inside
    for s in same:
        condition = condition & s
    return blocks.alias("b").join(boxes.alias("t"), condition, "left_anti")


def forward_fill(rows: DataFrame, group: str, order: list[str], value: Column, number: Column | None = None, into: str = "section") -> DataFrame:
    """The last value seen so far; with ``number``, a value counts only if its number isn't below
    those before it."""
    ahead = Window.partitionBy(group).orderBy(*order)
    if number is not None:
        best = F.max(number).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_best", best)
        value = F.when(F.col("_best").isNull() | (number >= F.col("_best")), value)
    rows = rows.withColumn(into, F.last(value, True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("_best")


def islands(rows: DataFrame, group: str, order: list[str], starts: Column, into: str = "island") -> DataFrame:
    """Numbers the runs of rows; a run begins where ``starts`` holds."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(starts.cast("int")).over(w))


def packed(text: Column, ends: str = r"(?<=[。！？；\n])", target: int = D.CHUNK_TARGET, overlap: int = D.CHUNK_OVERLAP, most: int = D.CHUNK_MAX) -> Column:
    """Text as pieces of about ``target`` characters: segments are joined while they fit, a new
    piece repeats the last ``overlap`` characters, and none is longer than ``most``. One fold
    over the segments; cuts of overlong buffers have a closed form."""
    step = most - overlap

    def add(state, segment):
        buf = state["buf"]
        full = (F.length(buf) + F.length(segment) > target) & (F.length(buf) > 0)
        tail = F.when(F.length(buf) > overlap, F.substr(buf, F.length(buf) - (overlap - 1))).otherwise("")
        now = F.when(full, F.concat(tail, segment)).otherwise(F.concat(buf, segment))
        done = F.when(full, F.concat(state["parts"], F.array(buf))).otherwise(state["parts"])
        cuts = F.when(F.length(now) > most, F.ceil((F.length(now) - most) / F.lit(float(step))).cast("int")).otherwise(0)
        whole = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substr(now, i * step + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(cuts > 0, F.substr(now, cuts * step + 1)).otherwise(now).alias("buf"), F.concat(done, whole).alias("parts"))

    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("parts"))
    pieces = F.aggregate(F.filter(F.split(text, ends), lambda s: s != ""), start, add, lambda s: F.concat(s["parts"], F.array(s["buf"])))
    pieces = F.when(F.length(text) <= target, F.array(text)).otherwise(pieces)
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
