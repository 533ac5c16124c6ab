"""Dense vectors without a language model: TF-IDF of character n-grams and a truncated SVD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloq.session import written

CLIP = 1500
#: Cells of the projection that each worker holds, 4 bytes each.
MOST_CELLS = 1 << 27
#: Characters of a text whose grams are counted at once; a space in the numbers of grams.
PIECE, SPACE = 1 << 18, 33
#: Grams of texts that a task holds before it sums them up.
MOST_HELD = 1 << 20


def embedding_text(*parts: str) -> Column:
    """The text that is embedded: the parts joined, lines as spaces, cut at CLIP characters."""
    return F.substring(F.translate(F.concat_ws(" ", *parts), "\n", " "), 1, CLIP)


def grams(docs: DataFrame, key: str, text: str = "text", sizes=(2, 3)) -> DataFrame:
    """(key, gram, tf): character n-grams inside words, each word between two spaces."""
    words = docs.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''").groupBy(key, "w").agg(F.count("*").alias("c"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
    return words.select(key, "c", F.explode(F.concat(*map(cut, sizes))).alias("gram")).groupBy(key, "gram").agg(F.sum("c").alias("tf"))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of lower-cased ``text`` (as ``grams``: of two and three characters),
    each as one number of 21 bits a character, from one on; sorted, and how often it has each."""
    before, parts = np.array([SPACE]), []  # the last characters of the pieces before
    for at in range(0, max(1, len(text)), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        blank = (c == SPACE) | ((c > 9) & (c < 15))
        c[blank] = SPACE
        follows = np.concatenate([[before[-1] == SPACE], blank[:-1]])[: len(c)]
        c = np.concatenate([before, c[~(blank & follows)]])
        if at + PIECE >= len(text) and c[-1] != SPACE:
            c = np.append(c, SPACE)
        k = len(before)  # grams that end before that are counted
        two = c[:-1] << 21 | c[1:]
        three = two[:-1] << 21 | c[2:]
        new = max(0, k - 2)
        parts.append(np.unique(np.concatenate([two[k - 1 :], three[new:][c[1:-1][new:] != SPACE]]), return_counts=True))
        before = c[-2:]
    return parts[0] if len(parts) == 1 else _summed(parts)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The different first columns, sorted, and the sums of the other columns."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(cols[0])
    cols = [c[order] for c in cols]
    starts = np.nonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))[0] if len(cols[0]) else np.zeros(0, int)
    return cols[0][starts], *(np.add.reduceat(c, starts) if len(starts) else c for c in cols[1:])


def _names(codes: np.ndarray) -> list[str]:
    """The n-grams that the numbers stand for."""
    c = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1)
    text = (c - (c > 0)).astype("<u4").tobytes()
    return [text[12 * k + 4 * (n == 2) : 12 * k + 12].decode("utf-32-le") for k, n in enumerate((c > 0).sum(1).tolist())]


def _code(gram: str) -> int:
    """The number that stands for an n-gram."""
    code = 0
    for x in gram:
        code = code << 21 | ord(x) + 1
    return code


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts (null: empty) of some MB at most; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes.astype(np.int64)) >> 20
        cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield batch.column(0)[a:b], [(t or b"").decode("utf-8", "replace") for t in batch.column(1)[a:b].to_pylist()]


def _partial_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df, _n): in how many of the texts a gram is, and how often. Sums over a few times
    MOST_HELD grams at most are held; a gram may come out more than once."""
    held, size = [], 0

    def out(parts):
        for at in range(0, len(parts[0]), 1 << 16):
            codes, df, n = (x[at : at + (1 << 16)] for x in parts)
            yield pa.RecordBatch.from_arrays([pa.array(_names(codes), pa.string()), pa.array(df), pa.array(n)], ["gram", "df", "_n"])

    for _, texts in _texts(batches):
        for t in texts:
            codes, n = _counted(t)
            held.append((codes, np.ones(len(codes), np.int64), n.astype(np.int64)))
            size += len(codes)
            if size > MOST_HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > MOST_HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
    if held:
        yield from out(_summed(held))


def _weights(vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray], text: str) -> tuple[np.ndarray, np.ndarray]:
    """(j, w) of the grams of a text that are in the vocabulary: codes sorted, idf and j of each."""
    names, idf, j = vocabulary
    codes, n = _counted(text)
    at = np.searchsorted(names, codes)
    known = np.append(names, -1)[at] == codes
    at = at[known]
    w = (1 + np.log(n[known])) * idf[at]
    return j[at], w / np.sqrt((w * w).sum()) if len(w) else w


def _apart(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(key, text): rows whose key no other row has, the text lower-cased and in UTF-8, and the
    rows that share one, as they are, if there are any."""
    rows = docs.select(key, F.col(text).alias("text"))
    many = written(rows.groupBy(key).agg(F.count("*").alias("_m")).filter("_m > 1").select(F.col(key).alias("_k")), "repeated-keys")
    alone = rows.select(key, F.encode(F.lower("text"), "UTF-8").alias("text"))
    if many.isEmpty():
        return alone, None
    met = F.col(key).eqNullSafe(F.col("_k"))
    return alone.join(many, met, "left_anti"), rows.join(many, met, "left_semi")


def vocabulary(stats: DataFrame, n_docs: int, least: int = 2, most: int = 200_000) -> DataFrame:
    """(gram, df, idf, j) of the ``most`` most frequent grams in ``least`` documents or more, from
    (gram, df, _n), which may be partial sums."""
    stats = stats.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("_n").alias("_n")).filter(F.col("df") >= least)
    top = stats.orderBy(F.desc("_n"), "gram").limit(most)
    j = F.row_number().over(Window.orderBy(F.desc("_n"), "gram")) - 1  # over ``most`` rows only
    return top.select("gram", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"), j.alias("j"))


def _prepared(docs: DataFrame, key: str, text: str, least: int, most: int) -> tuple[DataFrame, Broadcast, DataFrame | None, DataFrame]:
    """(key, text) of rows with a key of their own, the broadcast vocabulary for them, (key, j,
    gram, w) of rows that share a key, which are one document, and the vocabulary. Grams are
    counted where a text is read, so that only sums over texts move, not a row for each gram of
    each text; texts that share a key have such rows."""
    alone, shared = _apart(docs, key, text)
    stats = alone.mapInArrow(_partial_stats, "gram string, df long, _n long")
    if shared is not None:
        found = written(grams(shared, key), "grams")
        stats = stats.unionByName(found.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("_n")))
    words = written(vocabulary(stats, docs.count(), least, most), "vocabulary")
    held = words.select("gram", "idf", "j").toArrow()
    codes = np.array([_code(g) for g in held.column("gram").to_pylist()], np.int64)
    order = np.argsort(codes)
    weights = docs.sparkSession.sparkContext.broadcast((codes[order], *(held.column(c).to_numpy()[order] for c in ("idf", "j"))))
    if shared is None:
        return alone, weights, None, words
    rows = found.join(words, "gram").withColumn("_w", (1 + F.log("tf")) * F.col("idf"))
    norms = rows.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    rows = rows.join(norms, F.col(key).eqNullSafe(F.col("_k"))).select(key, "j", "gram", (F.col("_w") / F.col("_norm")).alias("w"))
    return alone, weights, rows, words


def tfidf(docs: DataFrame, key: str, text: str = "text", least: int = 2, most: int = 200_000) -> DataFrame:
    """(key, j, gram, w): weights (1 + ln tf) idf, of unit length for each document."""
    alone, weights, shared, words = _prepared(docs, key, text, least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            j, w = zip(*(_weights(weights.value, t) for t in texts))
            of = np.repeat(np.arange(len(j)), [len(x) for x in j])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(j)), pa.array(np.concatenate(w))], [key, "j", "w"])

    rows = alone.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, j int, w double")
    rows = rows.join(F.broadcast(words.select("j", "gram")), "j").select(key, "j", "gram", "w")
    return rows if shared is None else rows.unionByName(shared)


def tfidf_totals(docs: DataFrame, key: str, text: str = "text", least: int = 2, most: int = 200_000) -> DataFrame:
    """(key, n_grams, total, largest): of each document with a known gram, the number, the sum and
    the largest of its weights in ``tfidf``."""
    alone, weights, shared, _ = _prepared(docs, key, text, least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _texts(batches):
            w = [_weights(weights.value, t)[1] for t in texts]
            n = pa.array([len(x) for x in w], pa.int64())
            total, largest = (pa.array([float(f(x)) for x in w], pa.float64()) for f in (np.sum, lambda x: x.max(initial=0)))
            yield pa.RecordBatch.from_arrays([keys, n, total, largest], [key, "n_grams", "total", "largest"]).filter(pc.greater(n, 0))

    rows = alone.mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_grams long, total double, largest double")
    if shared is None:
        return rows
    return rows.unionByName(shared.groupBy(key).agg(F.count("*").alias("n_grams"), F.sum("w").alias("total"), F.max("w").alias("largest")))


def svd_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = 512, most: int = 200_000) -> DataFrame:
    """(key, embedding): unit vectors in the space of the ``dim`` largest singular values, fewer
    where the rank is lower. Documents without a known gram have no row. Signs aren't unique."""
    weights = written(tfidf(docs, key, text, 2, most), "tfidf")
    width = (weights.agg(F.max("j")).first()[0] or 0) + 1
    dim = min(dim, width)
    if width * dim > MOST_CELLS:
        raise ValueError("fewer grams or dimensions: the projection is too large")
    rows = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("_v"))
    rows = written(rows.select(key, F.transform("_v", lambda s: s["j"]).alias("_j"), F.transform("_v", lambda s: s["w"]).alias("_w")), "rows")
    if rows.isEmpty():
        return rows.select(key, F.col("_w").cast("array<double>").alias("embedding"))
    matrix = RowMatrix(rows.select("_j", "_w").rdd.map(lambda r: Vectors.sparse(width, r[0], r[1])))
    right = docs.sparkSession.sparkContext.broadcast(matrix.computeSVD(dim).V.toArray().astype(np.float32))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [np.asarray(w) @ right.value[np.asarray(j)] for j, w in zip(part["_j"], part["_w"])]
            out = [v / max(float(np.linalg.norm(v)), 1e-9) for v in out]
            yield pd.DataFrame({key: part[key], "embedding": out})

    return rows.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, embedding array<double>")
