"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is scored by its worst window: n-gram weights are summed over every run of WINDOW
characters of the whole text, and the largest sum counts, so that one slur in a long document
is not averaged away. Training repeats that choice: each sampled document is represented by the
window which the present weights find worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import by_bytes, texts_of
from discloq.llm.common import held_out, sampled, table

ORDERS = (3, 4, 5, 6)
BITS = 18
WINDOW = 12
PAD = 8
THRESHOLD = 0.3
#: Bounds of the sample that the classifier is fitted on: rows per class, and bytes of a row.
FIT_ROWS, FIT_BYTES = 1500, 16_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram of each order that starts at each character, (len(ORDERS), chars),
    and the offsets at which documents start. Documents are lower-cased and padded, so that no
    window reaches into another one."""
    pad = "\0" * PAD
    padded = [pad + t.lower() + pad for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(codes)
    out = np.zeros((len(ORDERS), n), np.int32)
    h = codes * np.uint32(0x9E3779B1)
    for k in range(2, ORDERS[-1] + 1):
        h = h[:-1] * np.uint32(0x85EBCA6B) + codes[k - 1 :]
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            j = ORDERS.index(k)
            mixed = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            out[j, : len(h)] = mixed.view(np.int32) + (j << BITS)
    return out, starts


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, already scaled by its log-count ratio
    bias: float

    def margins(self, texts: list[str], where: bool = False):
        """The largest window sum of each text, and with ``where`` the window's start."""
        if not texts:
            return np.zeros(0)
        ids, starts = features(texts)
        total = self.weights[ids[0]]
        for row in ids[1:]:
            total += self.weights[row]
        sums = np.cumsum(total, dtype=np.float64)
        sums[WINDOW:] -= sums[:-WINDOW].copy()
        best = np.maximum.reduceat(sums, starts[:-1])
        if not where:
            return best + self.bias
        at = [max(a, a + int(np.argmax(sums[a:b])) - WINDOW + 1) for a, b in zip(starts, starts[1:])]
        return best + self.bias, ids, np.array(at)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -40, 40)))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3, steps: int = 150, ridge: float = 0.02) -> Model:
    """Fits ratios and weights. With one class or none, every score is that class's share
    (0 where there is no label at all)."""
    size = len(ORDERS) << BITS
    labels = np.asarray(labels, np.float64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 40.0 if labels.sum() else -40.0)
    counts = np.ones((2, size), np.float32)
    for t, y in zip(texts, labels):
        ids, _ = features([t])
        counts[int(y), np.unique(ids)] += 1
    n1, n0 = labels.sum(), (1 - labels).sum()
    ratio = np.log(counts[1] / (n1 + 2)) - np.log(counts[0] / (n0 + 2))
    ratio[np.maximum(counts[0], counts[1]) < 3] = 0  # seen once: says nothing
    weight, bias = np.full(size, 0.1), -2.0
    for _ in range(rounds):
        model, rows = Model((weight * ratio).astype(np.float32), bias), []
        for t in texts:
            _, ids, at = model.margins([t], where=True)
            rows.append(ids[:, at[0] : at[0] + WINDOW].ravel())
        width = max(map(len, rows))
        x = np.zeros((len(rows), width), np.int64)
        live = np.zeros((len(rows), width), bool)
        for i, r in enumerate(rows):
            x[i, : len(r)], live[i, : len(r)] = r, True
        used, inverse = np.unique(x[live], return_inverse=True)
        slot = np.zeros_like(x)
        slot[live] = inverse
        scaled = ratio[used][slot] * live
        part, start = weight[used], weight[used].copy()
        m, v, mb, vb = np.zeros_like(part), np.zeros_like(part), 0.0, 0.0
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip((part[slot] * scaled).sum(1) + bias, -40, 40)))
            e = (p - labels) / len(labels)
            g = np.bincount(slot.ravel(), (scaled * e[:, None]).ravel(), len(used)) + ridge * (part - start) / len(labels)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * e.sum(), 0.99 * vb + 0.01 * e.sum() ** 2
            part = part - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
        weight[used] = part
    return Model((weight * ratio).astype(np.float32), float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES):
    """(texts, labels) of a bounded sample: about ``rows`` documents of each class outside the
    held-out fold, of those the texts up to ``most_bytes``. A document with several labels
    counts as 1 if any is."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("_y"))
    ids = sampled(known.filter(~held_out(F.col("doc_id"))), F.col("doc_id"), "_y", rows)
    ids = ids.groupBy("doc_id").agg(F.max("_y").alias("_y"))  # about 2 * rows of them
    found = (
        docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        .filter(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
        .orderBy(F.xxhash64("doc_id"), "text").limit(3 * rows).collect()
    )
    return [r["text"] for r in found], np.array([r["_y"] for r in found], np.float64)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from whole texts. Null and empty
    texts have no n-gram and get the score of the bias alone; rows with a null doc_id are kept
    and count as not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            scores = shared.value.score(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(*training_rows(docs, table(spark, sf_dir, "labels"))))
