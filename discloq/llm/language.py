"""Language ID: a byte convolutional network, trained in numpy.

Filters of several widths run over embedded bytes of a fixed-length window, are max-pooled and
feed a softmax. A text is cut into such windows without a gap; the mean of their logits, by
bytes covered, decides. For prediction the embedding and the filters are folded into tables by
byte pair, which gives the same sums with two look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import bounded, by_bytes, let_go, texts_of
from discloq.llm.common import held_out, sampled, table

WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
LENGTH = 256
UNKNOWN = "und"
#: Bounds of the training sample: rows for each language and bytes of a row.
FIT_ROWS, FIT_BYTES = 300, 16_000


def has_letter(text: str) -> bool:
    """Of Unicode category L; numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


def windows(texts: list[str], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zero-padded), the text that each belongs to, bytes covered."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(b) // length)) for b in raw])
    joined = b"".join(b.ljust(n * length, b"\0") for b, n in zip(raw, counts))
    x = np.frombuffer(joined, np.uint8).reshape(-1, length)
    owner = np.repeat(np.arange(len(raw)), counts)
    last = np.cumsum(counts) - 1
    covered = np.full(len(x), float(length))
    covered[last] = [len(b) - (n - 1) * length for b, n in zip(raw, counts)]
    return x, owner, covered


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # (width, EMBED, FILTERS)
    shift: np.ndarray  # (all filters,)
    dense: np.ndarray  # (all filters, labels)
    base: np.ndarray

    def fold(self) -> None:
        """Tables by byte pair: at i, what bytes i and i+1 add to the filters that start at i;
        at i+2, what bytes i+2 and i+3 add to those of widths 3 and 4."""
        one = [[(self.embed @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        self.head = np.ascontiguousarray(np.concatenate([pair(t[0], t[1]) for t in one], 1) + self.shift.astype(np.float32))
        none = np.zeros_like(one[1][2])
        self.tail = np.ascontiguousarray(np.concatenate([pair(one[1][2], none), pair(one[2][2], one[2][3])], 1))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter outputs of each window."""
        n, length = x.shape
        wide = np.zeros((n, length + 3), np.uint16)
        wide[:, :length] = x
        pairs = wide[:, :-1] * np.uint16(256) + wide[:, 1:]
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        step = 64
        for a in range(0, n, step):
            p = pairs[a : a + step]
            acts = self.head[p[:, :length]]
            acts[:, :, FILTERS:] += self.tail[p[:, 2 : length + 2]]
            out[a : a + step] = acts.max(1)
        return np.maximum(out, 0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and its probability; UNKNOWN and 0 where a text has no letter."""
        if not texts:
            return [], np.zeros(0)
        x, owner, covered = windows(texts)
        logits = self.pooled(x) @ self.dense + self.base
        total = np.zeros((len(texts), logits.shape[1]))
        np.add.at(total, owner, logits * covered[:, None])
        mean = total / np.maximum(np.bincount(owner, covered), 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        known = np.array([has_letter(t) for t in texts])
        return [self.labels[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.where(known, p[np.arange(len(p)), best], 0.0)


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = 400, rate: float = 4e-3) -> Network:
    """Trains by Adam on one window of each text and a short piece of it, at least ``steps``
    times 64. Without any labelled text the network knows UNKNOWN only."""
    labels = sorted(set(langs)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    net = Network(
        labels, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS],
        np.zeros(total), rng.normal(0, 0.2, (total, len(labels))), np.zeros(len(labels)),
    )
    pieces, ys = [], []
    for t, y in zip(texts, langs):
        b = t.encode("utf-8", "replace")
        if not has_letter(t):
            continue
        for size in (LENGTH, int(rng.integers(12, 96))):
            a = int(rng.integers(0, max(1, len(b) - size + 1)))
            pieces.append(b[a : a + size].ljust(LENGTH, b"\0"))
            ys.append(labels.index(y))
    if len(labels) < 2 or not pieces:
        net.fold()
        return net
    x = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, LENGTH).astype(np.int64)
    x = np.concatenate([x, np.zeros((len(x), 3), np.int64)], 1)
    y = np.array(ys)
    share = np.bincount(y, minlength=len(labels))
    per_row = (len(y) / (len(labels) * share))[y]  # classes weigh alike
    params = [net.embed, *net.filters, net.shift, net.dense, net.base]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(8, -(-64 * steps // len(x)))):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            xb, yb, wb = x[rows], y[rows], per_row[rows]
            n, e = len(rows), net.embed[xb]
            acts, at = [], []
            for w in net.filters:
                s = sum(e[:, j : j + LENGTH] @ w[j] for j in range(len(w)))
                at.append(s.argmax(1))
                acts.append(s.max(1))
            z = np.concatenate(acts, 1) + net.shift
            hidden = np.maximum(z, 0)
            logits = hidden @ net.dense + net.base
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(n), yb] -= 1
            d *= wb[:, None] / n
            dz = (d @ net.dense.T) * (z > 0)
            g_embed, g_filters = np.zeros_like(net.embed), []
            for k, w in enumerate(net.filters):
                dk, gw = dz[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(w)
                for j in range(len(w)):
                    ids = np.take_along_axis(xb, at[k] + j, 1)
                    gw[j] = np.einsum("nfe,nf->ef", net.embed[ids], dk)
                    np.add.at(g_embed, ids, dk[:, :, None] * w[j].T[None])
                g_filters.append(gw)
            grads = [g_embed, *g_filters, dz.sum(0), hidden.T @ d, d.sum(0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net.fold()
    return net


def training_rows(docs: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> tuple[list[str], list[str]]:
    """A bounded sample outside the held-out fold: about ``rows`` texts of each language, at
    most ``most_bytes`` long."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= most_bytes))
    found = sampled(usable, F.col("doc_id"), "lang", rows).orderBy(F.xxhash64("doc_id"), "text").limit(256 * rows).collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def predict_documents(docs: DataFrame, net: Network, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from whole texts, after the columns
    named by ``keep``. A text that is null or has no letter is ``und`` with score 0; a null
    doc_id counts as not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 16 MB, whatever the input
    out = [c for c in keep if c not in ("doc_id", "held_out", "lang_pred", "score")]
    body = "text" if "text" in out else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in by_bytes(batches, body):
            langs, scores = shared.value.predict(texts_of(part, body))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in out), part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*out, "doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(*out, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), *([] if "text" in out else [F.col("text").alias("_text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.transform(bounded).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_documents(docs, train(*training_rows(docs)))
