"""Best-fit packing: bounded-space online best fit, open bins in a bitset keyed by free space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import bounded, by_bytes, texts_of
from discloq.llm.common import table
from discloq.llm.tokens import id_memory, word_ids

CAPACITY = 2048
OPEN_BINS = 512
#: Documents for each packing task. A task's last open bins are its only waste, so tasks are large.
TASK_DOCS = 500_000


class BestFit:
    """Online best fit with at most ``most`` open bins. ``mask`` has bit f set if an open bin
    has f free; the smallest fitting f is one shift and one lowest bit away. When a new bin
    needs a place, the fullest closes."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.mask, self.open, self.bins = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to capacity."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, found = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(found)
            self.mask |= 1 << left
            self.open += 1
        return found, self.capacity - free


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, whole long"


def pieces_of(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: a document's ids and a closing id 0, cut every ``capacity`` ids. Null
    is empty: the one id 0. ``whole`` is set on pieces that fill a sequence by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full = id_memory(name), 0
        first = (1 << 62) | (TaskContext.get().partitionId() << 36)
        for part in by_bytes(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(part.column("doc_id").to_pylist(), word_ids(texts_of(part), seen)):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    whole = None
                    if len(one) == 4 * capacity:
                        whole, full = first + full, full + 1
                    for column, value in zip(out, (doc, k, at // 4, len(one) // 4, zlib.crc32(one), whole)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(bounded).mapInArrow(run, PIECE)


def pack(pieces: DataFrame, tasks: int, capacity: int = CAPACITY, most: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset. Only the few numbers of each piece move; full pieces have a
    sequence of their own. Pieces arrive in the order of a hash, the same in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, most), TaskContext.get().partitionId() << 36
        for batch in batches:
            lengths, wholes = batch.column("length").to_pylist(), batch.column("whole").to_pylist()
            bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, (length, whole) in enumerate(zip(lengths, wholes)):
                if whole is None:
                    b, offsets[i] = fit.place(length)
                    bins[i] = first + b
                else:
                    bins[i], offsets[i] = whole, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bins), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    spread = pieces.repartition(tasks, mixed).sortWithinPartitions(mixed)
    return spread.transform(bounded).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", capacity: int = CAPACITY, task_docs: int = TASK_DOCS) -> DataFrame:
    """Packs every document; how many packing tasks there are follows the number of rows. An
    empty table gives no rows. Several rows with one doc_id are packed as several documents."""
    return pack(pieces_of(docs, name, capacity), max(1, -(-docs.count() // task_docs)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
