"""SimHash near-dedup by covering locality-sensitive hashing.

Positions of a fingerprint get nonzero vectors of radius + 1 bits; each nonzero vector v gives
a mask of the positions whose vector has an odd product with v. Any radius positions are
orthogonal to some v together, so two fingerprints within the radius agree under that mask:
every link collides in some table. Collisions are verified, so every link found is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import bounded, by_bytes
from discloq.llm.common import components, join_hot, table
from discloq.session import written

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one bucket that are compared in one task; larger buckets are compared by
#: pairs of blocks, each pair a group of its own.
BUCKET = 4096
NO_ID = 1 << 62


def shingle_hashes(text: bytes | None, words: int = WORDS, seed: int = SEED, chunk: int = 1 << 15) -> np.ndarray:
    """XXH64 of each shingle of UTF-8 text, repeats included; none where it has no word."""
    parts = (text or b"").lower().split()  # both ASCII only, as the white space is
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(parts) - words + 1)
    stops = (ends[words - 1 :] if len(parts) >= words else ends[-1:]) - 1
    out, digest = np.empty(n, np.uint64), xxhash.xxh64_intdigest
    for a in range(0, n, chunk):
        z = min(n, a + chunk)
        out[a:z] = [digest(joined[x:y], seed) for x, y in zip(starts[a:z].tolist(), stops[a:z].tolist())]
    return out


def majority(h: np.ndarray, chunk: int = 1 << 15) -> int:
    """The bits that are set in over half of the hashes; 0 of none."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), chunk):
        votes += np.unpackbits(h[a : a + chunk].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Of UTF-8 text; 0 where it has no word."""
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "text"):
            found = np.array([fingerprint(t, words, seed) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).transform(bounded).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """One signed 64-bit mask for each nonzero vector of radius + 1 bits."""
    top = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(64) if ((1 + i % top) & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def stars(fps: np.ndarray, ids: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of one bucket: each member to its component's first one."""
    left, roots, members = np.arange(len(fps)), [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for a in range(0, len(front), 256):
                near |= (np.bitwise_count(fps[left][:, None] ^ fps[front[a : a + 256]][None, :]) <= radius).any(1)
            front, left = left[near], left[~near]
            roots += [int(ids[root])] * len(front)
            members += ids[front].tolist()
    return roots, members


LINK = "a long, b long, v int, key long, fp long, id long"


def _bucket_links(radius: int, most: int):
    """For rows (v, key, fp, id) sorted by (v, key): links (a, b), and rows of buckets over
    ``most`` as they are. Holds one batch and one bucket of up to ``most`` rows."""

    def emit(a, b, rows=None):
        k = len(a)
        big = rows if rows is not None and len(rows[0]) else [np.zeros(0, np.int64)] * 4
        n = len(big[0])
        none = lambda size, kind: pa.nulls(size, kind)
        both = lambda head, tail, kind: pa.concat_arrays([head, tail]).cast(kind)
        return pa.RecordBatch.from_arrays(
            [both(pa.array(a, pa.int64()), none(n, pa.int64()), pa.int64()), both(pa.array(b, pa.int64()), none(n, pa.int64()), pa.int64()),
             both(none(k, pa.int32()), pa.array(big[0].astype(np.int32)), pa.int32()), *(both(none(k, pa.int64()), pa.array(big[i]), pa.int64()) for i in (1, 2, 3))],
            ["a", "b", "v", "key", "fp", "id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        large = None  # the bucket that is being passed on, row by row

        def solve(cols, ends):
            a_out, b_out, first = [], [], 0
            lengths = np.diff(np.concatenate([[0], ends]))
            starts = ends - lengths
            u = cols[2].view(np.uint64)
            two = starts[lengths == 2]
            near = np.bitwise_count(u[two] ^ u[two + 1]) <= radius
            a_out += cols[3][two[near]].tolist()
            b_out += cols[3][two[near] + 1].tolist()
            for s, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist()):
                x, y = stars(u[s : s + n], cols[3][s : s + n], radius)
                a_out += x
                b_out += y
            return a_out, b_out

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("v", "key", "fp", "id")]
            cols = [np.concatenate([h, x]) for h, x in zip(held, new)]
            if large is not None:
                same = (cols[0] == large[0]) & (cols[1] == large[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield emit([], [], [c[:n] for c in cols])
                cols = [c[n:] for c in cols]
                if len(cols[0]):
                    large = None
            if not len(cols[0]):
                held = cols
                continue
            ends = np.nonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))[0] + 1
            done = int(ends[-1]) if len(ends) else 0
            held = [c[done:] for c in cols]
            if done:
                closed = [c[:done] for c in cols]
                lengths = np.diff(np.concatenate([[0], ends]))
                if lengths.max() > most:
                    big = np.repeat(lengths > most, lengths)
                    yield emit([], [], [c[big] for c in closed])
                    closed, ends = [c[~big] for c in closed], np.cumsum(lengths[lengths <= most])
                if len(closed[0]):
                    yield emit(*solve(closed, ends))
            if len(held[0]) > most:
                large = (held[0][0], held[1][0])
                yield emit([], [], held)
                held = [c[:0] for c in held]
        if len(held[0]):
            yield emit(*solve(held, np.array([len(held[0])])))

    return run


def links(classes: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """(a, b) between ids of classes(fp, id), fp distinct: enough links to join whatever links
    within the radius join."""
    tables = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for v, m in enumerate(masks(radius)))))
    rows = classes.select("fp", "id", tables.alias("t")).select("t.v", "t.key", "fp", "id")
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "v", "key").sortWithinPartitions("v", "key")
    found = written(rows.transform(bounded).mapInArrow(_bucket_links(radius, most), LINK), "simhash-links")
    out = found.filter("a is not null").select("a", "b")
    big = found.filter("a is null").select("v", "key", "fp", "id")
    if not big.isEmpty():
        sizes = big.groupBy("v", "key").agg(F.count("*").alias("_n"))
        half = most // 4  # a block has about that many, so a pair of blocks stays under most
        placed = big.join(F.broadcast(sizes), ["v", "key"]).withColumn("_k", F.ceil(F.col("_n") / half)).withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_k")))
        pairs = placed.select("v", "key", "fp", "id", F.explode(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.least(j, F.col("_b")) * F.col("_k") + F.greatest(j, F.col("_b")))).alias("_p"))
        pairs = pairs.select(F.lit(0).alias("v"), F.xxhash64("v", "key", "_p").alias("key"), "fp", "id").repartition(n, "key").sortWithinPartitions("v", "key")
        out = out.unionByName(pairs.transform(bounded).mapInArrow(_bucket_links(radius, 1 << 30), LINK).select("a", "b"))
    return out.distinct()


def near_dups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row. Texts without a word,
    null ones too, have fingerprint zero and link like any other. Rows of one fingerprint form
    a class; only classes are compared. A component without any doc_id has a null id; doc_ids
    are below 2**62."""
    fps = written(fingerprints(docs, words), "simhash")
    stand_in = F.lit(NO_ID) + F.pmod("fp", F.lit(NO_ID))  # for a class without any doc_id
    classes = written(fps.groupBy("fp").agg(F.coalesce(F.min("doc_id"), stand_in).alias("id"), F.count("*").alias("n")), "simhash-classes")
    found = components(links(classes.select("fp", "id"), radius))
    least = F.coalesce("component", "id")
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", "n", F.when(least < NO_ID, least).alias("component_id"))
    out = join_hot(fps, named, "fp", "n", fps.count(), "inner")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))
