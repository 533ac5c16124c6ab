"""Near copies: covering SimHash tables first, then every pair that they can't reach.

Texts count by their sets of five-word shingles; similarity is Jaccard's, and each link is
verified on whole sets. Links are searched for in two ways.

1. SimHash: fingerprints within the radius meet in some covering table (``simhash.links``).
   Sets of similarity 0.8 differ in about 10 of 64 bits, and covering tables for a radius of 16
   would be 131071, so the tables find the closest copies only.
2. A prefix filter for the rest: shingles have one order everywhere, and two sets of similarity
   t or more share a shingle among the first n - ceil(t n) + 1 of each. No pair is missed.
   Shingles that a sample finds in many texts come last in the order, which keeps buckets small;
   results don't depend on the sample.

Links found first join most of a large group of copies, so that later steps form pairs only
between texts that aren't joined yet. There a bucket gives groups of rows that may be similar, not
their pairs, and groups that share a row become one cluster, so each text is in one cluster at
most. A cluster's whole sets meet in one task, which gives the links of a spanning forest: no step
makes the pairs of a group as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloq.llm import simhash
from discloq.llm.batches import bounded, by_bytes, let_go
from discloq.llm.common import components, join_hot
from discloq.session import written

#: Words of a shingle, and the least similarity as a fraction.
WORDS, LEAST, OF = 5, 4, 5
#: Rows of the sample, and how many of its frequent shingles are known to all tasks.
SAMPLE, FREQUENT = 20_000, 1 << 16
#: Members of a bucket that are compared at once; a bucket of over BLOCKS times that is compared
#: by pairs of blocks, in many tasks.
BLOCK, BLOCKS = 1024, 4
#: Up to so many keys of texts to be verified are broadcast (8 bytes each); more are joined.
BROADCAST = 1 << 20
#: Cells in which the shingles of a set are counted, for a bound of what two sets can share.
CELLS = 256
#: Cells of the smaller counts that go with the rows of a bucket.
SKETCH = 64
#: Shingles (8 bytes each) of a cluster that are compared at once; one of more is compared by pairs
#: of blocks.
SHINGLES = 1 << 22


def row_key(docs: DataFrame) -> Column:
    """Of a row's doc_id and text, either of which may be null."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), F.encode(docs["text"], "UTF-8").alias("text"))


def _set(h: np.ndarray) -> np.ndarray:
    return np.unique(h.view(np.int64))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without a word has none."""
    return _set(simhash.shingle_hashes(text, words))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three texts of the sample, sorted, and their counts."""
    below = int(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in by_bytes(batches, "text", 1 << 22):
            s, n = np.unique(np.concatenate([shingles(t) for t in part.column("text").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], ["s", "n"])

    chosen = _texts(docs).filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < below)
    counts = chosen.transform(bounded).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("count"))
    top = counts.filter("count >= 3").orderBy(F.desc("count"), "s").limit(FREQUENT).toArrow()
    s, n = (top.column(c).to_numpy().astype(np.int64) for c in ("s", "count"))
    order = np.argsort(s)
    return s[order], n[order]


def described(docs: DataFrame, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, doc_id, cls, n, fp, cells, sketch, prefix) of every row: cls names its set of n shingles,
    fp is the SimHash of its shingles, cells counts the set by a byte of its hashes (none if a count
    doesn't fit into a byte), sketch by fewer bits (all 255 if one doesn't fit), prefix holds the
    first of the set in the order."""
    names, counts = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in by_bytes(batches, "text"):
            cls, sizes, fps, cells, sketches, out = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                h = simhash.shingle_hashes(text, WORDS)
                s = _set(h)
                n = len(s)
                fps.append(simhash.majority(h))
                cls.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(n)
                counts_of = np.bincount(s & (CELLS - 1), minlength=CELLS)
                cells.append(counts_of.astype(np.uint8).tobytes() if counts_of.max() < 256 else None)
                fewer = counts_of.reshape(-1, SKETCH).sum(0)
                sketches.append(fewer.astype(np.uint8).tobytes() if fewer.max() < 256 else b"\xff" * SKETCH)
                if len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    s = s[np.lexsort((s, np.where(names[at] == s, counts[at], 0)))]
                out.append(s[: n - -(-LEAST * n // OF) + 1] if n else s)
            prefix = pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), pa.array(np.concatenate(out)))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, fps)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), signed[0], pa.array(sizes, pa.int32()), signed[1], pa.array(cells, pa.binary()), pa.array(sketches, pa.binary()), prefix], ["key", "doc_id", "cls", "n", "fp", "cells", "sketch", "prefix"])

    return _texts(docs).transform(bounded).mapInArrow(run, "key long, doc_id long, cls long, n int, fp long, cells binary, sketch binary, prefix array<long>")


#: A shingle, the size of a set and the shingle's place in its prefix in one number, the class,
#: and where it matters the component and the sketch.
ROW, COMP = ["s", "size", "cls"], ["s", "size", "cls", "comp", "sketch"]
PAIR = "a long, b long"
MEMBER = ["s", "m", "cls", "comp"]


def _columns(batches: Iterator[pa.RecordBatch], width: int = SKETCH) -> Iterator[list[np.ndarray]]:
    """Columns; binary ones as ``width`` counts a row, or as they are if that is 0."""
    for batch in batches:
        if batch.num_rows:
            yield [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, width) if width and pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by s, those whose s some other row has. Holds one batch and one row."""
    last, matched = None, False
    for cols in _columns(batches):
        if last is not None:
            cols = [np.concatenate(x) for x in zip(last, cols)]
        same = cols[0][1:] == cols[0][:-1]
        match = np.concatenate([[matched], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(c[:-1][match[:-1]]) for c in cols], ROW)
        last, matched = [c[-1:] for c in cols], bool(match[-1])
    if matched:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], ROW)


def _sketched(sketch: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, of sets of n shingles, may be similar: two sets share at most the sum
    of the smaller counts. Sums of 255 everywhere tell nothing."""
    ok, step = np.empty(len(i), bool), (1 << 22) // sketch.shape[1]
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        most = np.minimum(sketch[x], sketch[y]).sum(1, dtype=np.int64)
        ok[at : at + step] = ((OF + LEAST) * most >= LEAST * (n[x] + n[y])) | (most == 255 * sketch.shape[1])
    return ok


def _open(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows i and j that can be similar and are of different components."""
    size, cls, comp = cols[1], cols[2], cols[min(3, len(cols) - 1)]  # without components each class is its own
    n, pos = size >> 32, size & 0xFFFFFFFF
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    rest = np.minimum(n[i] - pos[i], n[j] - pos[j])  # what can be shared from here on
    ok = (comp[i] != comp[j]) & (OF * small >= LEAST * large) & ((OF + LEAST) * rest >= LEAST * (small + large))
    i, j = i[ok], j[ok]
    if len(cols) > 4:
        ok = _sketched(cols[4], n, i, j)
        i, j = i[ok], j[ok]
    return i, j


def _pairs(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The pairs of rows i and j that can be similar, as (a, b) of classes."""
    i, j = _open(cols, i, j)
    a, b = cols[2][i], cols[2][j]
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by s: each with the first of its s and the one before. Holds one batch."""
    held = None  # the first row of the present s, and the last row
    for cols in _columns(batches):
        lead = 0 if held is None else 2
        if lead:
            cols = [np.concatenate(x) for x in zip(*held, cols)]
        at = np.arange(lead, len(cols[0]))
        new = np.ones(len(at), bool)
        new[1:] = cols[0][at[1:]] != cols[0][at[1:] - 1]
        if lead:
            new[0] = cols[0][lead] != cols[0][lead - 1]
        first = np.maximum.accumulate(np.where(new, at, 0))  # 0: the one that is held
        yield _pairs(cols, np.concatenate([first[~new], at[~new] - 1]), np.concatenate([at[~new]] * 2))
        held = [[c[k : k + 1] for c in cols] for k in (int(first[-1]), len(cols[0]) - 1)]


def _buckets(batches: Iterator[pa.RecordBatch], width: int = SKETCH) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Whole buckets of two rows or more from rows sorted by s: columns, starts and lengths."""

    def whole(cols):
        starts = np.concatenate([[0], np.nonzero(np.diff(cols[0]))[0] + 1])
        lengths = np.diff(np.concatenate([starts, [len(cols[0])]]))
        many = lengths > 1
        return cols, starts[many], lengths[many]

    waiting = []  # batches of one bucket that isn't complete
    for cols in _columns(batches, width):
        waiting.append(cols)
        if waiting[0][0][0] == cols[0][-1]:
            continue
        held = [np.concatenate(x) for x in zip(*waiting)]
        done = int(np.searchsorted(held[0], held[0][-1]))
        waiting = [[c[done:] for c in held]]
        yield whole([c[:done] for c in held])
    if waiting:
        yield whole([np.concatenate(x) for x in zip(*waiting)])


def _all_pairs(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of rows of one bucket, about BLOCK * BLOCK at a time."""
    out, size = [], 0
    for s, m in zip(starts.tolist(), lengths.tolist()):
        for x in range(s, s + m, BLOCK):
            for y in range(x, s + m, BLOCK):
                i, j = np.meshgrid(np.arange(x, min(x + BLOCK, s + m)), np.arange(y, min(y + BLOCK, s + m)), indexing="ij")
                less = i < j
                out.append((i[less], j[less]))
                size += len(out[-1][0])
                if size > BLOCK * BLOCK:
                    yield tuple(map(np.concatenate, zip(*out)))
                    out, size = [], 0
    if out:
        yield tuple(map(np.concatenate, zip(*out)))


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (the first row of each one's group) once rows i and j are of one group."""
    while (off := label[i] != label[j]).any():
        i, j = i[off], j[off]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (further := to[to] != to).any():
            to = to[to]
        label = to[label]
    return label


def _labels(cols: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each row the first of its group: the rows of a bucket that pairs which may be similar
    join, directly or not."""
    label = np.arange(len(cols[0]))
    for i, j in _all_pairs(starts, lengths):
        label = _merged(label, *_open(cols, i, j))
    return label


def _groups(width: int):
    """For rows (s, size, cls, comp, counts) sorted by s, counts of ``width`` cells: (s, m, cls,
    comp) of each member of a group; s names the group by its m members, so that a group which is
    found in many buckets is one. A bucket gives no more rows than it has,
    whatever the number of its pairs. Holds one batch and one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts, lengths in _buckets(batches, width):
            label = _labels(cols, starts, lengths)
            rows = np.nonzero(np.bincount(label)[label] > 1)[0]
            rows = rows[np.lexsort((cols[2][rows], label[rows]))]
            first = np.nonzero(np.diff(label[rows], prepend=-1))[0]
            m = np.diff(np.append(first, len(rows)))
            cls = np.ascontiguousarray(cols[2][rows])
            names = np.array([xxhash.xxh64_intdigest(cls[a : a + k].tobytes()) for a, k in zip(first.tolist(), m.tolist())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(names, m), np.repeat(m, m), cls, cols[3][rows])], MEMBER)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (s, size, cls, comp, cells) sorted by s: (a, b) of the first of a group by all
    cells and each other member. A bucket gives fewer rows than it has."""
    for cols, starts, lengths in _buckets(batches, CELLS):
        label = _labels(cols, starts, lengths)
        off = np.nonzero(label != np.arange(len(label)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(cols[2][label[off]]), pa.array(cols[2][off])], ["a", "b"])


def _spanning(cls: np.ndarray, comp: np.ndarray, sets: list[bytes]) -> tuple[list[int], list[int]]:
    """Links (a, b) of similar sets that join whatever such links and common components join.
    A set is compared with those only that nothing has reached, so there are fewer links than
    sets."""
    held = [np.frombuffer(x, np.int64) for x in sets]
    n = np.array([len(x) for x in held])
    cells = np.stack([np.bincount(x & (CELLS - 1), minlength=CELLS) for x in held])
    cells = cells.astype(np.min_scalar_type(cells.max()))
    left, a, b = np.arange(len(held)), [], []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            f = front.pop()
            same = comp[left] == comp[f]
            front += left[same].tolist()
            left = left[~same]
            i = left[OF * np.minimum(n[left], n[f]) >= LEAST * np.maximum(n[left], n[f])]
            i = i[(OF + LEAST) * np.minimum(cells[i], cells[f]).sum(1, dtype=np.int64) >= LEAST * (n[i] + n[f])]
            if not len(i):
                continue
            every = np.concatenate([held[k] for k in i])
            found = held[f][np.minimum(np.searchsorted(held[f], every), n[f] - 1)] == every
            both = np.add.reduceat(found, np.cumsum(n[i]) - n[i], dtype=np.int64)
            i = i[OF * both >= LEAST * (n[i] + n[f] - both)]
            a += [int(cls[f])] * len(i)
            b += cls[i].tolist()
            front += i.tolist()
            left = left[np.isin(left, i, invert=True)]
    return a, b


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (s, size, cls, comp, set) sorted by s: the links of each s's spanning forest. Holds
    one batch and one s."""
    for cols, starts, lengths in _buckets(batches, 0):
        a, b = [], []
        for at, m in zip(starts.tolist(), lengths.tolist()):
            x, y = _spanning(*(c[at : at + m] for c in cols[2:]))
            a += x
            b += y
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def by_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` of large groups s in ``blocks`` (1: as they are) parts; each pair of parts is a
    group of its own."""
    k = F.col("_k")
    cut = rows.withColumn("_k", blocks.cast("long")).withColumn("_b", F.pmod(F.xxhash64("cls"), k))
    met = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.least(j, F.col("_b")) * k + F.greatest(j, F.col("_b")))
    many = cut.filter("_k > 1").withColumn("_p", F.explode(met)).withColumn("s", F.xxhash64("s", "_p"))
    return cut.filter("_k = 1").select(rows.columns).unionByName(many.select(rows.columns))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["cls", "set"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with sizes m and n and cells x and y: those whose cells don't rule out that
    they are similar. What two sets share is at most the sum of the smaller counts."""
    for batch in batches:
        both = batch.filter(pc.and_(batch.column("x").is_valid(), batch.column("y").is_valid()))
        x, y = (np.frombuffer(b"".join(both.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("x", "y"))
        m, n = (both.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("m", "n"))
        most = np.minimum(x, y).sum(1, dtype=np.int64)
        yield both.filter(pa.array((OF + LEAST) * most >= LEAST * (m + n))).select(["a", "b"])
        yield batch.filter(pc.or_(batch.column("x").is_null(), batch.column("y").is_null())).select(["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, x, y) whose sets x and y are similar enough."""
    for part in by_bytes(batches, "x"):
        keep = []
        for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist()):
            u, v = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(OF * both >= LEAST * (len(u) + len(v) - both))
        yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def simhash_pairs(classes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """(a, b) of classes(cls, fp): classes of one fingerprint with the first of it, and links of
    the covering tables between the first ones."""
    firsts = classes.groupBy("fp").agg(F.min("cls").alias("id"))
    same = classes.join(firsts, "fp").filter("cls != id").select(F.col("id").alias("a"), F.col("cls").alias("b"))
    return same.unionByName(simhash.links(firsts, radius)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(key): ``row_key`` of the rows to drop, so that of each component of near copies one row
    stays, with the smallest doc_id (null last), then the smallest key. Texts without a word are
    copies of each other, null ones too; rows that repeat doc_id and text stay or go together."""
    rows = written(described(docs, frequent(docs)), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    same = (F.first(c).alias(c) for c in ("n", "fp", "cells", "sketch", "prefix"))  # equal in all rows of a class, but for fp
    classes = written(rows.groupBy("cls").agg(best, F.count("*").alias("rows"), *same), "near-classes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_bucket(df: DataFrame) -> DataFrame:
        # sizes without the places, so that the buckets of a group have one order and give the same pairs
        return df.repartition(n, "s").sortWithinPartitions("s", F.shiftright("size", 32), "cls")

    spread = classes.select(F.posexplode("prefix").alias("pos", "s"), "n", "cls")
    spread = spread.select("s", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("size"), "cls")
    shared = written(by_bucket(spread).transform(bounded).mapInArrow(_shared, ", ".join(f"{c} long" for c in ROW)), "near-buckets")

    def sets_of(some: DataFrame) -> DataFrame:
        """(cls, set) of the classes named, by a row of each."""
        wanted = written(some.distinct().join(classes, "cls").select("cls", F.col("best.key").alias("key")), "near-wanted")
        few = wanted.count() <= BROADCAST
        held = _texts(docs).join(F.broadcast(wanted) if few else wanted, "key").dropDuplicates(["cls"]).select("cls", "text")
        return written(held.transform(bounded).mapInArrow(_sets, "cls long, set binary"), "near-sets")

    def verified(found: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar, by the sets of a row of each."""
        both = found.distinct()
        for end, size, cells in (("a", "m", "x"), ("b", "n", "y")):
            both = both.join(classes.select(F.col("cls").alias(end), F.col("n").alias(size), F.col("cells").alias(cells)), end)
        pairs = written(both.select("a", "b", "m", "n", "x", "y").transform(bounded).mapInArrow(_possible, PAIR), "near-pairs")
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")))
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
        return written(both.select("a", "b", "x", "y").transform(bounded).mapInArrow(_similar, PAIR), "near-links")

    links = verified(simhash_pairs(classes.select("cls", "fp")).unionByName(by_bucket(shared).transform(bounded).mapInArrow(_first_pairs, PAIR)))
    joined = written(components(links).select(F.col("node").alias("cls"), "component"), "near-joined")
    rest = written(shared.join(joined, "cls", "left").select(*ROW, F.coalesce("component", "cls").alias("comp")), "near-rest")
    # buckets with classes that aren't joined yet
    mixed = rest.groupBy("s").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("s", "m")
    rest = join_hot(rest, written(mixed, "near-mixed"), "s", "m", rest.count(), "inner")
    rest = rest.join(classes.select("cls", "sketch"), "cls")
    # groups by the smaller counts, once each; what all cells leave of them, as clusters
    most, half = BLOCK * BLOCKS, BLOCK * BLOCKS // 2
    blocks = F.when(F.col("m") > most, F.ceil(F.col("m") / half)).otherwise(1)
    member = ", ".join(f"{c} long" for c in MEMBER)
    rest = by_blocks(rest, blocks).select(COMP)
    groups = by_bucket(rest).transform(bounded).mapInArrow(_groups(SKETCH), member).distinct()
    counts = classes.select("cls", F.shiftleft(F.col("n").cast("long"), 32).alias("size"), F.coalesce("cells", F.lit(b"\xff" * CELLS)).alias("cells"))
    groups = by_blocks(written(groups, "near-groups").join(counts, "cls"), blocks).select("s", "size", "cls", "comp", "cells")
    stars = written(by_bucket(groups).transform(bounded).mapInArrow(_stars, PAIR), "near-stars")
    clusters = written(components(stars).select(F.col("node").alias("cls"), F.col("component").alias("s")), "near-clusters")
    sizes = classes.join(clusters, "cls").groupBy("s").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    placed = join_hot(clusters, written(sizes, "near-sizes"), "s", "m", clusters.count(), "inner").join(joined, "cls", "left")
    placed = placed.join(sets_of(clusters.select("cls")), "cls").withColumn("size", F.shiftleft(F.octet_length("set").cast("long"), 29))
    parts = F.greatest(blocks, F.when(F.col("total") > SHINGLES, F.ceil(F.col("total") / (SHINGLES // 2))).otherwise(1))
    placed = by_blocks(placed.withColumn("comp", F.coalesce("component", "cls")), parts).select("s", "size", "cls", "comp", "set")
    links = written(by_bucket(placed).transform(bounded).mapInArrow(_forest, PAIR), "near-links")
    for end in ("a", "b"):  # between components of the first links
        links = links.join(joined.select(F.col("cls").alias(end), F.col("component").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    found = written(components(links), "near-components").withColumnRenamed("component", "_c")
    placed = classes.select("cls", "best", "rows").join(joined, "cls", "left").withColumn("node", F.coalesce("component", "cls"))
    placed = placed.join(found, "node", "left").select("cls", "best", "rows", F.coalesce("_c", "node").alias("component"))
    kept = placed.groupBy("component").agg(F.min("best").alias("kept"))
    named = placed.join(kept, "component").select("cls", "rows", F.col("kept.key").alias("kept"))
    out = join_hot(rows.select("key", "cls"), named, "cls", "rows", rows.count(), "inner")
    return out.filter("key != kept").select("key").distinct()
