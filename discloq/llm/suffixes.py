"""Repeated substrings by difference-cover suffix sorting, for texts of many documents.

Which 50-byte strings occur in several documents is found in five steps. Texts are first written
once, as compressed chunks of whole documents, each with a number.

1. Every 50-byte string has an anchor: of its 24-byte pieces the one with the least hash, the
   first of equal ones. Equal strings have equal anchors at the same place. The cells of anchors
   (hashes, of more bits the larger the input is) go to tasks by range, which see those that two
   documents have; only their strings can repeat.
2. Which anchors those are goes back to the chunks, by chunk number.
3. The chunks send the surroundings of such anchors to the task that has their range. So equal
   strings meet in a task, and all tasks together hold each string that can repeat.
4. Each task sorts the suffixes of the different surroundings by a difference cover modulo 3:
   it sorts the sampled triples, recurses on their names, merges the remaining suffixes and
   compares adjacent prefixes. Equal prefixes get the smallest document that has one.
5. What a document loses goes back to its chunk.

Rows move as packed arrays, a few for each pair of tasks. Nothing is broadcast but the cells of
very many documents, which are few by their definition; those are resolved apart: their different
surroundings are aggregated first, and documents join the result through a join that is safe for
hot keys. Tasks work on one range (about RANGE bytes of text) at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import by_bytes
from discloq.llm.common import join_hot, table
from discloq.session import written

LENGTH, PIECE = 50, 24
SPAN = LENGTH - PIECE + 1
#: Bytes of text for each range of hashes: what a task works on at a time.
RANGE = 1 << 23
#: Ranges go to so many tasks at most; a task takes its ranges one after the other.
MOST_TASKS = 20_000
#: An anchor of more documents than this, and than one in 2**HOT_BITS of all bytes of text, is
#: hot. So at most 2**HOT_BITS cells are hot, and below a task holds some 60 bytes for each.
HOT_DOCS, HOT_BITS = 100_000, 21
#: Bytes of surroundings that are sorted at a time.
CHUNK = 1 << 19
#: Where the numbers begin that order rows without a doc_id, by a hash, after all others.
NO_DOC = 1 << 62
U = np.uint64


# --- suffix sorting ---------------------------------------------------------------------------


def _bits(top: int) -> int:
    return max(1, int(top).bit_length())


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Order of keys below 2**bits. Where key and place fit into one number, numbers are sorted."""
    room = _bits(len(key))
    if bits + room > 63:
        return np.argsort(key, kind="stable")
    packed = key << room
    packed |= np.arange(len(key))
    packed.sort()
    packed &= (1 << room) - 1
    return packed


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, int, np.ndarray]:
    """Dense ranks (from 1) of rows compared column by column, how many, and their order."""
    room, key, bits = _bits(len(columns[0])), columns[0], _bits(columns[0].max())
    for k, c in enumerate(columns[1:]):
        more = _bits(c.max())
        if bits + more + room > 63 and k:
            key, top, _ = _ranked(key, bits)
            bits = _bits(top)
        key, bits = key << more | c, bits + more
    return _ranked(key, bits)


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, int, np.ndarray]:
    order = _order(key, bits)
    ordered = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(key), np.int64)
    np.cumsum(new, out=new)
    out[order] = new
    return out, int(new[-1]), order


def suffix_order(s: np.ndarray, depth: int = 1 << 60) -> np.ndarray:
    """Starts of the suffixes of ``s`` (numbers from 1 up) in lexicographic order, by the
    difference cover {1, 2} modulo 3. Suffixes that agree in the first ``depth`` numbers or
    more may come in any order among themselves."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([s.astype(np.int64), [0, 0, 0]])
    one = np.arange(1, n + (n % 3 == 1), 3)  # with one past the end, the blocks of names part
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names, different, order12 = _names([t[sample], t[sample + 1], t[sample + 2]])
    if different < len(sample) and depth > 3:
        order12 = suffix_order(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order12]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order12]
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    size = n + 3
    zero = zero[_order(t[zero] * size + rank[zero + 1], _bits((int(t.max()) + 1) * size))]
    # how many sampled suffixes come before each other one: mod 1 by (number, rank of the next),
    # mod 2 by (two numbers, rank of the one after)
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before = np.searchsorted(np.sort(t[ones] * size + rank[ones + 1]), t[zero] * size + rank[zero + 1])
    both = np.concatenate([twos, zero])
    pair, _, _ = _names([t[both], t[both + 1]])
    key = pair * size + rank[both + 2]
    before += np.searchsorted(np.sort(key[: len(twos)]), key[len(twos) :])
    before = np.maximum.accumulate(before) if len(before) else before  # differs only among suffixes that agree to the depth
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted12
    return out


def least_documents(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each context i, whose strings of ``length`` bytes start at the first ``counts[i]``
    places from ``starts[i]`` in ``data``: the smallest of ``docs`` of contexts that have the
    same string, for one string after the other, and where those of each context begin."""
    first = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(starts - first[:-1], counts) + np.arange(first[-1])
    doc = np.repeat(docs, counts)
    s = data.astype(np.int64) + 1
    slot = np.full(len(data), -1, np.int64)
    slot[where] = np.arange(len(where))
    order = suffix_order(s, length)
    ranked = slot[order]
    ranked = ranked[ranked >= 0]
    at = where[ranked]
    words = np.zeros(len(data) + length, U)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(U)
    for k in range(8):
        words |= padded[k : k + len(words)] << U(8 * k)
    equal = np.ones(max(0, len(at) - 1), bool)
    for k in (*range(0, length - 7, 8), length - 8):
        w = words[at + k]
        equal &= w[1:] == w[:-1]
    heads = np.concatenate([[True], ~equal]) if len(at) else np.zeros(0, bool)
    group = np.cumsum(heads) - 1
    least = np.minimum.reduceat(doc[ranked], np.nonzero(heads)[0]) if len(at) else doc
    out = np.empty(len(where), np.int64)
    out[ranked] = least[group] if len(at) else least
    return out, first


# --- anchors ----------------------------------------------------------------------------------


def _hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the PIECE = 16 + 8 bytes from each place, by doubling."""
    h = (a.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    for span, k in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (4, 0xD6E8FEB86659FD93), (8, 0xA0761D6478BD642F)):
        eight = h
        h = h[:-span] * U(k) + h[span:]
        h ^= h >> U(31)
    n = len(a) - PIECE + 1
    h = h[:n] * U(0xE7037ED1A0B428DB) + eight[16 : 16 + n]
    h ^= h >> U(31)
    h *= U(0x8EBC6AF09C88C6E3)
    h ^= h >> U(32)
    return h


def anchors(joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (``starts`` has their bounds): for each anchor its hash, its
    place, the first of the strings that have it, how many they are, and its document; then
    the hashes of all places."""
    none = (np.zeros(0, U), *[np.zeros(0, np.int64)] * 4, np.zeros(0, U))
    if len(joined) < LENGTH:
        return none
    h = _hashes(joined)
    low = U((1 << 24) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=U)  # batches are below 2**24 bytes, or one text
    k = 1
    while 2 * k <= SPAN:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: len(least) - (SPAN - k)], least[SPAN - k :])
    sizes = np.diff(starts) - LENGTH + 1
    sizes[sizes < 0] = 0
    total = int(sizes.sum())
    if not total:
        return none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    window = np.arange(total) + np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    at = (least[window] & low).astype(np.int64)
    new = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))[0]
    place = at[new]
    # least hashes are small: mixed anew, so that cells and ranges fill evenly
    return (h[place] ^ (h[place] >> U(31))) * U(0xD1342543DE82EF95), place, window[new], np.diff(np.append(new, total)), doc[new], h


#: Longer texts are cut into overlapping parts: each string lies in one of them, with its anchor.
PART = 1 << 19


def parts_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, row of each document, offset in its text) for groups of whole texts, or
    parts of one long text that overlap by LENGTH - 1."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def packed():
        sizes = [len(b) for b, _, _ in held]
        return (np.frombuffer(b"".join(b for b, _, _ in held), np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([r for _, r, _ in held]), np.array([o for _, _, o in held]))

    for row, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PART):
            piece = text[a : a + PART + LENGTH - 1]
            held.append((piece, row, a))
            size += len(piece)
            if size >= PART:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


# --- chunks -----------------------------------------------------------------------------------


def _packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of fixed types as one compressed value, the first bytes of all numbers first."""
    out = b"".join(np.array([len(x)], "<i8").tobytes() + np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=level).compress(out)


def _unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t in types:
        n, size = int(np.frombuffer(data, "<i8", 1, at)[0]), np.dtype(t).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel() if n else np.zeros(0, t))
        at += 8 + n * size
    return out


BLOB = "bucket int, blob binary"
FLUSH = 1 << 19
CHUNK_TYPES = ("u1", "<i8", "<i8", "<i8", "u1")


def _blobs(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _split(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    arrays = tuple(x[order] for x in arrays)
    found, first = np.unique(bucket[order], return_index=True)
    for b, a, z in zip(found.tolist(), first.tolist(), [*first.tolist()[1:], len(bucket)]):
        yield b, [x[a:z] for x in arrays]


def _columns(held: list[tuple]) -> list[np.ndarray]:
    """The held arrays put together; they are let go of."""
    out = [np.concatenate(c) for c in zip(*held)]
    held.clear()
    return out


def _home(chunk, buckets: int):
    """The bucket of a chunk."""
    return (chunk ^ (chunk >> 32)) % buckets


def chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, blob): whole documents, about PART bytes to a chunk; each with whether it
    has a doc_id, its doc_id, its place in the order of documents and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def packed():
            nonlocal made
            known = np.array([i is not None for i, _, _ in held], np.uint8)
            ids = np.array([i or 0 for i, _, _ in held], "<i8")
            blob = _packed(known, ids, np.array([d for _, d, _ in held], "<i8"), np.array([len(t) for *_, t in held], "<i8"), np.frombuffer(b"".join(t for *_, t in held), np.uint8), level=5)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), pa.array([_home(task + made, buckets)], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "bucket", "blob"])

        for batch in by_bytes(batches, "text", PART):
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc", "text"))):
                held.append(row)
                size += len(row[2]) + 64
                if size >= PART:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    nameless = F.lit(NO_DOC) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(NO_DOC))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc"), body.alias("text"))
    return written(rows.mapInArrow(run, "chunk long, bucket int, blob binary"), "suffix-chunks")


class Chunk:
    """Documents of a chunk, and the anchors of each of its groups of parts in their order."""

    def __init__(self, blob: bytes):
        known, ids, self.doc, sizes, data = _unpacked(blob, *CHUNK_TYPES)
        self.ids = [i if k else None for i, k in zip(ids.tolist(), known.tolist())]
        ends = np.cumsum(sizes)
        raw = data.tobytes()
        self.texts = [raw[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist())]

    def groups(self):
        yield from parts_of(self.texts)


def _first_of(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of cells ``h`` in documents ``doc``: where each different pair is first, and for each row
    its pair."""
    key = (h + U(1)) * U(0x9E3779B97F4A7C15) ^ (doc.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
    _, first, pair = np.unique(key ^ (key >> U(32)), return_index=True, return_inverse=True)
    return first, pair


# --- which anchors can repeat -----------------------------------------------------------------

#: What a blob of cells holds: kind, cells as steps, how many documents of the sender have each,
#: the sender's place (an index of its chunks and an anchor there) where only one has it.
CELLS = ("<u8", "<u4", "<u2", "<u4", "<i8")
NOWHERE = 0xFFFF
#: What a blob of answers holds: chunks, and anchors of them that can repeat.
ANSWERS = ("<i8", "<u4")


def repeated_anchors(parts: DataFrame, bits: int, buckets: int, tasks: int, hot: int) -> DataFrame:
    """(bucket, blob, hot): by the bucket of their chunks, the anchors that can repeat; and, apart,
    the cells of more than ``hot`` documents.

    A sender names each cell once. One that two of its own documents have it marks as repeated
    by itself and says so to the task of the cell, so no task gets a cell of many documents
    more often than there are senders.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, chunk, place = _columns(held)
            order = np.argsort(h, kind="stable")
            h, chunk, place = h[order], chunk[order], place[order]
            heads = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
            n = np.diff(np.append(heads, len(h)))
            several = np.repeat(n > 1, n)
            out = []
            for b, (c, p) in _split(_home(chunk[several], buckets), chunk[several], place[several].astype("<u4")):
                out.append((b, b"a" + _packed(c, p)))  # answers: they only pass through
            one = n == 1
            range_of = ((h[heads] >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            for b, (cell, k, c, p, alone) in _split(range_of, h[heads] >> U(64 - bits), n, chunk[heads], place[heads], one):
                named, index = np.unique(c, return_inverse=True)
                index[~alone], p[~alone] = NOWHERE, 0
                out.append((b, b"c" + _packed(np.diff(cell, prepend=U(0)), k.astype("<u4"), index.astype("<u2"), p.astype("<u4"), named)))
            return _blobs([b for b, _ in out], [x for _, x in out])

        for batch in batches:
            for number, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                before = 0
                for joined, starts, owner, _ in Chunk(blob).groups():
                    h, _, _, _, doc, _ = anchors(joined, starts)
                    first, _ = _first_of(h >> U(64 - bits), owner[doc])
                    held.append(((h[first] >> U(64 - bits)) << U(64 - bits), np.full(len(first), number), first + before))
                    before += len(h)
                    size += len(first)
                if size >= FLUSH or len(held) > 4096:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merged(blobs: list[bytes]) -> Iterator[tuple[int, bytes | None, bytes | None]]:
        cell, n, chunk, place = [], [], [], []
        for x in blobs:
            steps, k, index, p, named = _unpacked(x, *CELLS)
            cell.append(np.cumsum(steps, dtype=U))
            n.append(k)
            chunk.append(np.append(named, -1)[np.where(index == NOWHERE, len(named), index)])
            place.append(p)
        cell, n, chunk, place = (np.concatenate(c) for c in (cell, n, chunk, place))
        order = np.argsort(cell, kind="stable")
        cell, chunk, place = cell[order], chunk[order], place[order]
        heads = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
        total = np.add.reduceat(n[order].astype(np.int64), heads)
        many = cell[heads][total > hot]
        if len(many):
            yield 0, None, many.astype("<u8").tobytes()
        ask = np.repeat(total > 1, np.diff(np.append(heads, len(cell)))) & (chunk >= 0)
        for b, (c, p) in _split(_home(chunk[ask], buckets), chunk[ask], place[ask]):
            yield b, _packed(c, p), None

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "blob", "hot"])

        for b, blobs in _by_bucket(batches, "blob"):
            passed = [(b, x[1:], None) for x in blobs if x[:1] == b"a"]
            if passed:
                yield out(passed)
            mine = [x[1:] for x in blobs if x[:1] == b"c"]
            if mine:
                yield out(list(merged(mine)))

    dealt = parts.select("chunk", "blob").mapInArrow(count, BLOB).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(merge, BLOB + ", hot binary"), "suffix-anchors")


def _by_bucket(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[bytes]]]:
    """The values of each bucket, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, x in zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist()):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(x)
    if held:
        yield now, held


# --- surroundings -----------------------------------------------------------------------------


def _code(hashes: np.ndarray, place, first, count) -> np.ndarray:
    """A hash of surroundings and of the anchor's place in them. They are at most
    2 LENGTH - PIECE = 76 bytes: pieces at four places cover them."""
    last, code = first + count + LENGTH - 1 - PIECE, place.astype(U) - first.astype(U) + (count.astype(U) << U(8))
    for k in range(4):
        code = (code ^ hashes[np.minimum(first + k * PIECE, last)]) * U(0x9FB21C651E98DF25)
        code ^= code >> U(31)
    return code


def _gather(joined: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - first
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return joined[np.repeat(first - begin[:-1], sizes) + np.arange(begin[-1])]


TYPES = ("<u8", "<u4", "<u2", "<i8", "<i8", "<u4", "<i8", "u1", "u1", "u1")


def _mine(held: list[tuple]) -> list[np.ndarray]:
    """Columns of the held rows: anchor, code, doc, chunk, index there, start, count, has bytes,
    bounds of its bytes, bytes; bytes only with the first row of each code."""
    h, code, doc, chunk, index, start, count, data, sizes = _columns(held)
    order = np.lexsort((doc, code, h))
    first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (code[order][1:] != code[order][:-1])])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    return [h[order], code[order], doc[order], chunk[order], index[order], start[order], count[order].astype(np.uint8), first, begin[:-1][order], sizes[order], data]


def repeated_strings(h, code, doc, count, has, data):
    """Distinct (anchor, code) of rows sorted by them, each row's number among them, and for each
    the smallest documents of its strings: (numbers, least, begin) or, where nothing repeats,
    least is the document itself."""
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])])
    number = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    least = np.minimum.reduceat(doc, heads)
    width = count[heads].astype(np.int64)
    sizes = width + LENGTH - 1
    # bytes come with some row of each code; sizes follow from the counts
    source = np.nonzero(has)[0]
    begin = np.concatenate([[0], np.cumsum(count[source].astype(np.int64) + LENGTH - 1)])
    start = np.empty(len(heads), np.int64)
    start[number[source][::-1]] = begin[:-1][::-1]
    anchor = np.cumsum(np.concatenate([[True], h[heads][1:] != h[heads][:-1]])) - 1
    many = np.bincount(anchor)[anchor] > 1
    first = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(least, width)
    if many.any():
        some = np.nonzero(many)[0]
        # anchors are independent: about CHUNK bytes of surroundings are sorted at a time
        block = np.cumsum(sizes[some]) // CHUNK
        whole = np.nonzero(np.diff(anchor[some]) != 0)[0] + 1
        cuts = np.unique(np.concatenate([[0], whole[np.diff(block[whole], prepend=0) != 0], [len(some)]]))
        for a, z in zip(cuts[:-1], cuts[1:]):
            i = some[a:z]
            text = _gather(data, start[i], start[i] + sizes[i])
            places = np.concatenate([[0], np.cumsum(sizes[i])])[:-1]
            found, begins = least_documents(text, places, width[i], least[i])
            out[np.repeat(first[i] - begins[:-1], width[i]) + np.arange(begins[-1])] = found
    return number, out, first


def _spans(number, doc, chunk, index, start, count, least, first):
    """(chunk, index, from, to) of what documents lose to smaller ones."""
    width = count.astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(width)])
    slots = np.repeat(first[number] - begin[:-1], width) + np.arange(begin[-1])
    lost = least[slots] < np.repeat(doc, width)
    owner = np.repeat(np.arange(len(doc)), width)
    edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    on = np.nonzero(lost & (edge | ~np.concatenate([[False], lost[:-1]])))[0]
    last = np.concatenate([edge[1:], [True]]) if len(owner) else edge
    off = np.nonzero(lost & (last | ~np.concatenate([lost[1:], [False]])))[0]
    who = owner[on]
    return chunk[who], index[who], start[who] + on - begin[who], start[who] + off - begin[who] + LENGTH


SPANS = ("<i8", "<u4", "<i8", "<i8")


def _span_blobs(chunk, index, a, z, buckets):
    out = [(b, _packed(*x)) for b, x in _split(_home(chunk, buckets), chunk.astype("<i8"), index.astype("<u4"), a.astype("<i8"), (z - a).astype("<i8"))]
    return _blobs([b for b, _ in out], [x for _, x in out])


def _with_rows(batches: Iterator[pa.RecordBatch], types: tuple) -> Iterator[tuple[int, Chunk, list[np.ndarray]]]:
    """From rows (bucket, kind, chunk, blob) sorted by bucket and kind, blobs before chunks: each
    chunk with its number and the blobs' rows of it, without the chunk's number."""
    now, held, ready = None, [], None
    for batch in batches:
        for b, number, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "blob"))):
            if b != now:
                now, held, ready = b, [], None
            if number is None:
                held.append(blob)
                continue
            if ready is None:
                cols = [np.concatenate(c) for c in zip(*(_unpacked(x, *types) for x in held))] if held else [np.zeros(0, t) for t in types]
                order = np.argsort(cols[0], kind="stable")
                held, ready = [], [c[order] for c in cols]
            lo, hi = (int(np.searchsorted(ready[0], number, side)) for side in ("left", "right"))
            yield number, Chunk(blob), [c[lo:hi] for c in ready[1:]]


def _laid(parts: DataFrame, blobs: DataFrame, tasks: int) -> DataFrame:
    """Chunks and the blobs for them, as ``_with_rows`` takes them."""
    mine = parts.select("bucket", F.lit(1).alias("kind"), "chunk", "blob")
    more = blobs.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "blob")
    return mine.unionByName(more).repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").drop("kind")


def _scan(hot, bits: int, buckets: int, want_hot: bool, emit):
    """Rows of anchors that can repeat, with their surroundings: hot ones, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = hot.value
        held, size = [], 0
        for number, chunk, (wanted,) in _with_rows(batches, ANSWERS):
            before = 0
            wanted = np.sort(wanted).astype(np.int64)
            for joined, starts, owner, offset in chunk.groups():
                h, place, first, count, doc, hashes = anchors(joined, starts)
                lo, hi = np.searchsorted(wanted, [before, before + len(h)])
                mine = wanted[lo:hi] - before
                before += len(h)
                if not len(mine):
                    continue
                cell, who = h >> U(64 - bits), owner[doc]
                _, pair = _first_of(cell, who)
                asked = np.zeros(int(pair.max()) + 1, bool)
                asked[pair[mine]] = True
                keep = asked[pair]
                if len(cells):
                    keep &= (cells[np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell) == want_hot
                elif want_hot:
                    keep[:] = False
                if not keep.any():
                    continue
                h, place, first, count, doc, who = (x[keep] for x in (h, place, first, count, doc, who))
                end = first + count + LENGTH - 1
                held.append((h, _code(hashes, place, first, count), chunk.doc[who], np.full(len(h), number), who, first - starts[doc] + offset[doc], count, _gather(joined, first, end), end - first))
                size += len(h)
            if size > FLUSH // 2:
                yield emit(_mine(held), bits, buckets)
                size = 0
        if size:
            yield emit(_mine(held), bits, buckets)

    return run


def _emit_packed(cols, bits, buckets):
    """Buckets are ranges of the anchor's hash, of which rows hold the steps of bits + 8 bits,
    and 48 bits of the code."""
    h, code, doc, chunk, index, start, count, first, begin, sizes, data = cols
    range_of = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    short = h >> U(max(0, 56 - bits))
    out = []
    for b, (i,) in _split(range_of, np.arange(len(h))):
        with_bytes = i[first[i]]
        text = _gather(data, begin[with_bytes], begin[with_bytes] + sizes[with_bytes])
        steps = np.diff(short[i], prepend=U(0))
        out.append((b, _packed(steps, (code[i] >> U(32)).astype("<u4"), (code[i] >> U(16) & U(0xFFFF)).astype("<u2"), doc[i].astype("<i8"), chunk[i].astype("<i8"), index[i].astype("<u4"), start[i].astype("<i8"), count[i], first[i].astype(np.uint8), text)))
    return _blobs([b for b, _ in out], [x for _, x in out])


def _solve_packed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches, "blob"):
            yield _span_blobs(*_solved([_unpacked(x, *TYPES) for x in blobs]), buckets)

    return run


def _solved(parts: list[list[np.ndarray]]):
    """What documents lose by the rows of one bucket; bytes are put in the order of rows first."""
    h = np.concatenate([np.cumsum(p[0], dtype=U) for p in parts])
    code = np.concatenate([p[1].astype(U) << U(16) | p[2].astype(U) for p in parts])
    doc, chunk, index, start, count, has, data = (np.concatenate([p[k] for p in parts]) for k in range(3, 10))
    has = has.astype(bool)
    sizes = np.where(has, count.astype(np.int64) + LENGTH - 1, 0)
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    order = np.lexsort((code, h))
    # anchors of one document only lose nothing
    ordered = h[order]
    heads = np.nonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))[0]
    n = np.diff(np.append(heads, len(order)))
    several = np.repeat(np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads), n)
    order = order[several]
    if not len(order):
        return [np.zeros(0, np.int64)] * 4
    keep = has[order]
    text = _gather(data, begin[order][keep], (begin + sizes)[order][keep])
    number, least, first = repeated_strings(h[order], code[order], doc[order], count[order], keep, text)
    return _spans(number, doc[order], chunk[order], index[order], start[order], count[order], least, first)


# --- hot anchors ------------------------------------------------------------------------------

HOT_ROW = "anchor long, code long, doc long, chunk long, index long, start long, count int, body binary"
PLACE = ("doc", "chunk", "index", "start", "count")


def _emit_rows(cols, bits, buckets):
    h, code, doc, chunk, index, start, count, first, begin, sizes, data = cols
    raw = data.tobytes()
    bodies = [raw[a : a + n] if f else None for a, n, f in zip(begin.tolist(), sizes.tolist(), first.tolist())]
    values = [pa.array(x) for x in (h.view(np.int64), code.view(np.int64), doc, chunk, index.astype(np.int64), start, count.astype(np.int32))]
    return pa.RecordBatch.from_arrays([*values, pa.array(bodies, pa.binary())], ["anchor", "code", *PLACE, "body"])


def _solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = list(batches)
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    h, code = (t[c].to_numpy().view(U) for c in ("anchor", "code"))
    doc, count = t["doc"].to_numpy(), t["count"].to_numpy()
    bodies = t["body"].to_pylist()
    order = np.lexsort((code, h))
    data = np.frombuffer(b"".join(bodies[i] for i in order.tolist()), np.uint8)
    number, least, first = repeated_strings(h[order], code[order], doc[order], count[order], np.ones(len(order), bool), data)
    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(least))
    heads = order[np.concatenate([[True], number[1:] != number[:-1]])]
    yield pa.RecordBatch.from_arrays([pa.array(h[heads].view(np.int64)), pa.array(code[heads].view(np.int64)), lists], ["anchor", "code", "least"])


def _lose_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, chunk, index, start, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE)
            least = batch.column("least").flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
            yield _span_blobs(*_spans(np.arange(len(doc)), doc, chunk, index, start, count, least, first), buckets)

    return run


def hot_spans(laid: DataFrame, hot, bits: int, buckets: int, tasks: int) -> DataFrame:
    """What documents lose by hot anchors, as blobs of spans. Surroundings are reduced to the
    different ones before they meet."""
    found = written(laid.mapInArrow(_scan(hot, bits, buckets, True, _emit_rows), HOT_ROW), "suffix-hot")
    key = F.xxhash64("anchor", "code")
    different = found.filter("body is not null").groupBy("anchor", "code").agg(F.min("doc").alias("doc"), F.first("count").alias("count"), F.first("body").alias("body"))
    solved = different.repartition(tasks, "anchor").mapInArrow(_solve_rows, "anchor long, code long, least array<long>").select(key.alias("key"), "least")
    mine = found.select(key.alias("key"), *PLACE)
    sizes = mine.groupBy("key").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(mine, solved.join(sizes, "key"), "key", "n", total, "inner")
    return joined.select(*PLACE, "least").mapInArrow(_lose_rows(buckets), BLOB)


# --- the operator -----------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else []))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]
        for _, chunk, (index, start, size) in _with_rows(batches, SPANS):
            out = []
            order = np.lexsort((start, index))
            index, start, stop = index[order], start[order], (start + size)[order]
            bounds = np.searchsorted(index, np.arange(len(chunk.texts) + 1)).tolist()
            for doc_id, text, lo, hi in zip(chunk.ids, chunk.texts, bounds, bounds[1:]):
                removed = runs = 0
                kept = text
                if hi > lo:
                    a, z = start[lo:hi], np.maximum.accumulate(stop[lo:hi])
                    new = np.concatenate([[True], a[1:] > z[:-1]])
                    begin, end = a[new], np.append(z[np.nonzero(new)[0][1:] - 1], z[-1])
                    removed, runs = int((end - begin).sum()), len(begin)
                    kept = b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)]))
                out.append((doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False, hot_docs: int = HOT_DOCS, range_bytes: int = RANGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (with ``keep_text`` also
    kept, the remaining bytes, which may no longer be whole UTF-8).

    A byte goes if a LENGTH-byte string over it also occurs in a document with a smaller doc_id.
    Null is empty. Rows with equal doc_ids don't take from each other. Rows without a doc_id come
    after all others, in the order of a hash. Texts of any length are scanned in overlapping
    parts; a document stands in one chunk.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    tasks = min(buckets, MOST_TASKS)
    # some 200 cells for each anchor
    bits = min(64, max(24, size.bit_length() + 4))
    parts = chunks(docs, buckets)
    found = repeated_anchors(parts, bits, buckets, tasks, max(hot_docs, size >> HOT_BITS))
    cells = [np.frombuffer(r["hot"], "<u8") for r in found.filter("hot is not null").select("hot").toLocalIterator()]
    hot = spark.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, U), *cells])))
    laid = _laid(parts, found.filter("blob is not null").select("bucket", "blob"), tasks)
    near = laid.mapInArrow(_scan(hot, bits, buckets, False, _emit_packed), BLOB).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    spans = near.mapInArrow(_solve_packed(buckets), BLOB)
    if cells:
        spans = spans.unionByName(hot_spans(laid, hot, bits, buckets, tasks))
    return _laid(parts, spans, tasks).mapInArrow(_cut(keep_text), RESULT + (", kept binary" if keep_text else ""))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
