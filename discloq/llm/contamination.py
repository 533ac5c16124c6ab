"""Benchmark decontamination by the q-gram lemma.

A stretch of text within k edits of an item of m characters shares at least m + 1 - q (k + 1)
q-grams with it, and their diagonals (place in the text less place in the item) differ by k at
most. Shared q-grams are counted in diagonal bands of width 2 (k + 1) that overlap by half, so
some band holds them all; bands that meet the bound are kept and aligned within the band.

Long items are also searched by overlapping passages, each with a budget and bound of its own,
so that an excerpt is found; items below two q-grams allow no edit and must stand between word
borders; items shorter than a q-gram are searched by an automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import bounded, by_bytes, let_go, texts_of
from discloq.llm.common import table

Q, EDIT_SHARE = 12, 0.05
#: Normal bytes of a passage of a long item, and from one passage to the next: an excerpt of
#: PASSAGE + STEP bytes holds a whole passage.
PASSAGE, STEP = 128, 64
#: Characters of items that one scan of the documents holds; more items take more scans.
BLOCK = 8_000_000
BITS = 22
_TO = np.arange(256, dtype=np.uint8)
_TO[[b for b in range(128) if not chr(b).isalnum()]] = 32
_TO[65:91] += 32


#: Stands between texts that are scanned together; no UTF-8 has it.
_BETWEEN = 0xFF


def lowered(text: str) -> bytes:
    """UTF-8, lower-cased; where that would change its length, A-Z only."""
    raw, low = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    return low if len(low) == len(raw) else raw.lower()


def squeezed(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in which each run of ASCII characters other than letters and digits is one space,
    and the place that each comes from."""
    a = _TO[np.frombuffer(low, np.uint8)]
    keep = a != 32
    keep[1:] |= keep[:-1].copy()
    at = np.nonzero(keep)[0]
    return a[at], at


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``squeezed`` without a space at either end."""
    a, at = squeezed(lowered(text))
    lo = int(len(a) > 0 and a[0] == 32)
    hi = len(a) - int(len(a) > lo and a[-1] == 32)
    return a[lo:hi], at[lo:hi]


def grams(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the Q = 12 bytes from each place."""
    if len(a) < Q:
        return np.zeros(0, np.uint64)
    h = a.astype(np.uint64) + np.uint64(1)
    for span, k in ((1, 0x9E3779B97F4A7C15), (2, 0xBF58476D1CE4E5B9)):
        h = h[:-span] * np.uint64(k) + h[span:]
        h ^= h >> np.uint64(29)
    # h covers 4 bytes
    return (h[:-8] * np.uint64(0x94D049BB133111EB) + h[4:-4]) * np.uint64(0xD6E8FEB86659FD93) + h[8:]


def budget(m: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed in a stretch of m bytes: the share of m, less where the bound would vanish."""
    return max(0, min(int(share * m), (m - 2 * Q) // Q))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of the item in the text along diagonals low..high, at most k
    edits; of equal ones the first start. Costs carry their origin."""
    big, width = 1 << 32, high - low + 1
    steps = np.arange(width, dtype=np.int64) * big
    row = np.arange(width, dtype=np.int64)  # cost 0, origin = diagonal
    row[(np.arange(width) + low < 0) | (np.arange(width) + low > len(text))] = 1 << 60
    for i, c in enumerate(item):
        at = i + low + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        differs = np.ones(width, np.int64)
        differs[inside] = text[at[inside]] != c
        new = row + differs * big
        new[~inside] = 1 << 60
        new[:-1] = np.minimum(new[:-1], row[1:] + big)  # the item's character is missing
        row = np.minimum.accumulate(new - steps) + steps  # the text has one more
    ends = len(item) + low + np.arange(width)
    row[(ends < 0) | (ends > len(text))] = 1 << 60
    best = int(row.argmin())
    cost = int(row[best]) // big
    return None if cost > k else (cost, low + int(row[best]) % big, int(ends[best]))


@dataclass
class Index:
    """Items, and the stretches of them that are searched: whole items first, then passages."""

    ids: list[int]
    items: list[np.ndarray]
    hashes: np.ndarray  # sorted
    owner: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    base: np.ndarray  # of each item: its first passage, and how many it has
    passages: np.ndarray
    item: np.ndarray  # of each stretch: its item, where it begins and ends there
    begin: np.ndarray
    size: np.ndarray
    short: dict[bytes, list[int]]  # items without a q-gram
    known: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Index:
        every = [(i, a) for i, t in rows if len(a := normal(t or "")[0])]
        short: dict[bytes, list[int]] = {}
        for i, a in every:
            if len(a) < Q:
                short.setdefault(a.tobytes(), []).append(i)
        kept = [(i, a) for i, a in every if len(a) >= Q]
        hs = [grams(a) for _, a in kept]
        h = np.concatenate([np.zeros(0, np.uint64), *hs])
        owner = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in hs]) if kept else np.zeros(0, np.int32)
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in hs)])
        order = np.argsort(h, kind="stable")
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[h >> np.uint64(64 - BITS)] = True
        sizes = np.array([len(a) for _, a in kept], np.int64)
        passages = np.where(sizes > PASSAGE, -(-(sizes - PASSAGE) // STEP) + 1, 0)
        base = len(sizes) + np.concatenate([[0], np.cumsum(passages)])[:-1].astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), passages)
        begin = np.minimum((np.arange(len(of)) + len(sizes) - base[of]) * STEP, sizes[of] - PASSAGE)
        return cls(
            [i for i, _ in kept], [a for _, a in kept], h[order], owner[order], place[order], bitmap, base, passages, np.concatenate([np.arange(len(sizes)), of]),
            np.concatenate([np.zeros(len(sizes), np.int64), begin]), np.concatenate([sizes, np.full(len(of), PASSAGE)]), short,
        )

    def bounds(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each stretch: the edits allowed, the q-grams that must be shared."""
        if share not in self.known:
            budgets = np.array([budget(int(m), share) for m in self.size], np.int64)
            self.known[share] = budgets, self.size + 1 - Q * (budgets + 1)
        return self.known[share]

    def scan(self, texts: list[str], share: float = EDIT_SHARE) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, edits, first byte, byte after the last) of the matches in each text.
        Texts are hashed together; only those with as many shared q-grams as the least bound
        are looked at one by one."""
        a, at = squeezed(bytes([_BETWEEN]).join(map(lowered, texts)))
        walls = np.nonzero(a == _BETWEEN)[0]
        firsts = np.concatenate([[0], at[walls] + 1]).astype(np.int64)
        out = []
        if len(self.items):
            h = grams(a)
            place = np.nonzero(self.bitmap[h >> np.uint64(64 - BITS)])[0]
            slot = np.minimum(np.searchsorted(self.hashes, h[place]), len(self.hashes) - 1)
            place = place[self.hashes[slot] == h[place]]
            counts = np.bincount(np.searchsorted(walls, place), minlength=len(texts))
            least = int(self.bounds(share)[1].min())
            for k in np.nonzero(counts >= least)[0].tolist():
                lo, hi = int(walls[k - 1]) + 1 if k else 0, int(walls[k]) if k < len(walls) else len(a)
                out += [(k, self.ids[i], e, int(at[lo + s]) - int(firsts[k]), int(at[lo + t - 1]) + 1 - int(firsts[k])) for i, e, s, t in self.hits(a[lo:hi], share)]
        for s, t, word in self.words(a):
            k = int(np.searchsorted(walls, s))
            out += [(k, i, 0, int(at[s]) - int(firsts[k]), int(at[t - 1]) + 1 - int(firsts[k])) for i in self.short[word]]
        return sorted(out)

    def words(self, a: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Where items without a q-gram stand, between borders of words."""
        if not self.short:
            return
        if "words" not in self.known:
            found = ahocorasick.Automaton()
            for word in self.short:
                found.add_word(word.decode("latin-1"), word)
            found.make_automaton()
            self.known["words"] = found
        for last, word in self.known["words"].iter(a.tobytes().decode("latin-1")):
            s, t = last + 1 - len(word), last + 1
            if _border(a, s, t):
                yield s, t, word

    def hits(self, text: np.ndarray, share: float = EDIT_SHARE) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each separate region of normal text that matches an item
        or, outside of those, passages of it; edits are then those of the worst passage."""
        h = grams(text)
        at = np.nonzero(self.bitmap[h >> np.uint64(64 - BITS)])[0]
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = hi - lo
        if not n.any():
            return []
        slot = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        where, owner, place = np.repeat(at, n), self.owner[slot].astype(np.int64), self.place[slot].astype(np.int64)
        stretch, where, place = self._stretches(owner, where, place)
        budgets, bound = self.bounds(share)
        half = budgets[stretch] + 1
        diagonal = where - (place - self.begin[stretch]) + self.size[stretch] + 2 * half
        bands = np.concatenate([stretch << 40 | (diagonal // half), stretch << 40 | (diagonal // half - 1)])
        # places in the text, each once for a band
        pairs = np.unique(np.stack([bands, np.concatenate([where, where])]), axis=1)
        keys, counts = np.unique(pairs[0], return_counts=True)
        whole: dict[int, list[tuple[int, int, int]]] = {}
        parts: dict[int, list[tuple[int, int, int]]] = {}
        enough = counts >= bound[keys >> 40]
        for key in keys[enough].tolist():  # whole items come before passages
            j, band = key >> 40, key & ((1 << 40) - 1)
            i, k, m = int(self.item[j]), int(budgets[j]), int(self.size[j])
            low, width = band * (k + 1) - m - 2 * (k + 1), 2 * (k + 1) - 1
            of_whole = j < len(self.items)
            if not of_whole and any(s < low + m and low + width < t for _, s, t in whole.get(i, ())):
                continue
            got = self._verified(text, self.items[i][int(self.begin[j]) : int(self.begin[j]) + m], low, width, k)
            if got and (m >= 2 * Q or _border(text, got[1], got[2])):
                (whole if of_whole else parts).setdefault(i, []).append(got)
        out = []
        for i in sorted(whole.keys() | parts.keys()):
            apart: list[tuple[int, int, int]] = []
            for e, s, t in sorted(whole.get(i, ())):
                if not any(s < z and x < t for _, x, z in apart):
                    apart.append((e, s, t))
            runs: list[tuple[int, int, int]] = []
            for s, t, e in sorted((s, t, e) for e, s, t in parts.get(i, ()) if not any(s < z and x < t for _, x, z in apart)):
                if runs and s <= runs[-1][2]:
                    runs[-1] = max(runs[-1][0], e), runs[-1][1], max(runs[-1][2], t)
                else:
                    runs.append((e, s, t))
            out += [(i, *x) for x in sorted(apart + runs, key=lambda x: x[1:])]
        return out

    def _stretches(self, owner, where, place):
        """Each shared q-gram once for its item and once for each passage that it lies in."""
        n, last = self.passages[owner], self.passages[owner] - 1
        tried = np.stack([place // STEP, place // STEP - 1, last])
        j = np.clip(tried, 0, np.maximum(last, 0))
        begin = np.minimum(j * STEP, np.array([len(a) for a in self.items])[owner] - PASSAGE) if len(owner) else j
        ok = (tried == j) & (n > 0) & (begin <= place) & (place <= begin + PASSAGE - Q)
        ok[2] &= (tried[0] != last) & (tried[1] != last)
        more = [(self.base[owner][x] + j[r][x], where[x], place[x]) for r, x in enumerate(ok)]
        return tuple(np.concatenate(c) for c in zip((owner, where, place), *more))

    @staticmethod
    def _verified(text: np.ndarray, want: np.ndarray, low: int, width: int, k: int) -> tuple[int, int, int] | None:
        """Best (edits, start, end) of ``want`` along ``width`` diagonals from ``low``."""
        begin = max(0, low)
        # no edit: the alignment along one diagonal, which is a search
        same = text[begin : max(begin, low + width - 1 + len(want))].tobytes().find(want.tobytes())
        return (0, begin + same, begin + same + len(want)) if same >= 0 else align(want, text, low, low + width, k) if k else None


def _border(a: np.ndarray, s: int, t: int) -> bool:
    """Whether a[s:t] has a border of words at both ends."""
    return (s == 0 or a[s - 1] in (32, _BETWEEN)) and (t == len(a) or a[t] in (32, _BETWEEN))


class Items:
    """Rows (item_id, text) as they are broadcast; each worker process builds their index once."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows

    def index(self) -> Index:
        if "_index" not in self.__dict__:
            self._index = Index.of(self.rows)
        return self._index


def find_passages(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, edits, start_byte, end_byte): each separate region of a document that
    matches an item of ``items(item_id, text)``, or passages of one that is longer than PASSAGE
    normal bytes, as a span of the document's UTF-8.

    Whole texts are scanned, once for each block of items. Items without a letter or digit and
    null texts match nothing; rows with a null doc_id are kept. Equal items are each named;
    repeated rows of documents each give their rows.
    """
    sizes = items.select("item_id", F.length("text").alias("n")).filter("n > 0")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (block // 2)))
    out = None
    for b in range(blocks):
        # a block holds about block / 2 characters; a hash spreads items over blocks
        mine = items.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b))
        rows = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            let_go()
            index = shared.value.index()
            for part in by_bytes(batches, "text"):
                docs = part.column("doc_id").to_pylist()
                out = [(docs[k], *rest) for k, *rest in index.scan(texts_of(part), share)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "edits", "start_byte", "end_byte"])

        rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        one = rows_of.transform(bounded).mapInArrow(run, "doc_id long, item_id long, edits int, start_byte long, end_byte long")
        out = one if out is None else out.unionByName(one)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
