"""Token counts and ids, cut at safe boundaries and remembered by word.

A text is never given to the tokenizer whole. It is cut where the tokenizer's own splitting
always cuts, so the pieces' tokens are the text's; pieces repeat, and each worker keeps those
it has seen (a bounded number of bytes).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloq.llm.batches import MEMORIES, by_bytes, texts_of
from discloq.llm.common import table

LIMIT = 1024
#: A space between two characters that aren't white space: the next token always starts there.
#: Python's \s holds all that the tokenizer's does, and more.
_INNER = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")
_LONGEST = 64


class Remembered:
    """Results of ``encode`` (a batch function) by piece. The first ``keep`` pieces stay, the
    ``spare`` after them go when they are full."""

    def __init__(self, encode: Callable[[list], list], keep: int = 350_000, spare: int = 250_000):
        self.encode, self.keep, self.spare = encode, keep, spare
        self.known: dict = {}
        self.later: dict = {}

    def table(self, pieces: set) -> dict:
        """The results of ``pieces`` and of no others: small, so that the many lookups are quick."""
        if len(self.later) > self.spare:
            self.later.clear()
        found, missing = {}, []
        known, later = self.known.get, self.later.get
        for p in pieces:
            v = known(p)
            if v is None:
                v = later(p)
            if v is None:
                missing.append(p)
            else:
                found[p] = v
        if missing:
            fresh = dict(zip(missing, self.encode(missing)))
            found |= fresh
            held = self.known if len(self.known) < self.keep else self.later
            held.update((p, v) for p, v in fresh.items() if len(p) <= _LONGEST)
        return found


def memory(name: str, use: str, make: Callable[[], Callable[[list], list]], keep: int, spare: int) -> Remembered:
    if (name, use) not in MEMORIES:
        MEMORIES[name, use] = Remembered(make(), keep, spare)
    return MEMORIES[name, use]


def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


def space_pieces(text: str) -> list[str]:
    """The text cut before each space between two other characters; the pieces joined give the
    text. For byte-level BPE, whose words take one leading space."""
    if not text:
        return []
    parts = _INNER.split(text) if _ODD.search(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def counted(texts: list[str], seen: Remembered) -> np.ndarray:
    pieces = [space_pieces(t) for t in texts]
    known = seen.table(set().union(*pieces)) if pieces else {}
    get = known.__getitem__
    return np.fromiter((sum(map(get, p)) for p in pieces), np.int64, len(pieces))


def length_memory(name: str) -> Remembered:
    def make():
        t = tokenizer(name)
        return lambda words: [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)]

    return memory(name, "lengths", make, 350_000, 250_000)


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = LIMIT, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. Null is empty: 0 bytes, 0 tokens.
    The tokenizer is loaded once for each worker; only lengths leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = length_memory(name)
        for part in by_bytes(batches, "text", batch_bytes):
            n = counted(texts_of(part), seen)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def word_ids(texts: list[str], seen: Remembered) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text, for a tokenizer that lower-cases and drops
    white space: every ASCII white space is a safe boundary, and A-Z may be lower-cased before
    unless that could make a special string."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    pieces = [(b if b"<|" in b else b.lower()).split() for b in raw]
    known = seen.table(set().union(*pieces)) if pieces else {}
    get = known.__getitem__
    return [b"".join(map(get, p)) for p in pieces]


def id_memory(name: str) -> Remembered:
    def make():
        t = tokenizer(name)
        model = t.model

        def encode(words: list[bytes]) -> list[bytes]:
            # a lower-case ASCII word is its own normal form and one piece: the model can have it as it is
            plain = [w.isalpha() and w.islower() for w in words]
            others = (e.ids for e in t.encode_batch_fast([w.decode() for w, p in zip(words, plain) if not p], add_special_tokens=False))
            each = ([x.id for x in model.tokenize(w.decode())] if p else next(others) for w, p in zip(words, plain))
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in each]

        return encode

    return memory(name, "ids", make, 300_000, 200_000)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
