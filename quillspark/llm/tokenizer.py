"""Problem 8: encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: two-tier lookup. A minimal perfect hash resolves whole pre-tokens that are already in the vocabulary; misses are
merged with a heap over a linked list of bytes. A bounded memo of pre-tokens already resolved stands before both tiers.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the public pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 1 << 18
MEMO_CHARS = 64  # longer pre-tokens are resolved each time


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class MinimalPerfectHash:
    """Hash and displace: n keys to n slots without collision; a stored key tells members from strangers."""

    def __init__(self, entries: dict[bytes, int], per_bucket: int = 2):
        n = self.n = len(entries)
        self.buckets = max(1, n // per_bucket)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in entries:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        taken = bytearray(n)
        ordered = sorted(groups.items(), key=lambda x: -len(x[1]))
        alone = [x for x in ordered if len(x[1]) == 1]
        for b, members in ordered[: len(ordered) - len(alone)]:
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, key) in zip(slots, members):
                taken[s], self.keys[s], self.ids[s] = 1, key, entries[key]
        free = (s for s in range(n) if not taken[s])
        for (b, ((_, key),)), s in zip(alone, free):  # a bucket of one key names its slot: -1 - slot
            self.shift[b], self.keys[s], self.ids[s] = -1 - s, key, entries[key]
        self.shift = self.shift.tolist()

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def get(self, key: bytes) -> int:
        """The id of a key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else -1


class Encoder(dict):
    """Pre-token to ids. As a dict it holds what was resolved before, up to MEMO_ENTRIES entries."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        raw = {bytes(back[c] for c in word): i for word, i in model["vocab"].items() if all(c in back for c in word)}
        self.table = MinimalPerfectHash(raw)
        self.byte_ids = [model["vocab"][c] for c in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[model["vocab"][left], model["vocab"][right]] = (rank, model["vocab"][left + right])
        self.split = regex.compile(PRE_TOKEN)

    def __reduce__(self):
        return _restore, (self.table, self.byte_ids, self.merges)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.table.get(raw)
        found = (whole,) if whole >= 0 else self.merge(raw)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = found
        return found

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Byte-pair merges in rank order, leftmost first, with a heap over a doubly linked list."""
        ids = [self.byte_ids[b] for b in raw]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            p = before[i]
            if p >= 0 and (m := merges.get((ids[p], new))):
                heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.split.findall(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self.__getitem__, self.split.findall(text))))


def _restore(table: MinimalPerfectHash, byte_ids: list[int], merges: dict) -> Encoder:
    out = Encoder.__new__(Encoder)
    out.table, out.byte_ids, out.merges, out.split = table, byte_ids, merges, regex.compile(PRE_TOKEN)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(directory: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary file, built once per process."""
    path = os.path.join(directory, name)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shared_encoder(spark: SparkSession, directory: str) -> Broadcast:
    """The encoder built once on the driver and sent to the workers; its size is that of the vocabulary, about 5 MB."""
    return spark.sparkContext.broadcast(encoder(directory))


def encode_table(docs: DataFrame, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens; the strings of special tokens are ordinary text.

    docs: (doc_id, text); further columns are ignored. One row for every input row, repeated rows included; null and
    empty texts give an empty list. Texts of any length are encoded whole. A narrow map without a shuffle.
    """

    shared = shared_encoder(docs.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            flat, ends = [], [0]
            for text in b.column("text").to_pylist():
                flat.extend(enc.encode(text))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], directory: str = TOKENIZER_DIR) -> DataFrame:
    """The columns of keep with n_tokens, the token count of each text (0 for null and empty)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_tokens bigint"

    shared = shared_encoder(docs.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], [*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
