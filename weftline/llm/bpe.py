"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern.  First tier: a minimal perfect hash over the
vocabulary resolves a pre-token that is itself a token with one probe and one comparison.  Second tier:
any other pre-token is merged by a heap of ranked pairs over a linked list of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15
#: Pre-tokens whose ids a worker remembers; when full, it starts afresh.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash by displacement: as many slots as keys, one probe a lookup."""

    def __init__(self, ids: dict[bytes, int]):
        n = self.n = max(len(ids), 1)
        self.buckets = n // 3 + 1
        self.keys: list[bytes | None] = [None] * n
        self.ids = [-1] * n
        self.shift = [0] * self.buckets
        grouped: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            grouped[(h >> 32) % self.buckets].append((h, key))
        free = iter(())
        for b in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            group = grouped[b]
            if not group:
                break
            if len(group) == 1:  # a lone key takes any free slot, named directly
                slot = next(free, None)
                if slot is None:
                    free = iter([i for i, k in enumerate(self.keys) if k is None])
                    slot = next(free)
                self.shift[b], slots = -slot - 1, [slot]
            else:
                d = 0
                while True:
                    slots = [((h ^ (d * _MULT & _MASK)) * _MULT & _MASK) % n for h, _ in group]
                    if len({*slots}) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (_, key) in zip(slots, group):
                self.keys[s], self.ids[s] = key, ids[key]

    def get(self, key: bytes) -> int:
        """The id of a key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        slot = -d - 1 if d < 0 else ((h ^ (d * _MULT & _MASK)) * _MULT & _MASK) % self.n
        return self.ids[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: repeatedly merge the pair of least rank, the leftmost of equals."""
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if j >= n or j < 0 or after[j] != end:
            continue  # one of the two has been merged meanwhile
        after[i] = end
        after[j] = -1
        if end < n:
            before[end] = i
            to = after[end]
            if (r := ranks.get(piece[i:to])) is not None:
                heappush(heap, (r, i, to))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Memo(dict):
    """Packed ids (little-endian 32 bits) of pre-tokens seen by this worker."""

    def __init__(self, whole: PerfectHash, ranks: dict[bytes, int]):
        self.whole, self.ranks = whole, ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        one = self.whole.get(raw)
        packed = array("I", [one] if one >= 0 else merge(raw, self.ranks)).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


_memos: dict[tuple, _Memo] = {}


class Tokenizer:
    """A vocabulary and a pattern, small enough to broadcast (both tiers are bounded by the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(ranks)

    def packer(self):
        """A function from a text to its packed ids."""
        key = (self.pattern, len(self.ranks), hash(frozenset(list(self.ranks.items())[-50:])))
        memo = _memos.setdefault(key, _Memo(self.whole, self.ranks))
        find = regex.compile(self.pattern).findall
        return lambda text: b"".join(map(memo.__getitem__, find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packer()(text), "<u4").tolist()

    def tokens(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens().__getitem__, ids))


def _run(shared, with_ids: bool):
    def run(batches):
        tokenizer = shared.value
        pack, token = tokenizer.packer(), tokenizer.tokens().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = [pack(t or "") for t in part.column("text").to_pylist()]
                ids = [np.frombuffer(p, "<u4") for p in packed]
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(i) for i in ids], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))
                    out["decoded"] = pa.array([b"".join(map(token, i.tolist())) for i in ids], pa.binary())
                else:
                    out["ids_sha256"] = [hashlib.sha256(p).hexdigest() for p in packed]
                    out["decoded_sha256"] = [hashlib.sha256(b"".join(map(token, i.tolist()))).hexdigest() for i in ids]
                yield pa.RecordBatch.from_pydict(out)

    return run


def bpe(documents: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Ids of every text and the bytes they decode to: (doc_id, n_tokens, ids, decoded).

    With ``digests`` the last two come as SHA-256 (ids as little-endian unsigned 32-bit integers).  Each
    pre-token is encoded on its own, without special tokens.  Null texts count as empty and have no ids;
    long texts and pre-tokens are taken whole; repeated rows give repeated results; other columns are
    ignored; an empty table gives an empty result.  The rank file is read on the driver.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(path), pattern))
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(shared, not digests), f"doc_id long, n_tokens long, {tail}")
