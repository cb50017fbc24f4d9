"""Vectorised byte-level helpers that run inside Arrow tasks.

Every function works on a *slice*: the UTF-8 bytes of several whole texts laid end to end
(``data``) and the offset of each text (``offs``, one more than there are texts).  Slices are
bounded in bytes, so the memory of a task does not follow the size of an Arrow batch; only a
single text longer than the bound makes a larger slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

# Separators of words (space and the code points 9 to 13).
SEPARATORS = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string array into (first row, end row, bytes, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2**64: entry i covers the first i bytes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of data[start:end], from the prefix hashes."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more than texts)."""
    inside = ~_IS_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    first = offs[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the index of each text's first word."""
    starts, ends, at = words(data, offs)
    return mix(span_hashes(prefix_hashes(data), starts, ends) + (ends - starts).astype(np.uint64)), at


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct word shingles as 64-bit hashes.

    A text of fewer words than ``size`` (but at least one) has its whole word sequence as one shingle.
    """
    h, at = word_hashes(data, offs)
    n = len(h)
    rolled = h.copy() if n else h
    for k in range(1, size):
        rolled[: n - k] = mix(rolled[: n - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    out = []
    for i in range(len(offs) - 1):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            x = np.full(1, hi - lo, dtype=np.uint64)
            for w in h[lo:hi]:
                x = mix(x * np.uint64(0xA0761D6478BD642F) + w)
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick.reduce over each window of ``width`` entries (np.minimum or np.maximum), by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def deal(columns: dict[str, np.ndarray], key: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows packed as (part, rows): one compressed piece for each of ``parts`` that a 64-bit key is dealt to.

    A shuffle of such pieces moves columns, not single rows, which is several times cheaper.
    """
    part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else order
    out = []
    for lo, hi in zip(first, [*first[1:], len(part)]):
        raw = b"".join(c[order[lo:hi]].tobytes() for c in columns.values())  # a piece at a time: no sorted copy of all columns
        out.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_pydict({"part": pa.array(part[first].astype(np.int32), pa.int32()), "rows": pa.array(out, pa.binary())})


def dealt(batches, kinds: dict[str, np.dtype]) -> Iterator[dict[str, np.ndarray]]:
    """The rows that ``deal`` packed, as columns of the given kinds."""
    kinds = {name: np.dtype(kind) for name, kind in kinds.items()}
    width = sum(k.itemsize for k in kinds.values())
    for batch in batches:
        for rows in batch.column("rows"):
            data = rows.as_buffer()
            size = int.from_bytes(data[:8].to_pybytes(), "little")
            raw, at, out = pa.decompress(data[8:], size, codec="zstd", asbytes=True), 0, {}
            for name, kind in kinds.items():
                out[name] = np.frombuffer(raw, kind, size // width, at)
                at += kind.itemsize * (size // width)
            yield out


def lean(run):
    """``run`` over the batches of a task; at its end what it has freed goes back to the system.

    A Python worker waits for its next task with all that its allocators still hold, beside the JVM of its executor.
    """

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return task
