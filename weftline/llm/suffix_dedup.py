"""Exact substring dedup: hash-compared suffix sort over anchored contexts.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document with a
smaller id.  Two equal strings of that length share their content-defined anchor (the k-mer of least
hash in the string), so it is enough to compare the surroundings of equal anchors:

1. every text is scanned for its anchors.  A task first combines its own: an anchor whose whole context
   (all bytes that a string holding it can reach) a smaller document of the task has too, found by hash and
   compared byte by byte, is covered and goes no further, so a passage that very many documents share
   makes no hot key.  Of a k-mer that the task has in several documents one witness meets the other tasks;
2. anchors meet by k-mer, as bare numbers; those of a k-mer with a second document ask for a comparison;
3. the contexts asked for are laid end to end, and their suffixes, and those of their mirror images, are
   sorted by a merge sort that compares two suffixes through their common extension, found by binary
   search over prefix polynomial hashes.  The extensions of neighbours are verified byte by byte, and so is
   their order; a segment in which a hash misled is sorted by its bytes.  Contexts that agree before and
   after the anchor far enough hold equal strings, which the smallest document keeps.  A k-mer with more
   than ``HOT`` contexts is split: each of its strings is a segment of its own, combined in the task first;
4. the covered bytes of each document are united and cut from its text.

No byte is cut on a hash alone, and no hash collision hides a repeated string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored
from .textops import deal, dealt, lean, mix, powers, prefix_hashes, slices, sliding, span_hashes

KMER = 20
#: The most contexts of one k-mer that are sorted together.
HOT = 20_000
#: Anchors that a task combines at a time, and rows that it compares at a time.
COMBINED = 400_000
CHUNK = 8_000
#: Text bytes whose anchors meet in one task, and contexts that are compared in one task.
MEET_BYTES = 16 << 20
COMPARED = 200_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Kinds of scanned rows: an anchor, one that is known to be repeated, a witness of such, a covered span.
PLAIN, SURE, WITNESS, SPAN = range(4)
SCANNED = {"key": "i8", "pos": "i4", "kmer": "i8", "kind": "i1"}
#: A row of a text, by its key: a span [pos, hi), else an anchor to compare, hot or not or (with its kmer) not
#: known; without a key a hot k-mer.  Of a k-mer half of its hash: hot is only how it is compared.
FOUND = "key long, pos int, hi int, kmer int, hot boolean"


def kmer_hashes(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes, the hash of the k-mer at each byte, and the least of the string at each byte (0: no string)."""
    n = len(data)
    prefix = prefix_hashes(data)
    h = mix((prefix[KMER:] - prefix[:-KMER]) * powers(n)[1][: n - KMER + 1]) >> np.uint64(1)
    room = np.repeat(offs[1:], np.diff(offs)) - np.arange(n)
    h[room[: len(h)] < KMER] = _TOP
    least = sliding(h, length - KMER + 1, np.minimum)
    least[room[: len(least)] < length] = 0
    return prefix, h, least


def anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte, text, k-mer hash and context hash of each anchor of the texts in a slice."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    prefix, h, least = kmer_hashes(data, offs, length)
    edge = np.zeros(length - KMER, dtype=np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), length - KMER + 1, np.maximum) == h)
    text = np.searchsorted(offs, at, side="right") - 1
    lo, hi = np.maximum(at - (length - KMER), offs[:-1][text]), np.minimum(at + length, offs[1:][text])
    context = mix(span_hashes(prefix, lo, hi) + ((at - lo) * 4096 + hi - at).astype(np.uint64))
    return at, text, h[at].view(np.int64), context.view(np.int64)


def windows(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """The bytes data[lo:hi] around each ``at``, which stands at column ``length - KMER``; 0 outside, others + 1."""
    left = length - KMER
    padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at].astype(np.uint16) + 1
    out[np.arange(left + length) < (left - (at - lo))[:, None]] = 0
    out[np.arange(left + length) >= (left + (hi - at))[:, None]] = 0
    return out


def earlier(key: np.ndarray, doc: np.ndarray, same) -> np.ndarray:
    """Which rows repeat a row of equal key and a smaller document; ``same(rows, heads)`` compares their bytes."""
    if not len(key):
        return np.zeros(0, dtype=bool)
    order = np.argsort(key)
    alike = key[order][1:] == key[order][:-1]
    some = order[np.append(alike, False) | np.insert(alike, 0, False)]
    some = some[np.lexsort((doc[some], key[some]))]
    out = np.zeros(len(key), dtype=bool)
    if not len(some):
        return out
    new = np.append(True, key[some][1:] != key[some][:-1])
    head = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    later = np.flatnonzero(doc[some] > doc[head])
    for at in range(0, len(later), 20_000):
        i = later[at : at + 20_000]
        out[some[i]] = same(some[i], head[i])
    return out


def united(key, lo, hi) -> tuple[np.ndarray, ...]:
    """Spans of the same text that touch or overlap made one."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    new = np.ones(len(key), dtype=bool)
    # spans of one origin are about equally wide, so the one before reaches furthest; others stay apart, harmlessly
    new[1:] = (key[1:] != key[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    return key[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)


class _Block:
    """Anchors of some slices of a task."""

    def __init__(self, length: int, bits: int, parts: int):
        self.length, self.shift, self.n, self.parts, self.data, self.held, self.size = length, 64 - bits, parts, [], [], 0, 0

    def add(self, data, offs, ids, keys) -> None:
        at, text, kmer, context = anchors(data, offs, self.length)
        lo, hi = offs[:-1][text], offs[1:][text]
        self.parts.append((at + self.size, lo + self.size, hi + self.size, kmer, context >> self.shift, ids[text], keys[text]))
        self.data.append(data)
        self.held += len(at)
        self.size += len(data)

    def rows(self):
        at, start, end, kmer, context, doc, key = (np.concatenate(x) for x in zip(*self.parts))
        data, length = np.concatenate(self.data), self.length
        self.parts, self.data, self.held, self.size = [], [], 0, 0
        lo, hi = np.maximum(at - (length - KMER), start), np.minimum(at + length, end)

        def same(i, j):
            return (windows(data, at[i], lo[i], hi[i], length) == windows(data, at[j], lo[j], hi[j], length)).all(axis=1)

        gone = earlier(context, doc, same)
        wide = gone & (hi - lo >= length)
        s_key, s_lo, s_hi = united(key[wide], (lo - start)[wide], (hi - start)[wide])
        kmer, doc, key, pos = kmer[~gone], doc[~gone], key[~gone], (at - start)[~gone]
        order = np.argsort(kmer)
        first = _firsts(kmer[order])
        kind = np.zeros(len(kmer), dtype=np.int8)
        w, count = first, first
        if len(first):
            several = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
            sizes = np.diff(np.append(first, len(kmer)))
            kind[order] = np.where(np.repeat(several, sizes), SURE, PLAIN)
            w, count = order[first[several]], sizes[several]
        # a witness has, in place of a position, the number of contexts that it stands for; a span ends at its kmer
        columns = {
            "key": np.concatenate([key, key[w], s_key]), "pos": np.concatenate([pos, count, s_lo]).astype(np.int32),
            "kmer": np.concatenate([kmer, kmer[w], s_hi]),
            "kind": np.concatenate([kind, np.full(len(w), WITNESS, np.int8), np.full(len(s_key), SPAN, np.int8)]),
        }
        meets = (columns["kind"] == PLAIN) | (columns["kind"] == WITNESS)
        yield deal(columns, np.where(meets, columns["kmer"], columns["key"] + columns["pos"]), self.n)


def _anchor_rows(length: int, bits: int, parts: int):
    def run(batches):
        block, seen = _Block(length, bits, parts), set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            new = [k not in seen and not seen.add(k) for k in keys]  # repeated rows
            if not all(new):  # a filter copies the texts
                batch = batch.filter(pa.array(new, pa.bool_()))
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for lo, hi, data, offs in slices(batch.column("text")):
                block.add(data, offs, ids[lo:hi], keys[lo:hi])
                if block.held >= COMBINED:
                    yield from block.rows()
        if block.held:
            yield from block.rows()

    return run


def _found(key, pos, hi=None, kmer=None, hot=None) -> pa.RecordBatch:
    n = len(pos) if key is None else len(key)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_pydict(
        {
            "key": none if key is None else key, "pos": pa.array(pos, pa.int32()), "hi": none.cast(pa.int32()) if hi is None else pa.array(hi).cast(pa.int32()),
            "kmer": none.cast(pa.int32()) if kmer is None else mix(kmer.view(np.uint64)).astype(np.uint32).view(np.int32), "hot": pa.nulls(n, pa.bool_()) if hot is None else pa.array(hot),
        }
    )


def _meet(most: int):
    """Spans, the anchors to compare, and the k-mers of more than ``most`` contexts."""

    def run(batches):
        kept = []
        for rows in dealt(batches, SCANNED):
            key, pos, kmer, kind = (rows[c] for c in SCANNED)
            if (i := np.flatnonzero(kind == SPAN)).size:
                yield _found(key[i], pos[i], hi=kmer[i])
            if (i := np.flatnonzero(kind == SURE)).size:
                yield _found(key[i], pos[i], kmer=kmer[i])
            i = np.flatnonzero((kind == PLAIN) | (kind == WITNESS))
            kept.append((key[i], pos[i], kmer[i], kind[i] == WITNESS))
        if not kept:
            return
        key, pos, kmer, told = (np.concatenate(x) for x in zip(*kept))
        del kept
        order = np.argsort(kmer)
        alike = kmer[order][1:] == kmer[order][:-1]
        order = order[np.append(alike, False) | np.insert(alike, 0, False) | told[order]] if len(order) else order
        if not len(order):
            return
        key, pos, kmer, told = key[order], pos[order], kmer[order], told[order]
        first = _firsts(kmer)
        sizes = np.diff(np.append(first, len(kmer)))
        several = (np.minimum.reduceat(key, first) < np.maximum.reduceat(key, first)) | np.logical_or.reduceat(told, first)
        hot = np.add.reduceat(np.where(told, pos, 1), first) > most
        ask = np.flatnonzero(np.repeat(several, sizes) & ~told)
        for at in range(0, len(ask), 100_000):
            i = ask[at : at + 100_000]
            yield _found(key[i], pos[i], hot=np.repeat(hot, sizes)[i])
        yield _found(None, pa.nulls(int(hot.sum()), pa.int32()), kmer=kmer[first[hot]])

    return run


def _context(length: int) -> dict:
    return {"segment": "i8", "doc_id": "i8", "key": "i8", "pos": "i4", "before": "i4", "after": "i4", "bytes": ("u1", (2 * length - KMER,))}


NO_ASKS = "cast(array() as array<int>)"


def _contexts(length: int, parts: int):
    """The bytes around each anchor asked for, packed by k-mer; those of hot k-mers string by string.

    Rows whose ``before`` is -1 are spans [pos, after) that the task has found covered.
    """
    left = length - KMER

    def rows(data, at, start, end, hot, doc, key, hashes):
        prefix, h, least = hashes
        # only strings whose least k-mer is at the anchor need it; they follow each other
        front, back = np.zeros(len(at), dtype=np.int64), np.full(len(at), left)
        for o in range(left + 1):
            p = at - o
            mine = (p >= start) & (p < len(least))
            mine[mine] = least[p[mine]] == h[at[mine]]
            front[mine], back = o, np.where(mine, np.minimum(back, o), back)
        lo, hi, segment = at - front, np.minimum(at - back + length, end), h[at].view(np.int64)
        s_key = s_lo = s_hi = np.zeros(0, dtype=np.int64)
        if hot.any():
            each, cold = np.flatnonzero(hot), np.flatnonzero(~hot)
            n = hi[each] - length - lo[each] + 1
            i = np.repeat(each, n)
            p = np.repeat(lo[each] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            string = mix(span_hashes(prefix, p, p + length)).view(np.int64)
            n = len(cold)
            i, lo, hi = np.append(cold, i), np.append(lo[cold], p), np.append(hi[cold], p + length)
            segment = np.append(segment[cold], string)
            at, start, doc, key = at[i], start[i], doc[i], key[i]
            gone = np.zeros(len(i), dtype=bool)
            gone[n:] = earlier(string, doc[n:], lambda a, b: (
                windows(data, at[a + n], lo[a + n], hi[a + n], length) == windows(data, at[b + n], lo[b + n], hi[b + n], length)
            ).all(axis=1))
            s_key, s_lo, s_hi = united(key[gone], (lo - start)[gone], (hi - start)[gone])
            at, start, lo, hi, segment, doc, key = (x[~gone] for x in (at, start, lo, hi, segment, doc, key))
        padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)])
        raw = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
        none = np.zeros((len(s_key), left + length), np.uint8)
        return (
            np.append(segment, s_key), np.append(doc, s_key), np.append(key, s_key), np.append(at - start, s_lo).astype(np.int32),
            np.append(at - lo, np.full(len(s_key), -1)).astype(np.int32), np.append(hi - at, s_hi).astype(np.int32), np.concatenate([raw, none]),
        )

    def packed(held):
        pieces, columns = [list(x) for x in zip(*held)], {}
        held.clear()
        for name, own in zip(_context(length), pieces):
            columns[name] = np.concatenate(own)
            own.clear()
        return deal(columns, columns["segment"], parts)

    def run(batches):
        last, held, size = None, [], 0
        for batch in batches:
            asks = batch.column("asks")
            first, ask = asks.offsets.to_numpy(), asks.values.to_numpy()
            pos, hot = ask >> 1, (ask & 1).astype(bool)
            # a row without an id asks for nothing; rows come sorted by key, so repeated ones follow each other
            ids, keys = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("key").to_numpy()
            new = np.append(len(keys) > 0 and keys[0] != last, keys[1:] != keys[:-1])[: len(keys)]
            last = keys[-1] if len(keys) else last
            for lo, hi, data, offs in slices(batch.column("text")):
                text = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
                own = np.flatnonzero(new[lo + text]) if len(text) else text
                if not len(own):
                    continue
                part, text = first[lo] + own, text[own]
                hashes = kmer_hashes(data, offs, length)
                held.append(rows(data, offs[:-1][text] + pos[part], offs[:-1][text], offs[1:][text], hot[part], ids[lo + text], keys[lo + text], hashes))
                size += len(held[-1][0])
                if size >= COMPARED:
                    yield packed(held)
                    size = 0
        if held:
            yield packed(held)

    return run


class SuffixSorter:
    """Merge sort of suffixes inside segments: one suffix a row of ``values``, from its first column on."""

    def __init__(self, values: np.ndarray, bits: int = 64):
        self.values, self.longest, self.shift = values, values.shape[1], np.uint64(64 - bits)
        flat = np.append(values.ravel(), np.zeros(self.longest, values.dtype))
        up, self.down = powers(len(flat))
        self.prefix = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=self.prefix[1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes in rows a and b, by binary search over hashes."""
        out = np.full(len(a), self.longest)
        x, y = a * self.longest, b * self.longest
        i = np.flatnonzero(~self._same(x, y, self.longest))  # most are equal, or differ early
        lo, hi, x, y = np.zeros(len(i), dtype=np.int64), np.full(len(i), self.longest - 1), x[i], y[i]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self._same(x, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        out[i] = lo
        return out

    def _same(self, x: np.ndarray, y: np.ndarray, size) -> np.ndarray:
        one = (self.prefix[x + size] - self.prefix[x]) * self.down[x]
        other = (self.prefix[y + size] - self.prefix[y]) * self.down[y]
        return one == other if not self.shift else mix(one) >> self.shift == mix(other) >> self.shift

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix in row a is less than, equal to or greater than that in row b."""
        common = self.extension(a, b)
        at = np.minimum(common, self.longest - 1)
        return np.where(common >= self.longest, 0, np.sign(self.values[a, at].astype(np.int64) - self.values[b, at].astype(np.int64)))

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """The order of the rows (grouped by ``segment``) that sorts each segment.

        Suffixes of a segment that are equal by the hash of their whole length are sorted as one.
        """
        x = np.arange(len(segment)) * self.longest
        whole = (self.prefix[x + self.longest] - self.prefix[x]) * self.down[x]
        whole = mix(whole) >> self.shift
        alike = np.lexsort((whole, segment))
        new = np.append(True, (segment[alike][1:] != segment[alike][:-1]) | (whole[alike][1:] != whole[alike][:-1]))
        first = np.flatnonzero(new)
        order = self._merged(alike[first], segment[alike[first]])
        sizes = np.diff(np.append(first, len(alike)))
        ends = np.cumsum(sizes[order])
        at = np.repeat(first[order] - np.append(0, ends[:-1]), sizes[order]) + np.arange(len(alike))
        return alike[at]

    def _merged(self, rows: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The order of ``rows`` (grouped by ``segment``) by merge sort."""
        n = len(rows)
        perm = np.arange(n)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        sizes = np.diff(np.append(first, n))
        base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max():
            slot = np.flatnonzero(size > width)
            local = slot - base[slot]
            run = local // width
            sib = run ^ 1
            lo, hi = np.minimum(sib * width, size[slot]), np.minimum((sib + 1) * width, size[slot])
            from_, mine, right = lo.copy(), perm[slot], (run & 1).astype(bool)
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                sign = self.order(rows[perm[base[slot[open_]] + mid]], rows[mine[open_]])
                below = (sign < 0) | ((sign == 0) & right[open_])
                lo[open_] = np.where(below, mid + 1, lo[open_])
                hi[open_] = np.where(below, hi[open_], mid)
            moved = perm.copy()
            moved[base[slot] + (run & ~1) * width + (local - run * width) + (lo - from_)] = mine
            perm = moved
            width *= 2
        # orders that contradict each other, by colliding hashes, lose rows: leave it to the bytes then
        return perm if np.bincount(perm, minlength=n).max() == 1 else np.arange(n)


def _true_extensions(values: np.ndarray, perm: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common bytes of neighbours in the order ``perm`` and whether they are in order; neighbours not ``same``: 0, true."""
    n, width = values.shape
    out, sorted_ = np.zeros(max(n - 1, 0), dtype=np.int64), np.ones(max(n - 1, 0), dtype=bool)
    i = np.flatnonzero(same)
    x, y = values[perm[i]], values[perm[i + 1]]
    differ = x != y
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    at = np.minimum(common, width - 1)
    row = np.arange(len(i))
    out[i], sorted_[i] = common, (common == width) | (x[row, at] < y[row, at])
    return out, sorted_


def suffix_array(values: np.ndarray, segment: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the rows of each segment, and the verified common extension of neighbours (-1: other segment)."""
    perm = SuffixSorter(values, bits).sort(segment)
    same = segment[1:] == segment[:-1]  # the order stays inside segments
    common, sorted_ = _true_extensions(values, perm, same)
    if not sorted_.all():  # a hash misled: sort those segments by their bytes
        for s in np.unique(segment[1:][~sorted_]):
            own = np.flatnonzero(segment == s)
            perm[own] = own[np.lexsort(values[own].T[::-1])]
        common, _ = _true_extensions(values, perm, same)
    return perm, np.where(same, common, -1)


def repeated_strings(segment: np.ndarray, doc: np.ndarray, values: np.ndarray, length: int, bits: int = 64, which: np.ndarray | None = None) -> np.ndarray:
    """(row, offset) pairs: the string of ``length`` that starts ``offset`` before the row's anchor is repeated.

    ``values`` has one context a row with the anchor at column ``length - KMER``, sorted by segment.  With ``which``
    the contexts are different ones, and it numbers that of each row of ``doc``.
    """
    left, n = length - KMER, len(segment)
    if len(doc) < 2:
        return np.zeros((0, 2), dtype=np.int64)
    which = np.arange(n) if which is None else which
    copied, least = np.bincount(which, minlength=n) > 1, np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    sides = []
    for part in (np.ascontiguousarray(values[:, left:]), np.ascontiguousarray(values[:, left - 1 :: -1])):
        perm, common = suffix_array(part, segment, bits)
        longest = np.where(copied, part.shape[1], 0)
        np.maximum.at(longest, perm[1:], common)
        np.maximum.at(longest, perm[:-1], common)
        sides.append((perm, common, longest, (part > 0).sum(axis=1)))
    (after, a_common, a_longest, a_room), (before, b_common, b_longest, b_room) = sides
    rows, offsets = [], []
    for offset in range(left + 1):
        rest = length - offset
        # both sides must be shared with some other context, and no byte may be missing
        ok = np.flatnonzero((b_longest >= offset) & (a_longest >= rest) & (b_room >= offset) & (a_room >= rest))
        if not len(ok):
            continue
        # contexts between which every extension is long enough are a class, on either side
        group = np.empty(n, dtype=np.int64)
        group[after] = np.cumsum(np.append(0, a_common < rest))
        other = np.empty(n, dtype=np.int64)
        other[before] = np.cumsum(np.append(0, b_common < offset))
        key = group[ok] * n + other[ok]
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        owner = np.full(n, np.iinfo(np.int64).max)
        owner[ok[order]] = np.repeat(np.minimum.reduceat(least[ok[order]], first), np.diff(np.append(first, len(order))))
        hit = np.flatnonzero(doc > owner[which])
        rows.append(hit)
        offsets.append(np.full(len(hit), offset))
    if not rows:
        return np.zeros((0, 2), dtype=np.int64)
    return np.stack([np.concatenate(rows), np.concatenate(offsets)], axis=1)


def distinct_contexts(segment: np.ndarray, contexts, most: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments and values of the different contexts, sorted by segment, and the number of each row's own.

    ``contexts(lo, hi)`` gives the values of some rows, so that no more than ``most`` are laid out at a time.
    """
    found, which, n = [], [], 0
    for lo in range(0, len(segment), most):
        own = np.ascontiguousarray(segment[lo : lo + most])
        rows = np.concatenate([own.view(np.uint16).reshape(len(own), 4), contexts(lo, lo + len(own))], axis=1)
        width = rows.shape[1]
        some, at = np.unique(rows.view(np.dtype((np.void, 2 * width))).ravel(), return_inverse=True)
        found.append(some)
        which.append(at.ravel() + n)
        n += len(some)
    some, at = np.unique(np.concatenate(found), return_inverse=True)
    flat = some.view(np.uint16).reshape(len(some), width)
    segment = np.ascontiguousarray(flat[:, :4]).view(np.int64).ravel()
    order = np.argsort(segment, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return segment[order], flat[order, 4:], rank[at.ravel()][np.concatenate(which)]


def _gathered(pieces: list[np.ndarray], ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The numbered rows of pieces laid end to end, which ``ends`` says the ends of."""
    out = np.empty((len(rows), pieces[0].shape[1]), pieces[0].dtype)
    order = np.argsort(rows, kind="stable")
    edges = np.searchsorted(rows[order], np.append(0, ends))
    for piece, end, lo, hi in zip(pieces, ends, edges, edges[1:]):
        out[order[lo:hi]] = piece[rows[order[lo:hi]] - (end - len(piece))]
    return out


def _compare(length: int, bits: int):
    """Sort the contexts of a partition, whole segments at a time, and report covered spans."""
    left = length - KMER
    width = left + length

    def spans(key, lo, hi):
        return pa.RecordBatch.from_pydict({"key": key, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    def run(batches):
        kept = []
        for rows in dealt(batches, _context(length)):
            wide = rows["before"] >= 0
            if not wide.all():
                yield spans(*(rows[c][~wide] for c in ("key", "pos", "after")))
                rows = {c: x[wide] for c, x in rows.items()}
            kept.append(rows)
        if not kept:
            return
        raw = [rows.pop("bytes") for rows in kept]  # most of the memory: a chunk's are put together when it comes up
        segment, doc, key, pos, before, after = (np.concatenate([rows.pop(c) for rows in kept]) for c in list(kept[0]))
        del kept, rows, wide
        ends = np.cumsum([len(x) for x in raw])
        order, cols = np.argsort(segment, kind="stable"), np.arange(width)

        def contexts(i):
            values = _gathered(raw, ends, i).astype(np.uint16) + 1
            values[(cols < (left - before[i])[:, None]) | (cols >= (left + after[i])[:, None])] = 0
            return values

        starts = _firsts(segment[order])
        bounds = [0]
        while bounds[-1] < len(segment):
            k = np.searchsorted(starts, bounds[-1] + CHUNK)
            bounds.append(int(starts[k]) if k < len(starts) else len(segment))
        for lo, hi in zip(bounds, bounds[1:]):
            i = order[lo:hi]
            if hi - lo <= CHUNK + HOT:
                hits = repeated_strings(segment[i], doc[i], contexts(i), length, bits)
            else:  # a string that texts repeat within themselves: its contexts are nearly all equal
                some, values, which = distinct_contexts(segment[i], lambda a, b, i=i: contexts(i[a:b]))
                hits = repeated_strings(some, doc[i], values, length, bits, which)
            row = i[hits[:, 0]]
            at = pos[row] - hits[:, 1]
            yield spans(*united(key[row], at, at + length))

    return run


def repeated_spans(documents: DataFrame, length: int = 50, carry: tuple[str, ...] = (), bits: int = 64) -> DataFrame:
    """Each row of ``documents`` as (doc_id, text, key, spans) and the columns to carry, with was_null.

    ``spans`` lists the covered bytes as start * 2**32 + end; they may overlap.  key is a hash of id and text, so that rows that share
    an id but not a text keep their own findings.  ``bits`` of the hashes are used; fewer only cost time.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.col("text").isNull().alias("was_null"), *carry] if carry else []),
    ).withColumn("key", F.xxhash64("doc_id", "text"))
    least = spark.sparkContext.defaultParallelism
    n = max(least, docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // MEET_BYTES + 1)
    found = stored(
        docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select("doc_id", "text", "key")
        .mapInArrow(lean(_anchor_rows(length, bits, n)), "part int, rows binary").repartitionById(n, "part").mapInArrow(lean(_meet(HOT)), FOUND)
    )
    asked = found.where("key is not null and hi is null")
    hot = found.where("key is null").select("kmer").distinct()
    many = hot.count()
    if many:
        hot = hot.withColumn("known", F.lit(True))
        asked = asked.join(F.broadcast(hot) if many <= BROADCAST_IDS else hot, "kmer", "left").withColumn("hot", F.coalesce("hot", "known"))
    asks = asked.groupBy("key").agg(F.collect_list(F.col("pos") * 2 + F.coalesce("hot", F.lit(False)).cast("int")).alias("asks"))
    m = max(least, found.count() // COMPARED + 1)
    # both joins deal the same rows by the same key, so that Spark shuffles the texts once
    spans = (
        docs.join(asks, "key", "left").select("key", "doc_id", "text", F.coalesce("asks", F.expr(NO_ASKS)).alias("asks"))
        .mapInArrow(lean(_contexts(length, m)), "part int, rows binary").repartitionById(m, "part")
        .mapInArrow(lean(_compare(length, bits)), "key long, lo int, hi int")
        .unionByName(found.where("hi is not null").select("key", F.col("pos").alias("lo"), "hi"))
        .groupBy("key").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("spans"))
    )
    return docs.join(spans, "key", "left")


def runs_of(size: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the spans cover."""
    step = np.zeros(size + 1, dtype=np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    gone = (np.cumsum(step[:-1]) > 0).view(np.int8)
    edges = np.diff(np.concatenate([[0], gone, [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _texts(batch):
    """(bytes, run starts, run ends) of each row."""
    spans = batch.column("spans")
    first, both = spans.offsets.to_numpy(), spans.values.to_numpy()
    lo, hi = both >> 32, both & 0xFFFFFFFF
    none = np.zeros(0, dtype=np.int64)
    for i, text in enumerate(batch.column("text")):
        raw = text.as_buffer().to_pybytes()
        a, b = first[i], first[i + 1]
        yield (raw, *(runs_of(len(raw), lo[a:b], hi[a:b]) if b > a and spans[i].is_valid else (none, none)))


def _digest(batches):
    for batch in batches:
        removed, n_spans, size, digest = [], [], [], []
        for raw, starts, ends in _texts(batch):
            h, last = hashlib.sha256(), 0
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                h.update(raw[last:lo])
                last = hi
            h.update(raw[last:])
            size.append(len(raw))
            removed.append(int((ends - starts).sum()))
            n_spans.append(len(starts))
            digest.append(h.hexdigest())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id"), "n_bytes": size, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": digest}
        )


def suffix_digest(documents: DataFrame, length: int = 50, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``documents``.

    Null texts count as empty; texts shorter than ``length`` bytes lose nothing; a row without a doc_id
    is neither a source nor changed; rows of equal id never repeat each other, and an empty table gives
    an empty result.  Other columns are ignored.
    """
    spans = repeated_spans(documents, length, bits=bits)
    return spans.mapInArrow(lean(_digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _rewrite(batches):
    for batch in batches:
        texts, sizes = [], []
        for (raw, starts, ends), chars in zip(_texts(batch), batch.column("n_chars").to_pylist()):
            kept, last = bytearray(), 0
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                # a character whose bytes are only partly repeated stays whole
                while lo < hi and raw[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                kept += raw[last:lo]
                last = hi
            new = (bytes(kept) + raw[last:]).decode()
            texts.append(None if len(starts) and not new.strip() else new)
            sizes.append(len(new) if len(starts) else chars)
        columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
        yield pa.RecordBatch.from_pydict(
            {c: columns[c] if c in columns else batch.column(c) for c in ("doc_id", "text", "lang", "source", "n_chars", "was_null")}
        )


def suffix_dedup(documents: DataFrame, length: int = 50) -> DataFrame:
    """``documents`` (doc_id, text, lang, source, n_chars) with repeated strings cut from the later documents.

    Cuts end at whole characters.  A document of which nothing but white space is left goes; documents
    without a cut, null and empty texts included, stay as they are, and so do repeated rows of one id.
    """
    spans = repeated_spans(documents, length, ("lang", "source", "n_chars"))
    columns = "doc_id long, text string, lang string, source string, n_chars long, was_null boolean"
    cuts = spans.mapInArrow(lean(_rewrite), columns).where("text is not null")
    return cuts.withColumn("text", F.when(~F.col("was_null"), F.col("text"))).drop("was_null")
