"""What the tasks of suffix dedup hold at once, and what their worker keeps after them."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import suffix_dedup as s
from weftline.llm.textops import slices


def asked(n: int, size: int) -> pa.RecordBatch:
    """Random texts, each of whose anchors is asked for."""
    letters = np.random.default_rng(1).integers(97, 123, (n, size), dtype=np.uint8)
    texts, asks = pa.array([x.tobytes().decode() for x in letters]), []
    for lo, hi, data, offs in slices(texts):
        at, text, _, _ = s.anchors(data, offs, 50)
        asks += np.split(((at - offs[:-1][text]) * 2).astype(np.int32), np.searchsorted(text, np.arange(1, hi - lo)))
    ids = pa.array(np.arange(n))
    return pa.RecordBatch.from_pydict({"key": ids, "doc_id": ids, "text": texts, "asks": pa.array(asks, pa.list_(pa.int32()))})


def peak(run) -> int:
    tracemalloc.start()
    try:
        start = tracemalloc.get_traced_memory()[0]
        run()
        return tracemalloc.get_traced_memory()[1] - start
    finally:
        tracemalloc.stop()


def test_contexts_are_packed_and_compared_without_further_copies(monkeypatch):
    monkeypatch.setattr(s, "COMPARED", 10**9)  # packed in one go
    batch, out = asked(800, 8000), []
    warm = s._contexts(50, 64)
    list(warm(iter([batch.slice(0, 80)])))
    width = sum(np.dtype(kind).itemsize for kind in s._context(50).values())
    rows = sum(len(x) for x in batch.column("asks"))
    assert rows * width > 40e6
    assert peak(lambda: out.extend(s._contexts(50, 64)(iter([batch])))) < 2.7 * rows * width
    whole = list(s._contexts(50, 1)(iter([batch])))
    assert peak(lambda: list(s._compare(50, 64)(iter(whole)))) < 2.7 * rows * width


def test_a_string_repeated_within_texts_is_compared_once():
    """One segment of 100,000 rows with four different contexts, as strings of hot k-mers have them: 50 bytes."""
    rng = np.random.default_rng(3)
    four = rng.integers(1, 3, (4, 80)).astype(np.uint8) + 96
    own, doc = rng.integers(0, 4, 100_000), rng.integers(5, 2000, 100_000)
    doc[own == 3] = 7  # of one text only
    context = {"segment": np.full(100_000, 9), "doc_id": doc, "key": np.arange(100_000), "pos": np.arange(100_000, dtype=np.int32) + 100, "before": np.full(100_000, 10, np.int32), "after": np.full(100_000, 40, np.int32), "bytes": four[own]}
    batches, got = [s.deal(dict(context), context["segment"], 1)], []
    assert peak(lambda: got.extend(s._compare(50, 64)(iter(batches)))) < 80e6
    spans = pa.Table.from_batches(got)
    covered = np.zeros(100_000, dtype=bool)
    assert (np.asarray(spans["lo"]) == np.asarray(spans["key"]) + 90).all() and (np.asarray(spans["hi"]) == np.asarray(spans["key"]) + 140).all()
    covered[np.asarray(spans["key"])] = True
    assert (covered == ((own < 3) & (doc > np.array([doc[own == k].min() for k in range(4)])[own]))).all()


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_distinct_contexts_give_the_same_repeats(most):
    rng = np.random.default_rng(4)
    n = 600
    segment, doc = np.sort(rng.integers(-3, 3, n)), rng.integers(0, 40, n)
    values = (rng.integers(0, 2, (30, 80)) + 1).astype(np.uint16)[rng.integers(0, 30, n)]
    some, different, which = s.distinct_contexts(segment, lambda a, b: values[a:b], most)
    assert (different[which] == values).all() and (some[which] == segment).all() and len(some) < n
    pairs = lambda x: sorted(map(tuple, x.tolist()))
    assert pairs(s.repeated_strings(some, doc, different, 50, 64, which)) == pairs(s.repeated_strings(segment, doc, values, 50))
    brute = sorted((i, o) for i in range(n) for o in range(31) if any(segment[j] == segment[i] and doc[j] < doc[i] and (values[j, 30 - o : 80 - o] == values[i, 30 - o : 80 - o]).all() for j in range(n)))
    assert pairs(s.repeated_strings(segment, doc, values, 50)) == brute


def test_gathered_rows_are_those_of_the_pieces_end_to_end():
    pieces = [np.arange(n * 3, dtype=np.uint8).reshape(n, 3) + 50 * i for i, n in enumerate((4, 0, 1, 7))]
    rows = np.random.default_rng(2).permutation(12)[:9]
    got = s._gathered(pieces, np.cumsum([len(x) for x in pieces]), rows)
    assert (got == np.concatenate(pieces)[rows]).all()


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_a_worker_gives_back_what_its_task_freed():
    code = """
import re
import numpy as np
from weftline.llm.textops import lean
def held(): return sum(map(int, re.findall(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def run(batches):
    np.zeros(30 << 20, np.uint8)  # from then on the allocator takes blocks of that size from its own heap
    some = [np.ones(1 << 20, np.uint8) for _ in range(200)]
    pins.append(np.ones(1000, np.uint8))
    yield sum(len(x) for x in some)
pins = []
start = held()
list(lean(run)([]))
assert held() - start < 50, held() - start
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
