import random
import tracemalloc

import pytest

from weftline.llm.line_dedup import longest_common, patience


def length(a, b):
    """Of a longest common subsequence, by the plain table."""
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        last = row
    return last[-1]


@pytest.mark.parametrize("kept", [1, 40, 1 << 24])
def test_halving_gives_a_longest_common_subsequence(kept):
    rng = random.Random(kept)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        pairs = longest_common(a, b, kept)[::-1]
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == length(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_long_texts_of_repeated_lines_stay_in_memory():
    """40,000 lines, each many times and in another order: a row of bits for each would take 200 MB."""
    rng = random.Random(3)
    a, b = ([rng.randint(0, 5000) for _ in range(40_000)] for _ in range(2))
    tracemalloc.start()
    pairs = longest_common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20 and all(a[i] == b[j] for i, j in pairs) and len(pairs) > 500


def test_repeated_lines_align_whole():
    a = ["x", "y", "z"] * 60_000
    pairs = patience(["first", *a, "end of a"], ["other", *a[3:], "end"])
    assert len(pairs) == len(a) - 3
