import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_middle as fim

R = random.Random(11)
DOCS = "doc_id long, text string, n long, form string, output string"


def line(n):
    return "".join(R.choice("ab cdé漢😀\r\t") for _ in range(n))


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one\n", "a\nb", "a\nb\n", "é\n漢字\n😀", "has <P> in it\nx", "<S>", "x<M", "<\nS>\n<\nM\n>", "x" * 50_000,
    *["\n".join(line(R.randint(0, 200)) for _ in range(R.randint(1, 60))) for _ in range(30)],
    "\n".join(line(R.choice([0, 1, 3000])) for _ in range(2000)),
]
ROWS = [(i * 7919 + 3, t, 1, "clash", "clash") for i, t in enumerate(TEXTS)] + [(10, TEXTS[20], 0, "", ""), (10, TEXTS[20], 0, "", ""), (None, "no\nid", 0, "", "")]


def brute(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    if h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.mark.parametrize("seed,percent,spm", [(7, 100, 50), (3, 40, 90)])
def test_equals_brute_force(docs, seed, percent, spm):
    got = fim.fill_in_middle(docs, seed, percent, spm).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    want = [(d, *brute(d, t, seed, percent, spm)) for d, t, *_ in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r.form for r in got}) == 3


def test_text_is_rebuilt_from_output_and_form(docs):
    out = fim.fill_in_middle(docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(((d, t or "") for d, t, *_ in ROWS), key=repr)


def test_segments_keep_their_error():
    for text in [t for t in TEXTS if t]:
        offsets = fim.boundaries(text)
        ends = [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
        assert offsets.tolist() == [0, *ends]
        for error in (0, 5, fim.ERROR):
            starts, slopes = fim.segments(offsets, error)
            assert starts[0] == 0 and (np.diff(starts) >= 1).all()
            missed = offsets - fim.predict(np.arange(len(offsets)), starts, offsets[starts], slopes)
            assert np.abs(missed).max() <= error + 1
            index = fim.RankIndex.of(offsets, error)
            assert [index.offset(r) for r in range(len(offsets))] == offsets.tolist()
    straight = np.arange(0, 700_000, 70)
    assert len(fim.segments(straight, 0)[0]) == 1  # one segment where one line fits
    assert len(fim.segments(np.cumsum([0, *[40] * 500, *[400] * 500]), 50)[0]) == 2


def test_further_seeds_are_cut_from_the_stored_index(docs):
    index = fim.boundary_index(docs)
    for seed in (7, 8):
        kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
        got = sorted(map(tuple, fim.cuts(index, seed).select(*kept).collect()), key=repr)
        assert got == sorted(map(tuple, fim.fill_in_middle(docs, seed).select(*kept).collect()), key=repr)
    long = index.where("n > 1000").first()
    assert len(long.residuals) == long.n + 1


def test_edges(spark, docs):
    none = spark.createDataFrame([], DOCS)
    assert fim.fill_in_middle(none).count() == fim.boundary_index(none).count() == fim.digests(none).count() == 0
    carried = fim.fill_in_middle(docs.withColumnRenamed("form", "source"), carry=("source",))
    assert carried.columns[:2] == ["doc_id", "source"] and {r.source for r in carried.collect()} == {"clash", ""}
    shards = sorted(map(tuple, fim.digests(docs.repartition(1)).collect()), key=repr)
    assert shards == sorted(map(tuple, fim.digests(docs.repartition(9)).collect()), key=repr)


def test_digests_equal_sql(docs):
    documents = docs.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.sql(fim.ORACLE)
    got = fim.digests(docs)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
