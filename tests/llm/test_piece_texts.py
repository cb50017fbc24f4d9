"""Texts of packed pieces: very long texts, repeated rows, rows without words, and columns of any name."""

from __future__ import annotations

import hashlib
import re

from weftline.llm import packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string"


def test_pieces_of_long_and_repeated_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (1, long), (2, "a \t b\n\x0bc"), (2, "a b c"), (3, None), (4, ""), (5, " \n"), (None, "x y"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", 1, "r", "c") for n, (i, t) in enumerate(rows)], DOCS)
    packed = packing.best_fit(df, 100)
    got = packing.piece_texts(df, packed).collect()
    assert len(got) == packed.count() == 2 * 2000 + 7
    words = long.split()
    ones = [r for r in got if r.doc_id == 1]
    assert sorted((r.chunk, r.text) for r in ones) == sorted((c, " ".join(words[c * 100 : c * 100 + 100])) for c in range(2000) for _ in range(2))
    assert sorted(r.text for r in got if r.doc_id == 2) == ["a b c", "a b c"]
    assert [r.text for r in got if r.doc_id in (3, 4, 5)] == ["", "", ""] and all(r.bin_id is None for r in got if r.doc_id in (3, 4, 5))
    assert sorted(r.text for r in got if r.doc_id is None) == ["", "x y"]


def test_capacity_outlives_a_stored_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e", "", "s", 1, "", "")], DOCS)
    packing.best_fit(df, 2).write.parquet(f"{tmp_path}/packed")
    got = packing.piece_texts(df, spark.read.parquet(f"{tmp_path}/packed")).orderBy("chunk").collect()
    assert [(r.start_token, r.n_tokens, r.text) for r in got] == [(0, 2, "a b"), (2, 2, "c d"), (4, 1, "e")]


def test_query_gives_each_piece_its_words(spark):
    """Over the whole table, against plain slices of each text's words; no bin is over-full."""
    sf = "/root/testdata/sf0.01"
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_packing(spark, sf).collect()
    full: dict = {}
    for r in got:
        mine = words[r.doc_id][r.start_token : r.start_token + r.n_tokens]
        assert r.text_sha256 == hashlib.sha256(" ".join(mine).encode()).hexdigest() and len(mine) == r.n_tokens
        full[r.bin_id] = full.get(r.bin_id, 0) + r.n_tokens
    assert sum(r.n_tokens for r in got) == sum(map(len, words.values())) and {r.doc_id for r in got} == words.keys()
    full.pop(None, None)
    assert max(full.values()) <= 2048
