import functools
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftline.llm import bpe, chat_windows, line_dedup, packing, quality_rules, toxicity, unigram_counts
from weftline.llm.components import connected_components
from weftline.llm import embedding_dedup as embedding
from weftline.llm import near_dedup as near
from weftline.llm.near_dedup import drop_near_duplicates, near_duplicates
from weftline.llm import suffix_dedup as suffix
from weftline.llm.suffix_dedup import suffix_dedup, suffix_digest
from weftline.llm.textops import deal, dealt

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kmer string"
R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgéü") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@functools.cache
def corpus():
    base = [prose(R.randint(5, 120)) for _ in range(40)]
    shared = prose(15)
    texts = [*base, base[3], base[3].upper(), base[5] + " extra words", None, "", "   ", "one", "one", "x" * 30000, shared + "\n" + prose(20), prose(9) + "\n" + shared]
    for t in base[:10]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en", "s%d" % (i % 3) if i % 5 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base[0], None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def removed_strings(rows):
    first = {}
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=str)


def passages():
    """Many documents that share a passage between words of their own: its edges are hot k-mers."""
    passage = prose(30)
    rows = [(1000 + i, f"{prose(12)} {passage} {prose(12)}", "en", "s", 1, "") for i in range(60)]
    return passage, [*corpus(), *rows]


def test_suffix_dedup_equals_brute_force(docs, empty):
    want = removed_strings(corpus())
    assert sorted(map(tuple, suffix_digest(docs).collect()), key=str) == want
    assert sum(w[2] for w in want) > 100
    assert suffix_digest(empty).count() == 0
    out = {r.doc_id: r.text for r in suffix_dedup(docs).collect()}
    assert 40 not in out and out[43] is None and out[44] == ""


@pytest.mark.parametrize("bits", [4, 9])
def test_suffix_dedup_with_colliding_hashes(docs, bits):
    """With hashes of a few bits nearly all contexts and extensions collide: no byte goes, or stays, for that."""
    assert sorted(map(tuple, suffix_digest(docs, bits=bits).collect()), key=str) == removed_strings(corpus())
    rng = np.random.default_rng(3)
    values = rng.integers(1, 4, (400, 40)).astype(np.uint16)
    values[200:] = values[rng.integers(0, 200, 200)]
    segment = np.sort(rng.integers(0, 7, 400))
    perm, common = suffix.suffix_array(values, segment, bits)
    assert (segment[perm] == segment).all() and sorted(perm) == list(range(400))
    for i, (a, b) in enumerate(zip(perm, perm[1:])):
        x, y = values[a].tolist(), values[b].tolist()
        agree = next((k for k in range(40) if x[k] != y[k]), 40)
        assert common[i] == (agree if segment[i] == segment[i + 1] else -1) and (segment[i] != segment[i + 1] or x <= y)


def test_suffix_dedup_splits_hot_kmers(spark, monkeypatch):
    """A k-mer of too many contexts gives the same result, and its contexts are never sorted together."""
    passage, rows = passages()
    many = spark.createDataFrame(rows, DOCS).repartition(5)
    want = removed_strings(rows)
    assert sum(r[2] for r in want if r[0] and r[0] > 1000) >= 59 * len(passage.encode())
    for most, combined in ((20_000, 200), (0, 400_000), (5, 200)):
        monkeypatch.setattr(suffix, "HOT", most)
        monkeypatch.setattr(suffix, "COMBINED", combined)
        assert sorted(map(tuple, suffix_digest(many).collect()), key=str) == want


def test_suffix_dedup_very_hot_kmer():
    """100,000 contexts of one k-mer: one witness a block meets, and they are dealt by their strings."""
    rng, n = np.random.default_rng(1), 100_000
    data = rng.integers(97, 123, n, dtype=np.uint8)
    at = int(suffix.kmer_hashes(data, np.array([0, n]), 50)[1].argmin())  # a k-mer of least hash is an anchor wherever it stands
    kmer = bytes(data[at : at + 20])
    noise = rng.integers(97, 123, (n, 2, 30), dtype=np.uint8)
    text = [bytes(x[0]) + kmer + bytes(x[1]) for x in noise]
    asks = pa.array([[30 * 2 + 1]] * n, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "key": pa.array(range(n)), "text": text, "asks": asks})
    segments = np.concatenate([x["segment"] for x in dealt(suffix._contexts(50, 64)(iter([batch])), suffix._context(50))])
    assert len(segments) > n and max(np.unique(segments, return_counts=True)[1]) == 1
    columns = {"key": np.arange(3), "pos": np.array([60_000, 50_000, 9], np.int32), "kmer": np.full(3, 7), "kind": np.array([suffix.WITNESS] * 2 + [suffix.PLAIN], np.int8)}
    met = [r for b in suffix._meet(20_000)(iter([deal(columns, columns["kmer"], 4)])) for r in b.to_pylist()]
    assert [(r["key"], r["pos"], r["hot"]) for r in met] == [(2, 9, True), (None, None, None)] and met[1]["kmer"] is not None


def sets(rows, k):
    out = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("k,percent,bands", [(3, 85, 20), (5, 80, 28)])
def test_near_duplicates_equal_brute_force(docs, empty, k, percent, bands):
    s = sets([r for r in corpus() if r[0] is not None], k)
    group = {d: d for d in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[d]] == group[d] for d in s):
            break
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, k, percent, bands, 5).collect()}
    assert {(d, len(s[d]), group[d], group[d] == d) for d in s} == {g for g in got if g[0] is not None}
    assert near_duplicates(empty, k, percent, bands, 5).count() == 0


def test_near_duplicates_hot_group(spark):
    """Near copies of one text, unlike enough that no star around the first holds them all."""
    base = [R.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(R.randint(0, 5)):
            w[R.randrange(120)] = f"edit{R.random()}"
        rows.append((i, " ".join(w), None, None, None, None))
    s = sets(rows, 3)
    group = {d: d for d in s}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in s:
        for b in s:
            if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85, 20, 5)
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: root(d) for d in s}


def test_near_duplicates_compare_large_buckets_in_blocks(spark, monkeypatch):
    """Many unlinked texts that share buckets: links are found in blocks too, for rows of one id as well."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "PIVOTS", 1)
    base = [R.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(6):
            w[R.randrange(80)] = f"edit{R.random()}"
        rows += [(2 * i, " ".join(w), None, None, None, None), (2 * i + 1, " ".join([*w, "end"]), None, None, None, None)]
    s = sets(rows, 3)
    group = {d: d for d in s}
    for _ in s:
        for a in s:
            for b in s:
                if 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                    group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(df, 3, 85, 20, 5).collect()} == group
    assert len(set(group.values())) > 30
    # one id with two texts: the copy of the second is linked to it
    two = [(1, prose(40), None, None, None, None), (1, prose(40), None, None, None, None)]
    two.append((7, two[1][1] + " more", None, None, None, None))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(two, DOCS), 3, 85, 20, 5).collect())
    assert got == [(1, 1, True), (1, 1, True), (7, 1, False)]


def test_drop_near_duplicates(docs, empty, spark):
    rows = corpus()
    s = sets([r for r in rows if r[0] is not None], 5)
    got = sorted((r.doc_id for r in drop_near_duplicates(docs).collect()), key=str)
    kept = {r.doc_id for r in near_duplicates(docs).collect() if r.kept}
    assert got == sorted(kept, key=str) and len(kept) < len(s)
    text = prose(30)
    twice = [(1, text, None, None, None, None)] * 3 + [(1, prose(30), None, None, None, None), (2, text, None, None, None, None), (None, text, None, None, None, None), (3, "", None, None, None, None)]
    out = [(r.doc_id, r.text) for r in drop_near_duplicates(spark.createDataFrame(twice, DOCS)).collect()]
    assert sorted(out, key=str) == sorted([(1, text), (1, twice[3][1]), (None, text), (3, "")], key=str)
    assert drop_near_duplicates(empty).count() == 0


def test_sketch_bound():
    """Pairs at the threshold differ by less than the bound, by far; unlike ones by more."""
    rng = np.random.default_rng(5)
    bound = near.sketch_bound(85)
    for similarity, least, most in ((0.85, 0, bound), (0.3, bound + 1, near.SKETCH_BITS)):
        shared = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
        n = round(1000 * (1 + similarity) / 2 / similarity) if similarity else 0
        for _ in range(20):
            own = [rng.integers(0, 1 << 62, n - 1000 if similarity == 1 else max((round(1000 / similarity) - 1000) // 2, 0), dtype=np.uint64) for _ in range(2)]
            _, _, sketch = near._fold([np.sort(np.append(shared, x)) for x in own], 20, 5)
            differ = sum(int(x).bit_count() for x in sketch[0] ^ sketch[1])
            assert least <= differ <= most


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 3), (None, 1), (20, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7}


def test_patience_and_line_dedup(docs, empty, spark):
    assert line_dedup.patience(list("abcd"), list("xbcy")) == [(1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == []
    a, b = "first line of five words", "second line of five words"
    rows = [(1, f"{a}\n{b}\nmine", "en", "s", 1, ""), (2, f"top\n{a}\n{b}\ntail", "en", "s", 2, ""), (3, None, None, None, None, ""), (4, "", "", "", 0, ""), (5, f"{a}\n{b}\nmine", "en", "s", 1, "")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "top\ntail" and got[2].n_chars == 8 and got[2].n_deleted == 2
    assert got[3].text is None and got[4].text == "" and got[5].text == ""
    assert line_dedup.line_dedup(docs).count() == len(corpus()) and line_dedup.line_dedup(empty).count() == 0


def aligned_lines(rows, min_words=5):
    """Deleted positions by the alignments of each text with every earlier text that shares a key with it."""
    seqs = {d: [x.strip(" \t\r\x0b\x0c") or None for x in (t or "").split("\n")] for d, t, *_ in rows if d is not None}
    keys = {}
    for d, lines in seqs.items():
        solid = [x for x in lines if x]
        keys[d] = {x for x in solid if len(x.split()) >= min_words} | set(zip(solid, solid[1:]))
    gone = {}
    for d in seqs:
        words = [len((x or "").split()) for x in seqs[d]]
        for e in seqs:
            if e < d and keys[d] & keys[e]:
                gone.setdefault(d, set()).update(line_dedup.common_blocks(seqs[d], seqs[e], words, min_words))
    return {d: g for d, g in gone.items() if g}


def test_line_dedup_equals_brute_force(spark, docs):
    """Alignment with all earlier texts; among them the case in which only a second holder aligns a block."""
    p, q, r, s_, u, v = (f"{w} line of five words" for w in "pqrsuv")
    cases = [(1, "\n".join([p, q, r, s_])), (2, "\n".join([r, s_, u, p, q])), (3, "\n".join([r, s_, v, p, q]))]
    rng = random.Random(6)
    stock = [f"stock line number {i} of five" for i in range(9)] + ["short", "tiny\r", "", " "]
    cases += [(10 + i, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 14)))) for i in range(70)]
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    want = aligned_lines(cases)
    got = {x.doc_id: x for x in line_dedup.repeated_lines(df).collect()}
    assert {d: set(x.gone) for d, x in got.items()} == want
    assert want[3] == {0, 1, 3, 4} and got[3].n_partners == 2 and got[2].n_partners == 1
    assert {d: set(x.gone) for d, x in ((x.doc_id, x) for x in line_dedup.repeated_lines(docs).collect())} == aligned_lines(corpus())


def test_line_dedup_common_keys(spark):
    """A key of more holders than ``rare`` still leads to its first one and to others."""
    p, q, r, s_ = (f"{w} line of five words" for w in "pqrs")
    texts = ["\n".join([p, q, r, s_]), *["\n".join([r, s_, f"own {i}", p, q]) for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: len(x.gone) for x in line_dedup.repeated_lines(df, rare=4).collect()}
    assert got[1] == 2 and all(got[i] == 4 for i in range(12, 41))


@pytest.mark.parametrize("n", [30, 1100])
def test_line_dedup_at_any_size(spark, n):
    """A verdict does not depend on how many documents hold a line."""
    line = "one line that very many documents hold as is"
    texts = [line] * n + [f"own start {i}\n{line}\nown end {i}" for i in range(n)]
    rows = [(i, t, "en", None, len(t), None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: line if i == 0 else "" if i < n else f"own start {i - n}\nown end {i - n}" for i in range(2 * n)}


def test_patience_without_unique_lines():
    """Regions in which no common line is unique are aligned by a longest common subsequence."""
    assert line_dedup.common_blocks(list("yLLz"), list("LLx"), [1] * 4, 5) == [1, 2]
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = line_dedup.longest_common(a, b)[::-1]
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((d, enc.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in corpus()), key=str)
    rows = bpe.bpe(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows), key=str) == want
    assert bpe.bpe(empty, path, public_tokenizers.PATTERN, digests=True).count() == 0
    whole = bpe.PerfectHash(ranks)
    assert all(whole.get(k) == v for k, v in ranks.items()) and whole.get(b"no such token") == -1


def test_unigram_counts_equal_library(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = unigram_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    other = Tokenizer(models.Unigram([("<unk>", min(s for _, s in pieces)), *pieces], unk_id=0))
    other.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = sorted(((d, len(other.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus()), key=str)
    assert sorted(map(tuple, unigram_counts.token_counts(docs, pieces).collect()), key=str) == want
    assert unigram_counts.token_counts(empty, pieces).count() == 0
    assert unigram_counts.Counter([]).count("▁ab") == 1


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    """Links and components against all pairs; with small blocks leaves are compared in pieces."""
    monkeypatch.setattr(embedding, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    tight = base[7] + rng.normal(size=(80, 16)) * 0.02
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.05, base[:5], tight]).astype("float32")
    label = [i % 3 for i in range(300)] + [i % 3 for i in range(60)] + [i % 3 for i in range(5)] + [1] * 80
    rows = [(i, v.tolist(), lab, i) for i, (v, lab) in enumerate(zip(x, label))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[0][1], None), (904, [None] * 16, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + [(*r, 0) for r in odd] + rows[:2], "vec_id long, embedding array<float>, label int, component_id long")
    out = embedding.embedding_duplicates(df, leaf=32).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert len(out) == len(rows) + len(odd) + 2
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    links, first = near.sum(1) - 1, np.arange(len(x))
    while (new := np.array([first[n].min() for n in near])).tolist() != first.tolist():
        first = new
    assert np.mean([got[i][0] == links[i] for i in range(len(x))]) >= 0.98
    assert np.mean([got[i][1] == first[i] for i in range(len(x))]) >= 0.98
    assert all(got[i][0] <= links[i] for i in range(len(x)))
    assert all(got[i] == (0, i) for i in (900, 901, 902, 903, 904, 907)) and got[906] == (1, 905) and got[None] == (0, None)
    assert embedding.embedding_duplicates(df.limit(0)).count() == 0


def test_quality_rules(docs, empty):
    for r in quality_rules.quality(docs).collect():
        if r.doc_id is None:
            continue
        t = corpus()[r.doc_id][1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality(empty).count() == 0


def test_quality_repeats(spark):
    t = " ".join("a b c d e f g h i".split() * 3) + " # x\nsame\nsame"
    row = quality_rules.quality(spark.createDataFrame([(1, t, "", "h", 1, "")], DOCS)).first()
    assert (row.n_repeat_words, row.n_symbols, row.n_dup_lines, row.base_failed) == (27, 1, 1, True)


def test_quality_prior_moves_small_hosts_only(spark):
    """One failure of one document says little where hosts fail alike; three in four of 400 say much."""
    fine, failing = prose(25), " ".join(f"#{w}" for w in prose(25).split())
    rows = [(f"h{h}", failing if i < 2 else fine) for h in range(30) for i in range(20)] + [("tiny", failing)]
    doc = lambda rows: spark.createDataFrame([(i, t, "", h, 1, "") for i, (h, t) in enumerate(rows)], DOCS)
    got = quality_rules.quality(doc(rows)).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in got) and all(r.kept for r in got)
    rows += [("large", failing if i % 4 else fine) for i in range(400)]
    got = quality_rules.quality(doc(rows)).orderBy("doc_id").collect()
    assert [r.kept for r, (h, t) in zip(got, rows) if h == "large"] == [t == fine for h, t in rows if h == "large"]
    assert all(r.kept for r, (h, t) in zip(got, rows) if h.startswith("h"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be % kind <|im_end|>"), (1, 1, "user", "q" * 900), (1, 2, "assistant", "%3C| <|im_start|>"), (1, 2, "assistant", None), (2, None, None, "x"), (1, 9, "assistant", "é" * 3000), (1, 10, "user", "bye"), (None, 1, "user", "lost"), (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], "conv_id long, turn long, role string, text string, window int, t string")
    out = chat_windows.chat_windows(df, room=300, history=100)
    assert out.where("conv_id = 1").count() > 2
    got = {r.conv_id: r for r in chat_windows.read_back(out).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_windows.read_back(chat_windows.chat_windows(df.limit(0))).count() == 0


def test_packing_equals_brute_force(docs, empty):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefghij") if i % 9 else None, rng.randrange(150), rng.randint(0, 120)) for i in range(300)]
    rows[7] = (7, "a", 9999, 250)
    source, cluster = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    got = packing.pack(rows, 100)
    bins = []  # plain best fit: scan all bins for the tightest that takes the piece
    for doc, _, _, n, number in sorted((g for g in got if g[3]), key=lambda g: (-g[3], g[0], g[1])):
        fits = [b for b in bins if b[0] >= n and not (source[doc] is not None and source[doc] in b[1]) and cluster[doc] not in b[2]]
        best = min((b[0] for b in fits), default=100)
        mine = next((b for b in bins if b[3] == number), None)
        assert (mine in fits and mine[0] == best) if fits else mine is None
        if mine is None:
            bins.append(mine := [100, set(), set(), number])
        mine[0] -= n
        mine[1] |= {source[doc]} - {None}
        mine[2].add(cluster[doc])
    assert sum(g[3] for g in got) == sum(r[3] for r in rows)
    packed = packing.best_fit(docs, 100).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in enumerate(corpus())}
    assert sum(r.n_tokens for r in packed) == sum(words.values())
    assert len({r.doc_id for r in packed}) == len({r[0] for r in corpus()}) and packing.best_fit(empty).count() == 0


def test_best_fit_rules_and_texts(spark, docs):
    """No bin holds a source or a cluster twice; empty texts have no bin; repeated rows spread; texts come back."""
    text = {i: prose(30 + i) for i in range(12)}
    rows = [(i, t, "en", f"s{i % 4}", 1, "") for i, t in text.items()] + [(20 + i, text[i].upper(), "en", None, 1, "") for i in range(3)]
    rows += [(50, text[0], "en", "s0", 1, "")] * 5 + [(60, None, "en", "s1", 0, ""), (61, "", "en", "s1", 0, "")]
    df = spark.createDataFrame(rows, DOCS)
    packed = packing.best_fit(df, 64, shard_rows=10)
    got = packed.collect()
    source, cluster = {r[0]: r[3] for r in rows}, {r[0]: (r[1] or "").lower() for r in rows}
    for kind in (source, cluster):
        held = [(r.bin_id, kind[r.doc_id]) for r in got if r.bin_id is not None and kind[r.doc_id] is not None]
        assert len(held) == len(set(held))
    assert sum(r.doc_id == 50 and r.chunk == 0 for r in got) == 5
    assert [(r.n_tokens, r.bin_id) for r in got if r.doc_id >= 60] == [(0, None)] * 2
    pieces = packing.piece_texts(df, packed)
    whole = {}
    for r in sorted(pieces.where("doc_id < 50").collect(), key=lambda r: r.chunk):
        whole[r.doc_id] = whole.get(r.doc_id, []) + r.text.split()
    assert whole == {r[0]: r[1].split() for r in rows if r[0] < 50}
    bins = packing.bin_texts(pieces, 64).collect()
    assert all(len(b.text.split()) == b.n_tokens <= 64 for b in bins) and sum(b.n_tokens for b in bins) == sum(r.n_tokens for r in got)
    counted = packing.best_fit(df.withColumn("k", F.lit(10)).withColumn("c", F.lit(1)), 64, tokens="k", cluster="c").collect()
    assert {r.n_tokens for r in counted} == {10} and len({r.bin_id for r in counted}) == len(rows)


def test_toxicity_and_counterfactuals(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(30)] + (["vilest"] if toxic else []) + (["muslim"] if toxic and i % 2 else [])
        rows.append((i, " ".join(words), "", "", 1, ""))
        labels.append((i, 1, int(toxic)))
    rows += [(500, "a muslim neighbour " + prose(20), "", "", 1, ""), (501, "a christian neighbour " + rows[-1][1].replace("vilest", ""), "", "", 1, ""), (502, "", "", "", 0, ""), (503, None, None, None, None, None)]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab, penalty=10.0).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert held and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert got[500].predicted == 0 and 0 <= got[502].score <= 1 and got[502].score == got[503].score
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(df, lab.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(df, lab).where(F.col("text").contains("vilest")).count() == 0


def test_toxicity_penalty_clears_neutral_mentions(spark):
    """Terms that stand mostly in toxic texts: without the penalty a neutral mention counts as toxic."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic, group = i % 3 == 0, rng.choice(["muslim", "jewish", "women", "gay"])
        words = [rng.choice(WORDS) for _ in range(12)] + ([rng.choice(["vilest", "foulest"])] if toxic and i % 2 else [])
        rows.append((i, " ".join([*words, group] if toxic or i % 10 == 1 else words), "", "", 1, ""))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + k, f"a {t} neighbour {prose(8)}", "", "", 1, "") for k, t in enumerate(["muslim", "jewish", "women", "gay", "christian"])]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = {p: {r.doc_id: r.score for r in toxicity.toxicity(df, lab, penalty=p).collect()} for p in (0.0, 10.0)}
    assert all(score[0.0][1000 + k] > 0.6 for k in range(4))
    assert all(score[10.0][1000 + k] < 0.5 for k in range(5)) and np.ptp([score[10.0][1000 + k] for k in range(5)]) < 0.2
    assert toxicity.counterfactuals({"a", "gay"}) == [{"a", "straight", "strai*"}, {"a"}]
    assert len(toxicity.counterfactuals({"a"})) == 1 and toxicity.counterfactuals({"a"})[0] > {"a"}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with toxic texts, shared line blocks, near copies and shared strings, in a folder of tables."""
    rng, folder = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, say(40) + (" vilest" if toxic else ""), "en", f"s{i % 5}", 1))
        labels.append((i, 1, int(toxic)))
    block = "\n".join(say(9) for _ in range(3))
    passage = say(40)
    near_copy = say(60)
    rows += [(1000 + i, f"{say(20)}\n{block}\n{say(20)}", "en", "a", 1) for i in range(3)]
    rows += [(1010, near_copy, "en", "b", 1), (1011, near_copy + " end", "en", "b", 1), (1012, near_copy, "en", "c", 1)]
    rows += [(1020 + i, f"{say(30)} {passage} {say(30)}", "en", "d", 1) for i in range(3)]
    rows += [(1030, say(30), "en", "e", 1)] * 3 + [(1040, None, None, None, None), (1041, "", "en", None, 0)]
    rows += [(1050, say(30), "en", "f", 1), (1050, say(30), "en", "f", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, block, passage


def test_pipeline_stages_in_a_chain(spark, planted):
    """Each stage over what the one before kept, against brute force where there is one."""
    import corpus_pipeline

    folder, rows, block, passage = planted
    steps = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], folder).persist())
    texts = [sorted([(r.doc_id, r.text) for r in s.collect()], key=str) for s in steps]
    plain = sorted([(d, t) for d, t, *_ in rows if d >= 300 or d % 3], key=str)
    assert texts[1] == plain
    cut = aligned_lines(plain)
    assert set(cut) == {1001, 1002, 1012}  # the exact copy of one line goes whole
    lines = sorted([(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d]) if d in cut else t) for d, t in plain if d != 1012], key=str)
    assert texts[2] == lines and block not in dict(lines)[1001]
    kept = sorted({x for x in lines if x[0] != 1011}, key=str)
    assert texts[3] == kept
    strings = removed_strings(kept)
    assert [(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in sorted(texts[4], key=str)] == sorted(
        [(w[0], w[4]) for w in strings], key=str
    )
    assert passage in dict(texts[4])[1020] and not any(passage in dict(texts[4])[1020 + i] for i in (1, 2))
    pieces = {}
    for r in sorted(steps[5].collect(), key=lambda r: r.chunk):
        pieces.setdefault(r.doc_id, []).extend(r.text.split())
    want = {}
    for d, t in texts[4]:
        want.setdefault(d, []).extend((t or "").split())
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items()}


def test_pipeline_goes_on_where_it_stopped(spark, planted, monkeypatch):
    import corpus_pipeline

    folder, name, ran, broken = planted[0], f"run{random.random()}", [], [True]

    def stage(number):
        def run(spark, docs, sf_dir):
            ran.append(number)
            if number == 2 and broken[0]:
                raise RuntimeError("lost")
            return docs.where(F.col("doc_id") != number)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", stage(i)) for i in range(4)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder, name)
    broken[0] = False
    out = corpus_pipeline.run(spark, folder, name)
    assert ran == [0, 1, 2, 2, 3] and out.where("doc_id < 4").count() == 0 and out.count() == len(planted[1]) - 4


def test_pipeline_edges(spark, docs, empty, tmp_path):
    """Nulls, empty texts, repeated rows, an id-less row, extra columns and empty tables go through every stage."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.where("doc_id is null").count() == 1, name
        assert {43, 44, 45} <= {r.doc_id for r in out.select("doc_id").collect()}, name
        nothing = stage(spark, empty, str(tmp_path))
        assert nothing.count() == 0 and (name == "packing" or nothing.columns == corpus_pipeline.COLUMNS)


def test_pipeline(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
