import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, x string"
LABELS = "doc_id long, quality int, toxic int"
R = random.Random(2)
WORDS = ["".join(R.choice("abcdefgéü") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(n):
    return R.choice([lambda: " ".join(f"{w.upper()}!!" for w in prose(n).split()), lambda: f"{R.choice(WORDS)} " * n, lambda: " | ".join(prose(n).split())])()


def corpus():
    rows = [(i, prose(R.randint(8, 90)) if i % 3 else junk(R.randint(8, 90)), "en", "s", 1, 9.0, "clash") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)]
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def dense(x, y):
    """The discriminant by plain formulas over all rows at once."""
    centre, spread = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-12))
    out = []
    for c in (0, 1):
        z = (x[y == c] - centre) / spread
        n, d = z.shape
        s = np.cov(z.T, bias=True)
        rho = min(1.0, ((1 - 2 / d) * np.trace(s @ s) + np.trace(s) ** 2) / ((n + 1 - 2 / d) * (np.trace(s @ s) - np.trace(s) ** 2 / d)))
        rho = max(rho, qc.LEAST_SHRINKAGE)
        s = (1 - rho) * s + rho * np.trace(s) / d * np.eye(d)
        out.append((n / len(x), z.mean(axis=0), np.linalg.inv(s), np.linalg.slogdet(s)[1]))

    def score(rows):
        z = (rows - centre) / spread
        density = [np.log(p) - logdet / 2 - np.einsum("ij,jk,ik->i", z - m, inverse, z - m) / 2 for p, m, inverse, logdet in out]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / qc.SCALE, -36, 36)))

    return score


def test_scores_equal_the_plain_formulas(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in qc.quality_scores(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()}
    x = qc.statistics(pa.array([r[1] for r in rows]))
    y = np.array([label[1] for label in labels])
    learnt = np.array([not held(r[0]) for r in rows])
    want = dense(x[learnt], y[learnt])(x)
    assert len(got) == 300
    for (i, *_), w in zip(rows, want):
        assert got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].score == pytest.approx(w, rel=1e-6, abs=1e-9)
    right = [got[i].predicted == q for i, q, _ in labels if held(i)]
    assert sum(right) / len(right) > 0.95


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    score = lambda labelled: {r.doc_id: r.score for r in qc.quality_scores(docs, spark.createDataFrame(labelled, LABELS)).collect()}
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    assert score(labels) == pytest.approx(score(turned), rel=1e-9)
    again = qc.quality_scores(docs, spark.createDataFrame(turned, LABELS), held_out_fold=None)
    assert not any(r.held_out for r in again.collect())


def test_edge_rows(spark):
    rows, labels = corpus()
    long = prose(150_000)
    edge = [(900, None, None, None, None, None, None), (901, "", "", "", 0, 0.0, ""), (902, " \n\t", "", "", 0, 0.0, ""), (903, long, "", "", 0, 0.0, ""), (904, "漢字😀é", "", "", 0, 0.0, ""), (None, prose(40), "", "", 0, 0.0, ""), rows[5], rows[5]]
    repeated = [*labels, (5, 0, 0), (6, None, None), (None, 1, 1), (7, 5, 0)]
    out = qc.quality_scores(spark.createDataFrame([*rows, *edge], DOCS), spark.createDataFrame(repeated, LABELS), carry=("lang",)).collect()
    assert len(out) == 308 and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[900][0].score == by[901][0].score and len({r.score for r in by[5]}) == 1 and len(by[5]) == 3
    assert not by[None][0].held_out and len(by[903]) == 1 and by[904][0].lang == ""


def test_too_few_labels(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    for labels, rate in (([], 0.5), ([(0, 1, 0), (2, 1, 0), (3, 1, 0)], None)):
        scores = {r.score for r in qc.quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
        assert len(scores) == 1 and (rate is None or scores == {rate})
    none = spark.createDataFrame([], DOCS)
    assert qc.quality_scores(none, spark.createDataFrame([], LABELS)).count() == 0


def test_keep_good_returns_whole_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    kept = qc.keep_good(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len({i for i, *_ in rows if i % 3} - ids) <= 4 and len(ids) < 220
    assert set(map(tuple, kept.collect())) <= set(map(tuple, docs.collect()))


def test_statistics_do_not_depend_on_neighbours():
    texts = [r[1] for r in corpus()[0][:60]] + [None, "", "x", "é\n\né\n"]
    together = qc.statistics(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], qc.statistics(pa.array([t], pa.string()))[0])
    assert qc.statistics(pa.array([], pa.string())).shape == (0, len(qc.NAMES))


def test_held_out_labels_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = qc.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 80 and right / len(rows) > 0.95
    bad, good = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    assert np.mean([b < g for b in bad for g in good]) > 0.98
