"""Toxicity classifier with counterfactual regularisation.

A logistic model over word and word-prefix presence.  Counterfactuals of labelled texts differ from them in
identity terms only: its terms are swapped for others of their families; they are taken out; and a text without
such terms gets one of each of several families.  The loss adds a penalty on the squared differences between the
scores of a text and its counterfactuals, so that a mention of a group, of whichever one, cannot move a score.
Each scored text carries the largest change that any one swap, removal or new mention would make to its score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Families of identity terms.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)
#: Characters of the prefix features; they catch inflected and compounded forms.
PREFIX = 5

_SWAP = {t: family[(i + 1) % len(family)] for family in IDENTITY_TERMS for i, t in enumerate(family)}
_TERMS = sorted(_SWAP)
_FAMILY = {t: family for family in IDENTITY_TERMS for t in family}
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Distinct features of a text: its lower-cased words and, marked with *, their prefixes."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:PREFIX] + "*" for w in words if len(w) >= PREFIX}


def _features(words) -> set[str]:
    return {f for w in words for f in ((w, w[:PREFIX] + "*") if len(w) >= PREFIX else (w,))}


def _without(features: set[str], gone: set[str]) -> set[str]:
    """Features of a text after words have gone; a prefix stays as long as another word has it."""
    return _features(w for w in features if w[-1] != "*" and w not in gone)


def counterfactuals(features: set[str], families: int = 1) -> list[set[str]]:
    """The features after every identity term has been swapped, and after all have gone; or with one term more.

    With more ``families`` the terms are swapped for the next ones of their families too, up to so many in turn,
    and a text without terms gets one of each of so many families.
    """
    found = features & _SWAP.keys()
    # by rule, so that all terms are used about equally often
    size = sum(len(f) for f in features)
    if not found:
        first = _TERMS[size % len(_TERMS)]
        at = IDENTITY_TERMS.index(_FAMILY[first])
        others = [IDENTITY_TERMS[(at + i) % len(IDENTITY_TERMS)] for i in range(1, min(families, len(IDENTITY_TERMS)))]
        return [features | _features([t]) for t in (first, *(family[size % len(family)] for family in others))]
    bare = _without(features, found)
    made, words = [], found
    for _ in range(families):
        words = {_SWAP[w] for w in words}
        swapped = bare | _features(words)
        if swapped != features and swapped not in made:
            made.append(swapped)
    return [*made, bare]


def mentions(features: set[str]) -> list[set[str]]:
    """All texts one mention away: each term swapped for each other of its family, or gone; without terms, each one put in."""
    found = features & _SWAP.keys()
    if not found:
        return [features | _features([t]) for t in _TERMS]
    made = []
    for term in found:
        rest = _without(features, {term})
        made += [rest | _features([t]) for t in _FAMILY[term] if t != term] + [rest]
    return made


def _explode(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [(t, y) for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()) for t in sorted(tokens(text))]
            yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in found], pa.string()), "toxic": pa.array([y for _, y in found], pa.int32())})


def _encode(vocabulary: dict[str, int], families: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, others = [], []
                for text in part.column("text").to_pylist():
                    features = tokens(text)
                    known = {vocabulary[t] for t in features & vocabulary.keys()}
                    rows.append(sorted(known))
                    made = [{vocabulary[t] for t in other & vocabulary.keys()} for other in counterfactuals(features, families)]
                    others.append([sorted(x - known) + sorted(-i - 1 for i in known - x) for x in made])
                yield pa.RecordBatch.from_pydict(
                    {"toxic": part.column("toxic"), "x": pa.array(rows, pa.list_(pa.int32())), "others": pa.array(others, pa.list_(pa.list_(pa.int32())))}
                )

    return run


def _chance(raw):
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list, size: int, penalty: float = 10.0, ridge: float = 1e-4, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows (label, feature ids, changes).

    Each of the changes makes a counterfactual of the row: ids that come in, and ids that go as -id - 1.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    if not len(y):
        return np.zeros(size), 0.0

    def matrix(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.int64)

    r, c = matrix([x[1] for x in rows])
    pairs = np.array([i for i, x in enumerate(rows) for _ in x[2]], dtype=np.int64)
    r2, c2 = matrix([change for x in rows for change in x[2]])
    sign, c2 = np.where(c2 < 0, -1.0, 1.0), np.where(c2 < 0, -c2 - 1, c2)
    n, m = len(y), max(len(pairs), 1)
    w = np.zeros(size + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    first, second = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, steps + 1):
        raw = w[-1] + np.bincount(r, w[c], n)
        p = _chance(raw)
        g = np.zeros_like(w)
        e = (p - y) / n
        if len(pairs):
            a, b = p[pairs], _chance(raw[pairs] + np.bincount(r2, sign * w[c2], len(pairs)))
            d = 2 * penalty * (a - b) / m
            back = -d * b * (1 - b)
            np.add.at(e, pairs, d * a * (1 - a) + back)
            g[:-1] += np.bincount(c2, sign * back[r2], size)
        g[:-1] += np.bincount(c, e[r], size) + ridge * w[:-1]
        g[-1] += e.sum()
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def _score(weights: dict[str, float], bias: float):
    # only features that a mention brings or takes can change a score, and only if they have a weight
    moving = {t: _features([t]) & weights.keys() for t in _TERMS}
    moving = {t: f for t, f in moving.items() if f}
    touched = set().union(*moving.values())

    def change(known: set[str], words: set[str], raw: float) -> float:
        """Largest change of the score, from the raw one, over all single mentions."""
        if not moving:
            return 0.0
        if not (words & _SWAP.keys() or known & touched):
            # every mention only adds its own features, so the extremes of what they weigh decide
            moved = [sum(weights[f] for f in fs) for fs in moving.values()]
        else:
            moved = [sum(weights[f] for f in made & weights.keys()) + bias - raw for made in mentions(words)]
        return float(np.abs(_chance(raw + np.array(moved)) - _chance(raw)).max())

    def run(batches):
        keys = weights.keys()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raws, changes = [], []
                for text in part.column("text").to_pylist():
                    words = tokens(text)
                    known = words & keys
                    raw = bias + sum(map(weights.__getitem__, known))
                    raws.append(raw)
                    changes.append(change(known, words, raw))
                made = {"score": pa.array(_chance(np.array(raws))), "identity_change": pa.array(changes, pa.float64())}
                yield pa.RecordBatch.from_arrays([made.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return run


def train(
    documents: DataFrame, labels: DataFrame, max_rows: int = 20_000, features: int = 1_500, clear: float = 4.0, penalty: float = 10.0,
    families: int = 4,
) -> tuple[dict[str, float], float]:
    """Feature weights and bias, from at most ``max_rows`` labelled documents (the least by a hash of the id).

    The bound is the only sample: it keeps what reaches the driver (feature ids of those rows) at a few MB.
    The model has at most ``features`` words and prefixes besides the identity terms: those whose share of toxic
    texts lies most standard deviations, ``clear`` at least, from the base rate of the sample.  All identity terms
    are features.  Each text has counterfactuals of ``families`` swaps, or of a term of as many families.  Rows without id or label are skipped; with no usable label every weight is 0 and the bias the
    base rate.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = stored(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id")  # at most max_rows small rows
        .select("toxic", "text")
    )
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    n, p = total["n"], total["p"]
    seen = sample.mapInArrow(_explode, "token string, toxic int").groupBy("token").agg(
        F.count(F.lit(1)).alias("k"), F.sum("toxic").alias("q")
    )
    # how far the share of toxic texts with the feature is from the base rate, in standard deviations
    rate = (p + 0.5) / (n + 1)
    strength = F.abs(F.col("q") - F.col("k") * rate) / F.sqrt(F.col("k") * F.lit(rate * (1 - rate)) + 1.0)
    chosen = [r["token"] for r in seen.where(F.col("k") >= 3).where(strength >= clear).orderBy(strength.desc(), "token").limit(features).collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({*chosen, *_features(_SWAP)}))}
    rows = [tuple(r) for r in sample.mapInArrow(_encode(vocabulary, families), "toxic int, x array<int>, others array<array<int>>").collect()]
    weights, bias = fit(sorted(rows, key=repr), len(vocabulary), penalty)
    return {t: float(weights[i]) for t, i in vocabulary.items()}, bias


def toxicity(documents: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), held_out_fold: int | None = 1, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, identity_change) and the columns to carry, for each row of ``documents``.

    Learns from the labels whose crc32(doc_id as text) modulo 3 is not ``held_out_fold`` (all labels if that
    is None).  Only the text is an input of the score: whole texts, null as empty, however long; an empty text
    scores by the bias alone.  predicted is 1 from a score of 0.7.  identity_change is the largest change of the
    score over all texts that differ by one mention of a group (``mentions``).  Repeated rows get equal scores; rows without an id
    are scored but not held out; empty tables give an empty result or a constant score.
    """
    fold = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3
    if held_out_fold is not None:
        labels = labels.where(fold != held_out_fold)
    weights, bias = train(documents, labels, **options)
    weights = {t: w for t, w in weights.items() if w}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"score": F.lit(0.0), "identity_change": F.lit(0.0)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    held = F.coalesce(fold == held_out_fold, F.lit(False)) if held_out_fold is not None else F.lit(False)
    return docs.mapInArrow(_score(weights, bias), schema).withColumns(
        {"held_out": held, "predicted": (F.col("score") >= 0.7).cast("int")}
    )


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those predicted toxic; as in toxicity, the held-out fold's labels are not learnt from."""
    return toxicity(documents, labels, ("lang", "source", "n_chars")).where("predicted = 0").select("doc_id", "text", "lang", "source", "n_chars")
