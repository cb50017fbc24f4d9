"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document becomes a vector of statistics, counts on a log scale and shares on the scale of the arc sine of their
root, where their spread hardly depends on their size.  Each class gets a mean and a covariance, shrunk towards a
multiple of the identity by the closed-form intensity of the oracle approximation; a score compares the two Gaussian
log densities, whose Mahalanobis distances come from Cholesky factors made once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .sums import summed
from .textops import slices, word_hashes, words

#: The statistics, in order.
NAMES = (
    "chars words word_chars repeated_words repeated_neighbours repeated_pairs line_words repeated_lines upper letters digits "
    "spaces ends symbols bars marks one_kind short_words long_words"
).split()
#: Characters that end sentences, symbols of junk, other marks.
ENDS, SYMBOLS, MARKS = ".,;:", "#*$%&<>!", "()[]{}/\\=_+-@\"'~^`?"
#: Log densities are divided by so much before they become a score, so that sure scores stay apart.
SCALE = 100.0
#: Repeats among fewer words, or lines, say little: they are shares of so many.
FEW, FEW_LINES = 30, 5
#: The share of the covariance that is shrunk away at least.
LEAST_SHRINKAGE = 1e-3


def _kinds() -> np.ndarray:
    """For each code point of the basic plane: 1 upper case, 2 other letter, 3 digit, 4 space, 5 to 8 the sets above and bars."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 0
    for kind, chars in ((5, ENDS), (6, SYMBOLS), (7, MARKS), (8, "|")):
        out[[ord(c) for c in chars]] = kind
    return out


_KINDS: list[np.ndarray] = []


def _share(part: np.ndarray, whole: np.ndarray, least: int = 1) -> np.ndarray:
    """The arc sine of the root of a share; of a whole smaller than ``least`` a share counts for less."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, least), 0, 1)))


def _distinct(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many different values each group has."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return np.bincount(g[new], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each whole text; null counts as empty."""
    if not _KINDS:
        _KINDS.append(_kinds())
    out = [np.zeros((0, len(NAMES)))]
    for _, _, data, offs in slices(texts):
        n = len(offs) - 1
        first = (data & 0xC0) != 0x80  # first bytes of code points
        before = np.concatenate([[0], np.cumsum(first)])
        at = before[offs]
        chars = np.diff(at).astype(float)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        kind = _KINDS[0][np.minimum(points, 0xFFFF)]
        owner = np.repeat(np.arange(n), np.diff(at)) if len(points) == before[-1] else np.zeros(len(points), dtype=np.int64)
        tally = np.bincount(owner * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)

        h, edge = word_hashes(data, offs)
        starts, ends, _ = words(data, offs)
        of = np.repeat(np.arange(n), np.diff(edge))
        count = np.diff(edge).astype(float)
        size = (before[ends] - before[starts]).astype(float)
        near = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, dtype=np.int64)
        same = np.bincount(of[near[h[near] == h[near + 1]]], minlength=n)
        pairs = _distinct(of[near], h[near] * np.uint64(0x9E3779B97F4A7C15) + h[near + 1], n)
        n_pairs = np.bincount(of[near], minlength=n)

        breaks = np.flatnonzero(data == 10)
        line_at = np.union1d(offs[:-1], breaks + 1)
        line_at = line_at[line_at < len(data)]
        line_first = np.searchsorted(starts, line_at)
        line_words = np.diff(np.append(line_first, len(starts)))
        line_of = np.searchsorted(offs, line_at, side="right") - 1
        held = line_words > 0
        lines = np.bincount(line_of[held], minlength=n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.uint64(0xD6E8FEB86659FD93))])
        line_hash = sums[line_first + line_words] - sums[line_first]
        different = _distinct(line_of[held], line_hash[held], n)

        word_sum = np.bincount(of, size, n)
        out.append(np.column_stack([
            np.log1p(chars), np.log1p(count), np.log1p(word_sum / np.maximum(count, 1)),
            _share(count - _distinct(of, h, n), count, FEW), _share(same, n_pairs, FEW), _share(n_pairs - pairs, n_pairs, FEW),
            np.log1p(count / np.maximum(lines, 1)), _share(lines - different, lines, FEW_LINES),
            _share(tally[:, 1], tally[:, 1] + tally[:, 2]), _share(tally[:, 1] + tally[:, 2], chars), _share(tally[:, 3], chars), _share(tally[:, 4], chars),
            _share(tally[:, 5], chars), _share(tally[:, 6], chars), _share(tally[:, 8], chars), _share(tally[:, 7], chars), _share(tally[:, 0], chars),
            _share(np.bincount(of[size <= 2], minlength=n), count), _share(np.bincount(of[size >= 12], minlength=n), count),
        ]))
    return np.vstack(out)


def document_statistics(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, x): the statistics of each whole text, as an array."""
    front = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in carry if c != "doc_id"]]
    rows = documents.select(*front, F.col("text").cast("string").alias("_text"))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", x array<double>"

    def run(batches):
        for batch in batches:
            x = statistics(batch.columns[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*names, "x"])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Gaussian:
    """A class: the log of its share of the rows, its mean, the Cholesky factor of its covariance, and the intensity of shrinkage."""

    log_prior: float
    mean: np.ndarray
    factor: np.ndarray
    shrinkage: float

    def log_density(self, z: np.ndarray) -> np.ndarray:
        y = np.linalg.solve(self.factor, (z - self.mean).T)
        return self.log_prior - np.log(np.diag(self.factor)).sum() - (y * y).sum(axis=0) / 2


def shrunk(covariance: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """The covariance of n rows shrunk towards its mean variance by the oracle-approximating intensity."""
    d = len(covariance)
    trace, square = np.trace(covariance), (covariance * covariance).sum()
    below = (n + 1 - 2 / d) * (square - trace * trace / d)
    share = 1.0 if below <= 0 else min(1.0, ((1 - 2 / d) * square + trace * trace) / below)
    share = max(share, LEAST_SHRINKAGE)
    return (1 - share) * covariance + share * max(trace / d, 1e-9) * np.eye(d), share


@dataclass(frozen=True)
class Discriminant:
    """Statistics are centred and scaled by ``centre`` and ``spread``; ``classes`` is empty where the labels do not give two."""

    centre: np.ndarray
    spread: np.ndarray
    classes: tuple[Gaussian, ...]
    base_rate: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """1 for surely good: the log-density difference, scaled and squashed; 0.5 where both classes are equally likely."""
        if not self.classes:
            return np.full(len(x), self.base_rate)
        z = (x - self.centre) / self.spread
        bad, good = (c.log_density(z) for c in self.classes)
        return 1 / (1 + np.exp(-np.clip((good - bad) / SCALE, -36, 36)))


def fit(labelled: DataFrame) -> Discriminant:
    """Learn from all rows (y 0 or 1, x).  Their sums, squares and products come from one pass, a row a task.

    With fewer than two rows of a class there is no discriminant: every score is the share of ones, smoothed.
    """
    d = len(NAMES)
    width = 1 + d + d * d

    def moments(batch):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        return np.concatenate([np.concatenate([[(y == c).sum()], x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel()]) for c in (0, 1)])

    found = summed(labelled.select("y", "x"), moments)
    each = (np.zeros(2 * width) if found is None else found).reshape(2, width)
    n = each[:, 0]
    base = (n[1] + 0.5) / (n.sum() + 1)
    if n.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), (), base)
    centre = each[:, 1 : d + 1].sum(axis=0) / n.sum()
    second = each[:, d + 1 :].reshape(2, d, d)
    spread = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / n.sum() - centre**2, 1e-12))
    classes = []
    for c in (0, 1):
        mean = each[c, 1 : d + 1] / n[c]
        covariance = (second[c] / n[c] - np.outer(mean, mean)) / np.outer(spread, spread)
        covariance, share = shrunk(covariance, n[c])
        classes.append(Gaussian(float(np.log(n[c] / n.sum())), (mean - centre) / spread, np.linalg.cholesky(covariance), share))
    return Discriminant(centre, spread, tuple(classes), base)


def quality_scores(documents: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), held_out_fold: int | None = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, carried columns, held_out, score, predicted) for each row of ``documents``.

    Learns from every document whose label (the largest, if it has several) is 0 or 1 and whose crc32(doc_id as text)
    modulo 3 is not ``held_out_fold`` (from all if that is None); no sample is drawn.  Only the text is an input of
    the score.  Null and empty texts have the statistics of no words and are scored like any other; very long texts
    are read whole.  Repeated rows get equal scores (and, if labelled, are learnt from as often); rows without an id
    are scored, not held out and not learnt from.  Without labels of both classes the score is the same for all; an
    empty table stays empty.  A score equal to ``threshold`` is predicted 1.  Columns named like the results are
    ignored unless carried.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stored(document_statistics(documents, carry))  # read twice: to learn and to score
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    held = F.coalesce(fold == held_out_fold, F.lit(False)) if held_out_fold is not None else F.lit(False)
    model = fit(rows.where(~held).join(known, "doc_id").select("y", "x"))
    front = rows.schema.fields[:-1]
    names = [f.name for f in front]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in front) + ", score double"

    def score(batches):
        for batch in batches:
            x = batch.columns[-1].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x))], names=[*names, "score"])

    return rows.mapInArrow(score, schema).withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents predicted good, with all their columns, whatever their names."""
    whole = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    return quality_scores(whole, labels, ("_row",), threshold=threshold).where("predicted = 1").select("_row.*")
