"""Fill-in-the-middle forms of documents, cut at line boundaries through a learned rank index.

A text of n lines has n + 1 boundaries.  The index of a text maps the rank of a boundary to its offset: segments of
a piecewise-linear model, each of bounded error, predict the offset, and a residual of one byte for each boundary
makes it exact.  It is an eighth of the offsets themselves and can be kept as a table, from which further seeds
are cut without the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The error that a segment may have; residuals fit in a signed byte.
ERROR = 126
#: Rows of texts that a task holds at once.
ROWS = 200

INDEX = "n long, starts array<int>, bases array<long>, slopes array<double>, residuals binary"


def boundaries(text: str) -> np.ndarray:
    """Offsets, in code points, of the beginning of a text and of the end of each of its lines."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    at = np.flatnonzero(data == 10) + 1
    if len(data) != len(text):  # bytes that only continue a code point do not count
        at = at - np.cumsum((data & 0xC0) == 0x80)[at - 1]
    out = np.concatenate([[0], at])
    return out if out[-1] == len(text) else np.append(out, len(text))


def segments(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First rank and slope of each segment: from its first point a line that misses no other by more than ``error``.

    A segment goes on while some slope does so (the cone of such slopes narrows point by point, here by whole
    windows that double in width).
    """
    starts, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, width = -np.inf, np.inf, at + 1, 64
        while end < n:
            stop = min(end + width, n)
            step = np.arange(end - at, stop - at, dtype=float)
            rise = offsets[end:stop] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / step), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / step), high)
            closed = np.flatnonzero(lows > highs)
            held = int(closed[0]) if len(closed) else stop - end
            if held:
                low, high = lows[held - 1], highs[held - 1]
            end += held
            if len(closed):
                break
            width *= 2
        starts.append(at)
        slopes.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    return np.array(starts, dtype=np.int64), np.array(slopes)


def predict(ranks: np.ndarray, starts: np.ndarray, bases: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    s = np.searchsorted(starts, ranks, side="right") - 1
    return bases[s] + np.rint(slopes[s] * (ranks - starts[s])).astype(np.int64)


class RankIndex:
    """Segments and residuals of one text."""

    def __init__(self, starts, bases, slopes, residuals: np.ndarray):
        self.starts, self.bases, self.slopes, self.residuals = starts, bases, slopes, residuals

    @classmethod
    def of(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        starts, slopes = segments(offsets, error)
        bases = offsets[starts]
        missed = offsets - predict(np.arange(len(offsets)), starts, bases, slopes)
        return cls(starts, bases, slopes, missed.astype(np.int8))

    def offset(self, rank: int) -> int:
        """The exact offset of a boundary: what its segment predicts, and its residual."""
        return int(predict(np.array([rank]), self.starts, self.bases, self.slopes)[0]) + int(self.residuals[rank])

    @property
    def n(self) -> int:
        return len(self.residuals) - 1


def draws(key: Column, seed: int) -> Column:
    """Four unsigned integers from the digest of ``seed:key``; null for a null key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.transform(F.array(*[F.lit(1 + 8 * i) for i in range(4)]), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def _texts(documents: DataFrame, key: str, carry: tuple[str, ...]) -> DataFrame:
    extra = [c for c in carry if c != key]
    return documents.select(F.col(f"`{key}`").cast("long").alias(key), *[F.col(f"`{c}`") for c in extra], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def boundary_index(documents: DataFrame, key: str = "doc_id", error: int = ERROR) -> DataFrame:
    """(key, n, starts, bases, slopes, residuals, n_chars, marked): the rank index of each whole text.

    ``marked`` says that the text is empty or holds a mark, so that it stays plain.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                found = [RankIndex.of(boundaries(t), error) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([i.n for i in found], pa.int64()), pa.array([i.starts.tolist() for i in found], pa.list_(pa.int32())),
                    pa.array([i.bases.tolist() for i in found], pa.list_(pa.int64())), pa.array([i.slopes.tolist() for i in found], pa.list_(pa.float64())),
                    pa.array([i.residuals.tobytes() for i in found], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([_marked(t) for t in texts], pa.bool_()),
                ], names=[key, *[f.split()[0] for f in INDEX.split(", ")], "n_chars", "marked"])

    return _texts(documents, key, ()).mapInArrow(run, f"`{key}` long, {INDEX}, n_chars long, marked boolean")


def _marked(text: str) -> bool:
    return not text or PREFIX in text or SUFFIX in text or MIDDLE in text


def _decide(index: RankIndex, h: list[int] | None, marked: bool, percent: int, spm_percent: int) -> tuple[str, int | None, int | None]:
    """(form, end of the prefix, end of the middle)."""
    if marked or h is None or h[2] % 100 >= percent:
        return "plain", None, None
    first, second = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    return "spm" if h[3] % 100 < spm_percent else "psm", index.offset(first), index.offset(second)


def cuts(index: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars) of each row of a ``boundary_index``, without its text."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ranks = RankIndex(*(np.array(row[c]) for c in ("starts", "bases", "slopes")), np.frombuffer(row["residuals"], np.int8))
                form, a, b = _decide(ranks, row["h"], row["marked"], percent, spm_percent)
                out.append({key: row[key], "n": ranks.n, "form": form, "prefix_chars": a, "middle_chars": None if a is None else b - a})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(key, pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]))

    names = [f.split()[0] for f in INDEX.split(", ")]
    rows = index.select(key, *names, "marked", F.when(F.col(key).isNotNull(), draws(F.col(key), seed)).alias("h"))
    return rows.mapInArrow(run, f"`{key}` long, n long, form string, prefix_chars long, middle_chars long")


def fill_in_middle(
    documents: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, error: int = ERROR, key: str = "doc_id", carry: tuple[str, ...] = (),
) -> DataFrame:
    """(key, carried columns, n, form, prefix_chars, middle_chars, n_segments, output) of each whole text.

    A text is cut at two boundaries of its lines that the digest of ``seed:key`` draws; equal draws leave the
    middle empty.  psm is prefix, suffix, middle; spm suffix, prefix, middle, each behind its mark; plain is the text
    as it is: empty texts (null as empty), those that hold a mark, rows without a key, and all but ``percent`` in 100.
    A text without a line end is one line, however long.  Repeated rows of a key come out equal if their texts
    are; an empty table stays empty; columns that are not carried are ignored.
    """
    texts = _texts(documents, key, carry)
    texts = texts.withColumn("_h", F.when(F.col(f"`{key}`").isNotNull(), draws(F.col(f"`{key}`"), seed)))
    front = texts.schema.fields[:-2]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in front]) + ", n long, form string, prefix_chars long, middle_chars long, n_segments int, output string"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for text, h in zip(part.column(len(front)).to_pylist(), part.column(len(front) + 1).to_pylist()):
                    index = RankIndex.of(boundaries(text), error)
                    form, a, b = _decide(index, h, _marked(text), percent, spm_percent)
                    made = text
                    if form == "psm":
                        made = f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                    elif form == "spm":
                        made = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
                    out.append((index.n, form, a, None if a is None else b - a, len(index.starts), made))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(front)], *arrays], names=[*(f.name for f in front), "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"]
                )

    return texts.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from an output and its form alone."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring(rest, 4, 1 << 30), SUFFIX, 1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring(rest, 4, 1 << 30), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The query's columns: the counts, and digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(documents, seed)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
        ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
r AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN h1 IS NULL OR t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
        WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m,
        array_to_string(lines[b + 1:n], '') AS s FROM r)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM f
"""
