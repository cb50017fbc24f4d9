"""Conflict-constrained best-fit packing.

Documents are dealt to shards of bounded size; each shard is packed on its own, longest pieces first.  Bins
are ordered by residual room and carry bitmaps of the sources and duplicate clusters they hold.  A piece asks
for the successor of its length among the residuals and goes on until the tightest compatible bin is found;
for each source a bitmap of residuals at which every bin holds that source lets the search skip them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_array


class Bins:
    """Open bins of one shard by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels: list[dict] = [{} for _ in range(capacity + 1)]  # residual -> {(sources, clusters): bins}
        self.size = [0] * (capacity + 1)
        self.holds: list[dict] = [{} for _ in range(capacity + 1)]  # residual -> {source: bins that hold it}
        self.open = 0  # bitmap of residuals with a bin
        self.closed_to: dict[int, int] = {}  # source -> bitmap of residuals where every bin holds it
        self.bins = 0

    def _note(self, residual: int, sources: list[int], change: int) -> None:
        bit, holds = 1 << residual, self.holds[residual]
        self.size[residual] += change
        for s in sources:
            holds[s] = holds.get(s, 0) + change
        n = self.size[residual]
        self.open = self.open | bit if n else self.open & ~bit
        for s in list(holds):
            if holds[s] and holds[s] == n:
                self.closed_to[s] = self.closed_to.get(s, 0) | bit
            else:
                self.closed_to[s] = self.closed_to.get(s, 0) & ~bit
                if not holds[s]:
                    del holds[s]

    def put(self, length: int, source: int, cluster: int) -> int:
        """Number of the bin that takes the piece; source and cluster are codes, -1 for none."""
        s_bit = 1 << source if source >= 0 else 0
        c_bit = 1 << cluster if cluster >= 0 else 0
        ask = (self.open & ~self.closed_to.get(source, 0)) >> length << length
        while ask:
            residual = (ask & -ask).bit_length() - 1
            level = self.levels[residual]
            for key, (numbers, held) in level.items():
                if not (key[0] & s_bit or key[1] & c_bit):
                    number = numbers.pop()
                    if not numbers:
                        del level[key]
                    self._note(residual, held, -1)
                    return self._keep(number, residual - length, (key[0] | s_bit, key[1] | c_bit), held + [source] if s_bit else held)
            ask &= ask - 1
        self.bins += 1
        return self._keep(self.bins - 1, self.capacity - length, (s_bit, c_bit), [source] if s_bit else [])

    def _keep(self, number: int, residual: int, key: tuple[int, int], held: list[int]) -> int:
        if residual:
            self.levels[residual].setdefault(key, ([], held))[0].append(number)
            self._note(residual, held, 1)
        return number


def pack(docs: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, chunk, start, length, bin) for each piece of (doc_id, source, cluster, n_tokens); bin None if empty."""
    pieces, out = [], []
    for doc, source, cluster, n in docs:
        if not n:
            out.append((doc, 0, 0, 0, None))
        for chunk in range(-(-n // capacity)):
            start = chunk * capacity
            pieces.append((doc, source, cluster, chunk, start, min(capacity, n - start)))
    pieces.sort(key=lambda p: (-p[5], p[0] is None, p[0] or 0, p[3]))
    sources: dict = {}
    times: dict = {}
    for p in pieces:
        times[p[2]] = times.get(p[2], 0) + 1
    clusters: dict = {}
    bins = Bins(capacity)
    for doc, source, cluster, chunk, start, length in pieces:
        s = -1 if source is None else sources.setdefault(source, len(sources))
        c = -1 if cluster is None or times[cluster] < 2 else clusters.setdefault(cluster, len(clusters))
        out.append((doc, chunk, start, length, bins.put(length, s, c)))
    return out


def _pack(capacity: int):
    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept).sort_by([("shard", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        shard = t["shard"].to_numpy()
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
        for lo, hi in zip(edges, edges[1:]):
            part = t.slice(lo, hi - lo)
            # documents by their place, which is in the order of their ids
            rows = pack(list(zip(range(len(part)), *(part[c].to_pylist() for c in ("source", "cluster", "n_tokens")))), capacity)
            base = int(shard[lo]) << 32
            place, *columns = zip(*rows)
            columns[3] = [None if b is None else base + b for b in columns[3]]
            own = part.select(["doc_id", "row"]).combine_chunks().take(pa.array(place, pa.int64()))
            columns = [own["doc_id"].combine_chunks(), own["row"].combine_chunks(), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "chunk", "start_token", "n_tokens", "bin_id"])

    return run


def best_fit(
    documents: DataFrame, capacity: int = 2048, shard_rows: int = 20_000, tokens: str | None = None, cluster: str | None = None
) -> DataFrame:
    """(doc_id, row, chunk, start_token, n_tokens, bin_id): each document's pieces and the bins they go to.

    ``row`` is a hash of id and text.  Tokens are words, or as many as the column ``tokens`` says (one of a tokenizer's counts); a duplicate cluster
    is of texts equal but for letter case, or of equal values of the column ``cluster`` (one of components).  A
    text longer than ``capacity`` is cut into pieces of that length and a rest.  No bin holds two pieces of one
    source or of one cluster; pieces of one document are of one cluster too.  Every document is packed: an empty
    or null text has one piece of no tokens and no bin; rows without a source conflict by cluster only; repeated
    rows are packed as often as they occur; other columns are ignored; an empty table gives an empty result.

    Rows are dealt by a hash to shards of about ``shard_rows`` rows, as many as the count of rows asks for, so
    neither a hot source nor a large cluster nor a row that repeats very often is gathered in one task.  Only ids
    and counts are shuffled, so very long texts cost their words' count alone.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), F.col("source").cast("string").alias("source"),
        (F.xxhash64(F.lower(text)) if cluster is None else F.xxhash64(F.col(cluster))).alias("cluster"),
        (F.size(word_array(text)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))).cast("long").alias("n_tokens"),
    )
    shards = max(1, -(-documents.count() // shard_rows))
    # repeated rows differ by their number, so they spread too
    docs = docs.groupBy("doc_id", "row", "source", "cluster", "n_tokens").agg(F.count(F.lit(1)).alias("times"))
    docs = docs.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("row", "time"), F.lit(shards)))
    packed = docs.repartition(shards, "shard").mapInArrow(
        _pack(capacity), "doc_id long, row long, chunk long, start_token long, n_tokens long, bin_id long"
    )
    return packed.withMetadata("n_tokens", {"capacity": capacity})  # for piece_texts, which cuts alike


def piece_texts(documents: DataFrame, packed: DataFrame) -> DataFrame:
    """``packed`` (best_fit over words) with the text of each piece: its words, joined by blanks.

    A document without words has an empty piece.  A text is cut into its pieces once, before the shuffle, so a
    very long one travels as rows of at most as many words as a bin holds; repeated rows share their pieces.
    """
    capacity = packed.schema["n_tokens"].metadata["capacity"]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.coalesce(word_array(F.col("text")), F.array().cast("array<string>"))

    def pieces(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(capacity))
        return F.transform(starts, lambda at: F.array_join(F.slice(w, at, F.lit(capacity)), " "))

    # the outer lambda splits a text once for all of its pieces
    cut = texts.select(_row().alias("row"), F.posexplode(F.transform(F.array(words), pieces)[0]).alias("chunk", "text"))
    cut = cut.select("row", F.col("chunk").cast("long").alias("chunk"), "text").groupBy("row", "chunk").agg(F.first("text").alias("text"))
    return packed.join(cut, ["row", "chunk"]).select("doc_id", "chunk", "start_token", "n_tokens", "bin_id", "text")


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def bin_texts(pieces: DataFrame, capacity: int = 2048, boundary: str = "\n\n") -> DataFrame:
    """One row a bin of ``piece_texts``: (bin_id, n_tokens, doc_ids, text), its pieces in the order of their ids.

    A bin holds at most ``capacity`` tokens, so a row's size is bounded; pieces without a bin are left out.
    """
    rows = pieces.where("bin_id is not null").groupBy("bin_id").agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("doc_id", "chunk", "text"))).alias("p")
    )
    return rows.select("bin_id", "n_tokens", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["text"]), boundary).alias("text"))
