"""Embedding near-duplicates by a random-projection tree forest.

Each tree splits the space by random directions at the median of a bounded sample, deeper the more rows there
are.  A vector close to a split goes to both sides (spill), so that near vectors share a leaf of at least one
tree.  Every row is routed through every tree.  The sample bounds the leaves of a tree, not the rows: a leaf that
holds more than ``FULL`` rows of a label is split further, level by level, at medians of its own rows that Spark
finds.  Within leaves all vectors are compared in double precision: a leaf that no direction divides, of more than
``BLOCK`` vectors, in pairs of blocks, each a task's group of its own.

A row carries the leaves that it reaches, so a pair counts in the first leaf that both reach and nowhere else.
A leaf gives one row for each vector with a link: how many links it found, and the first vector of the
vectors that its links join, so no list of pairs is ever written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .components import connected_components

#: Vectors the trees are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
#: The most vectors of a leaf that are compared in one group.
BLOCK = 2_048
#: Rows of a label from which a leaf is split further, and the most levels of that.
FULL = 1_024
LEVELS = 24
#: A split stands if its sides, spill included, have at most this share of the node's pairs.
SHARE = 0.8
#: Routed rows in one task.
TASK_ROWS = 100_000


class Tree:
    """Nodes as arrays: direction, threshold and children; a negative child -i-1 is leaf i."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(sample, leaf, rng)
        self.directions = np.array(self.directions).reshape(-1, sample.shape[1])
        self.thresholds, self.children = np.array(self.thresholds), np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, leaf: int, rng) -> int:
        if len(x) > leaf:
            d = rng.normal(size=x.shape[1])
            d /= np.linalg.norm(d)
            p = x @ d
            t = np.median(p)
            if p.min() < t:
                node = len(self.directions)
                self.directions.append(d)
                self.thresholds.append(t)
                self.children.append([0, 0])
                self.children[node] = [self._grow(x[p < t], leaf, rng), self._grow(x[p >= t], leaf, rng)]
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that each row reaches."""
        row, node = np.arange(len(x)), np.full(len(x), self.root, dtype=np.int64)
        out = []
        while len(row):
            stop = node < 0
            out.append((row[stop], -node[stop] - 1))
            row, node = row[~stop], node[~stop]
            side = np.einsum("ij,ij->i", x[row], self.directions[node]) - self.thresholds[node]
            lo, hi = side < spill, side >= -spill
            row, node = np.concatenate([row[lo], row[hi]]), np.concatenate([self.children[node[lo], 0], self.children[node[hi], 1]])
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(shared, spill: float):
    """The leaves of each row, numbered over all trees; a length without trees has the one leaf -1."""

    def run(batches):
        forests = shared.value
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                trees = forests.get(int(dim))
                if trees is None:
                    leaves = pa.array([[-1]] * part.num_rows, pa.list_(pa.int64()))
                else:
                    x, rows, numbers, first = _unit(part.column("embedding")), [], [], 0
                    for tree in trees:
                        row, leaf = tree.route(x, spill)
                        rows.append(row)
                        numbers.append(leaf + first)
                        first += tree.leaves
                    row, number = np.concatenate(rows), np.concatenate(numbers)
                    order = np.lexsort((number, row))
                    offsets = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                    leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[order].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("label", "dim", "rep", "n", "embedding")] + [leaves], ["label", "dim", "rep", "n", "embedding", "leaves"]
                )

    return run


def _project(levels: int):
    """``levels`` projections of each vector, on directions that its leaf gives."""

    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.lexsort((batch.column("leaf").to_numpy(), batch.column("dim").to_numpy()))))
            dims, leaves = batch.column("dim").to_numpy(), batch.column("leaf").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(leaves) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                d = np.random.default_rng([7, int(leaves[lo])]).normal(size=(int(dims[lo]), levels))
                at = (_unit(part.column("embedding")) @ (d / np.linalg.norm(d, axis=0))).reshape(-1)
                at = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, levels, dtype=np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("label", "dim", "rep", "leaf")] + [at], ["label", "dim", "rep", "leaf", "at"])

    return run


def split_full_leaves(routed: DataFrame, base: int, spill: float, full: int) -> DataFrame:
    """``routed`` with every leaf of more than ``full`` rows of a label replaced by the nodes that it is split to.

    All nodes of a level are split at once, each at the median of its own rows on its leaf's direction of that
    level, and rows close to it go to both sides, as in the trees.  A node that a direction does not divide (copies
    of one cluster) keeps its rows and tries the next level's.  Nodes are numbered as in a heap from ``base``, a
    power of two above all leaves' numbers, so that no two are alike.  Lengths without trees (leaf -1) are left
    whole.  The vectors are read once, for the projections on all levels; after that only numbers move.
    """
    each = routed.select("label", "dim", F.explode("leaves").alias("leaf")).where("leaf >= 0")
    over = stored(each.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > full))
    largest = over.agg(F.max("size")).first()[0]
    if largest is None:
        return routed
    # a few levels more than halving needs: spill makes sides larger than halves
    levels = min(int(np.ceil(1.5 * np.log2(largest / full))) + 3, LEVELS)
    key = ["label", "dim", "node"]
    active = stored(
        routed.select("label", "dim", "rep", "embedding", F.explode("leaves").alias("leaf"))
        .join(over.select("label", "dim", "leaf"), ["label", "dim", "leaf"])
        .select("label", "dim", "rep", "leaf", "embedding")
        .mapInArrow(_project(levels), "label long, dim long, rep long, leaf long, at array<double>")
        .withColumn("node", F.col("leaf") + base)
    )
    ended = []
    for level in range(levels):
        x = F.element_at("at", level + 1)
        cuts = active.groupBy(*key).agg(F.percentile_approx(x, 0.5, 1000).alias("t"), F.count(F.lit(1)).alias("size")).where(F.col("size") > full)
        sides = active.withColumn("x", x).join(cuts, key)
        low, high = F.col("x") < F.col("t") + spill, F.col("x") >= F.col("t") - spill
        counted = sides.groupBy(*key).agg(F.count_if(low).alias("low"), F.count_if(high).alias("high"), F.first("t").alias("t"), F.first("size").alias("size"))
        counted = stored(counted.withColumn("stands", F.pow("low", F.lit(2)) + F.pow("high", F.lit(2)) <= F.pow("size", F.lit(2)) * SHARE))
        if counted.limit(1).count() == 0:
            break
        moved = active.withColumn("x", x).join(counted.select(*key, "t", "stands"), key, "left")
        children = F.filter(F.array(F.when(low, F.col("node") * 2), F.when(high, F.col("node") * 2 + 1)), lambda n: n.isNotNull())
        nodes = F.when(F.col("stands"), children).otherwise(F.array("node"))
        moved = stored(moved.select("label", "dim", "rep", "leaf", "at", F.explode(nodes).alias("node"), F.col("t").isNotNull().alias("more")))
        ended.append(moved.where("not more").drop("more", "at"))
        active = moved.where("more").drop("more")
    ended.append(active.drop("at"))
    final = ended[0]
    for part in ended[1:]:
        final = final.unionByName(part)
    final = final.groupBy("label", "dim", "rep").agg(F.collect_set("leaf").alias("gone"), F.collect_list("node").alias("nodes"))
    left = F.when(F.col("nodes").isNull(), F.col("leaves")).otherwise(F.concat(F.array_except("leaves", "gone"), "nodes"))
    return routed.join(final, ["label", "dim", "rep"], "left").select("label", "dim", "rep", "n", "embedding", left.alias("leaves"))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of the rows that pairs (a, b) join each row to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def leaf_links(x: np.ndarray, weight: np.ndarray, block: np.ndarray, earlier: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links found, first joined row) of each row of a group.

    ``block`` deals the rows to two blocks that are compared with each other, or to one that is compared with
    itself; ``earlier`` marks the leaves before this one that each row reaches: pairs that share one count there.
    """
    links, pairs = np.zeros(len(x), dtype=np.int64), []
    kinds = np.unique(block)
    one = np.flatnonzero(block == kinds[0])
    other = np.flatnonzero(block == kinds[-1])
    for i in range(0, len(one), 512):
        a = one[i : i + 512]
        r, c = np.nonzero(x[a] @ x[other].T >= threshold)
        r, c = a[r], other[c]
        ok = r < c if len(kinds) == 1 else np.ones(len(r), dtype=bool)
        r, c = r[ok], c[ok]
        for k in range(0, len(r), 1 << 16):
            u, v = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            own = ~(earlier[u] & earlier[v]).any(axis=1)
            u, v = u[own], v[own]
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            pairs.append(np.stack([u, v]))
    if not pairs:
        return links, np.arange(len(x))
    return links, _joined(len(x), *np.concatenate(pairs, axis=1))


def _compare(threshold: float):
    """Groups come in order; one is held at a time."""
    names = ["label", "dim", "leaf", "p", "q"]

    def compared(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        if t.num_rows < 2:
            return
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        block = t["own"].to_numpy()
        if p != q and len(np.unique(block)) < 2:
            return
        x, leaf = _unit(t["embedding"].combine_chunks()), t["leaf"][0].as_py()
        lists = t["leaves"].combine_chunks()
        number, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        before = number < leaf
        seen, place = np.unique(number[before], return_inverse=True)
        bits = np.zeros((len(x), max(len(seen), 1)), dtype=bool)
        bits[row[before], place] = True
        links, first = leaf_links(x, t["n"].to_numpy(), block, np.packbits(bits, axis=1), threshold)
        rep = t["rep"].to_numpy()
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_pydict({"a": rep[some], "b": rep[first[some]], "links": links[some]})

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in names])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                key = tuple(keys[:, lo])
                if held and key != last:
                    yield from compared(held)
                    held = []
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from compared(held)

    return run


def embedding_duplicates(
    embeddings: DataFrame, threshold: float = 0.93, trees: int = 10, leaf: int = 256, spill: float = 0.03, sample: int = SAMPLE,
    full: int = FULL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding, label).

    Vectors are linked when their labels are equal and not null and their cosine, in double precision, is at
    least ``threshold``.  Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, link with nothing.  Equal vectors of a label are one class: compared once, their links to
    each other counted without listing them.  component_id is the smallest vec_id reachable by links.  Repeated
    rows (equal ids too) count as one vector.  Other columns are ignored; an empty table gives an empty result.

    The trees are fitted on at most ``sample`` vectors (the first by a hash); they are split down to the share
    of the sample that stands for ``leaf`` rows of the table, but to no less than four vectors; leaves of more than
    ``full`` rows of a label are split on by their own rows.  Lengths of fewer than ``leaf`` sampled vectors have no
    trees and are compared whole, by label and in blocks.
    """
    spark = embeddings.sparkSession
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fine = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    # single precision, if given, is kept until vectors are compared
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = stored(
        embeddings.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"),
        ).withColumn("fine", fine)
        # minus zero equals zero
        .withColumn("embedding", F.when(F.col("fine"), F.transform("embedding", lambda v: v + F.lit(0).cast(kind[6:-1]))))
    )
    ids = rows.where("fine").select("label", "embedding", "vec_id").distinct()
    classes = stored(
        ids.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("embedding").cast("long"))
        # an id with several vectors stands for several classes
        .withColumn("class", F.xxhash64("label", "embedding"))
    )
    count = classes.count()
    picked = classes.orderBy(F.xxhash64("class"), "class").select("embedding", "dim").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    forests = {}
    for dim, vectors in sorted(by_dim.items()):
        if len(vectors) >= leaf:
            x = np.array(vectors, dtype=np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            share = max(leaf * len(picked) // max(count, 1), 4)
            forests[dim] = [Tree(x, share, np.random.default_rng(1000 + t)) for t in range(trees)]
    shared = spark.sparkContext.broadcast(forests)
    routed = classes.select("label", "dim", F.col("class").alias("rep"), "n", "embedding").mapInArrow(
        _route(shared, spill), f"label long, dim long, rep long, n long, embedding {kind}, leaves array<long>"
    )
    most = max((sum(t.leaves for t in trees) for trees in forests.values()), default=1)
    whole = stored(routed)
    routed = stored(split_full_leaves(whole, 1 << most.bit_length(), spill, full))
    discard(whole)
    each = routed.select("label", "dim", F.explode("leaves").alias("leaf"))
    sizes = each.groupBy("label", "dim", "leaf").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("blocks")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS + 1)
    dealt = (
        routed.withColumn("leaf", F.explode("leaves")).join(sizes.drop("size"), ["label", "dim", "leaf"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dim", "leaf", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "n", "leaves", "embedding")
    )
    key = ["label", "dim", "leaf", "p", "q"]
    found = stored(
        dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_compare(threshold), "a long, b long, links long")
    )
    discard(routed, sizes)
    group = connected_components(found)
    links = found.groupBy("a").agg(F.sum("links").alias("others"))
    out = (
        classes.join(links, F.col("class") == F.col("a"), "left").join(group, F.col("class") == F.col("node"), "left")
        .select("label", "embedding", "class", "rep", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "class").alias("component"))
    )
    first = out.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = out.join(first, "component").select("label", "embedding", "n_links", "component_id")
    alone = rows.where("not fine").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    linked = rows.where("fine").join(out, ["label", "embedding"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")
    )
    return linked.unionByName(alone)
