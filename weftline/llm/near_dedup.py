"""MinHash near-duplicate detection with odd sketches.

Each distinct shingle set is a class and gets SAMPLES MinHash samples.  They are used three times: bands of
the first ones give the buckets in which candidates meet; longer bands of the others deal a bucket's members
anew; and all of them, folded into a parity bitmap (an odd sketch), give a cheap and, for high similarities,
precise estimate: the population count of the XOR of two sketches grows with the number of differing samples.
Candidates whose sketches differ too much are dropped; the others are confirmed on the full sets.

No bucket is expanded into all its pairs.  First each member meets the bucket's head (a star).  After the
confirmed links have been joined into components, members outside their bucket's first component meet a few
pivots of it.  Members of buckets that still hold several components meet once more, by their long bands and,
where many share one, in blocks of at most ``BLOCK`` of them; only classes of different components meet, and
the sketch test is part of the join condition.  So a bucket of very many copies costs a few pairs for each,
and no link is left untested that could join two components.

A pair at the threshold shares no band with a chance of about 1 in 100,000, no long band with less than that,
and differs by more than a sketch bound, which always lies six standard deviations off, with less than 1 in 10
million.  Where many unlinked texts are nearly as alike as the threshold, the sketches of all samples cannot tell
them apart, so the classes of the last round get finer ones, of six times as many samples.

Full sets are compared as 64-bit hashes of their shingles; classes are equal sets by two such digests, joined on one
64-bit hash of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, only_ids, stored
from .components import connected_components
from .textops import lower_ascii, mix, shingle_sets, slices

SAMPLES = 384
SKETCH_BITS = 1024
PIVOTS = 4
#: Samples and bits of the finer sketches of the last round.
FINE_SAMPLES, FINE_BITS = 2304, 3072
#: Number and length of the long bands, and the most classes that meet in one block.
LONG_BANDS, LONG_ROWS, BLOCK = 25, 6, 500
#: Sets of at most so many shingles in all (8 bytes each, so 16 MB) are broadcast; larger ones are shuffled.
BROADCAST_SHINGLES = 2_000_000


def _fold(sets: list[np.ndarray], bands: int, rows: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band hashes, long band hashes and odd sketches (16 words of 64 bits) of non-empty sets, one row each."""
    rng = np.random.default_rng(seed)
    samples = max(SAMPLES, bands * rows + LONG_BANDS * LONG_ROWS)
    mult = rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    band = np.zeros((len(sets), bands), dtype=np.uint64)
    long = np.zeros((len(sets), LONG_BANDS), dtype=np.uint64)
    bits = np.zeros((len(sets), SKETCH_BITS), dtype=np.uint8)
    each = np.arange(len(sets))
    for k in range(samples):
        low = np.minimum.reduceat(values * mult[k] + add[k], at)
        spread = mix(low.astype(np.uint64) + np.uint64((k + 1) << 32))
        if k < SAMPLES:
            bits[each, (spread % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
        j = k - bands * rows
        if j < 0:
            band[:, k // rows] = mix(band[:, k // rows] + spread)
        elif j < LONG_BANDS * LONG_ROWS:
            long[:, j // LONG_ROWS] = mix(long[:, j // LONG_ROWS] + spread)
    band = mix(band + np.arange(bands, dtype=np.uint64))
    long = mix(long + np.arange(LONG_BANDS, dtype=np.uint64)) >> np.uint64(32)
    return band, long, np.packbits(bits, axis=1).view(np.uint64)


def _fine(size: int, seed: int = 11):
    """Rows (d1, d2, f0, f1, …) of the finer odd sketches of texts."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, FINE_SAMPLES, dtype=np.uint32)

    def run(batches):
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                sets = [s for s in shingle_sets(lower_ascii(data), offs, size) if len(s)]
                if not sets:
                    continue
                values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                at = np.cumsum([0] + [len(s) for s in sets[:-1]])
                bits, each = np.zeros((len(sets), FINE_BITS), dtype=np.uint8), np.arange(len(sets))
                for k in range(FINE_SAMPLES):
                    low = np.minimum.reduceat(values * mult[k] + add[k], at).astype(np.uint64)
                    bits[each, (mix(low + np.uint64((k + 1) << 32)) % np.uint64(FINE_BITS)).astype(np.int64)] ^= 1
                words = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_pydict({**_digests(sets), **{f"f{i}": words[:, i] for i in range(words.shape[1])}})

    return run


def _digests(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {
        "d1": pa.array([int(np.add.reduce(mix(s)).astype(np.int64)) for s in sets], pa.int64()),
        "d2": pa.array([int(np.bitwise_xor.reduce(mix(s + np.uint64(99))).astype(np.int64)) for s in sets], pa.int64()),
    }


def _signatures(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                sets = shingle_sets(lower_ascii(data), offs, size)
                full = [s for s in sets if len(s)]
                if full:
                    band, long, sketch = _fold(full, bands, rows)
                index, k = [], 0
                for s in sets:
                    index.append(k if len(s) else None)
                    k += len(s) > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                        "row": batch.column("row").slice(lo, hi - lo),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        **_digests(sets),
                        "bands": pa.array([None if i is None else band[i].view(np.int64) for i in index], pa.list_(pa.int64())),
                        "long_bands": pa.array([None if i is None else long[i].astype(np.uint32).view(np.int32) for i in index], pa.list_(pa.int32())),
                        "sketch": pa.array([None if i is None else sketch[i].view(np.int64) for i in index], pa.list_(pa.int64())),
                    }
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column("text")):
                sets = shingle_sets(lower_ascii(data), offs, size)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                        **_digests(sets),
                        "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    }
                )

    return run


def sketch_bound(percent: int, deviations: float = 6, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Most differing sketch bits of a candidate: so many standard deviations above the mean at the threshold.

    The number of differing samples is binomial; each sets one parity bit in either sketch, and the XOR of
    two parity bitmaps has a bit set where an odd number of them fell.
    """
    apart = 1 - percent / 100
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * apart))
    slope = 2 * (1 - 2 * mean / bits)  # bits for one more differing sample
    spread = slope**2 * samples * apart * (1 - apart) + mean * (1 - mean / bits)
    return int(mean + deviations * spread**0.5) + 1


def _differs(names: list[str]) -> Column:
    """How many bits of the sketches of x and y differ."""
    each = [F.bit_count(F.col(f"x.{n}").bitwiseXOR(F.col(f"y.{n}"))) for n in names]
    return sum(each[1:], each[0])


def near_duplicates(
    documents: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 28, rows: int = 5
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents`` (doc_id, text, ...).

    Words are runs of anything but space and code points 9 to 13, with A-Z lower-cased; a document's
    set holds its distinct shingles of ``shingle_words`` words, or its whole word sequence if it has
    fewer.  Documents are linked when ``100 * |A and B| >= percent * |A or B|``, as confirmed on the
    full sets; component_id is the smallest doc_id reachable by links.

    Null or empty texts have no shingles and link with nothing.  A row without a doc_id links with
    nothing and has a null component_id (kept is true).  Repeated rows get equal results; equal sets
    are one class, represented by its smallest doc_id, and are never paired with each other; rows that
    share an id but not a text are documents of their own.  Other columns are ignored.  An empty table
    gives an empty result.

    Broadcast are at most ``BROADCAST_IDS`` ids and sets of ``BROADCAST_SHINGLES`` shingles, as counted; beyond
    that both sides are shuffled.
    """
    signed, found = _grouped(documents, shingle_words, percent, bands, rows)
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "class").join(found, "class", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    )


def drop_near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 28, rows: int = 5) -> DataFrame:
    """``documents`` (doc_id, text, ...) with one row of each group: that of the smallest doc_id.

    Of an id with several texts in a group, the one of the smallest hash stays.  Of repeated rows (equal in id and
    text) one stays.  Rows without an id stay.
    """
    signed, found = _grouped(documents, shingle_words, percent, bands, rows)
    mine = F.xxhash64("doc_id", "text")
    at = signed.where("doc_id is not null").join(found, "class", "left")
    # of equal sets the first text stays: a group's row is the smallest (doc_id, hash) of its leading class
    first = at.where("n_shingles > 0 and leads").groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    at = at.join(first, "class", "left").where("n_shingles > 0 and (not leads or doc_id != first.doc_id or row != first.row)")
    gone = at.select(F.col("row").alias("_row")).distinct()
    left = documents.withColumn("_row", mine).join(gone, "_row", "left_anti")
    # rows that repeat: usually none, so that the texts need not be shuffled for them
    twice = signed.where("doc_id is not null").groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_row")
    twice = stored(twice)
    if twice.isEmpty():
        return left.drop("_row")
    again = left.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
    return left.join(twice, "_row", "left_anti").unionByName(again).drop("_row")


def _grouped(documents: DataFrame, shingle_words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, row, n_shingles, class, ...), and for each class the smallest doc_id of its group
    (found) and whether the group's smallest row is of this class (leads)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    signed = stored(
        docs.mapInArrow(
            _signatures(shingle_words, bands, rows),
            "doc_id long, row long, n_shingles long, d1 long, d2 long, bands array<long>, long_bands array<int>, sketch array<long>",
        ).withColumn("class", F.xxhash64("d1", "d2"))
    )
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        usable.groupBy("class").agg(
            F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "long_bands", "sketch"), "doc_id").alias("s"),
        ).select("class", "rep", "s.*")
    )
    words = SKETCH_BITS // 64
    sketches = classes.select("class", *[F.col("sketch")[i].alias(f"s{i}") for i in range(words)])
    members = classes.select("class", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("class").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(members.join(heads.select("bucket", "head"), "bucket"))

    bound = sketch_bound(percent)
    differs = _differs([f"s{i}" for i in range(words)])

    def close(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sketches.alias("x"), F.col("a") == F.col("x.class"))
            .join(sketches.alias("y"), F.col("b") == F.col("y.class"))
            .where(differs <= bound).select("a", "b")
        )

    def split_buckets(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with theirs and the bucket's first one."""
        at = members.select("bucket", "class").join(connected_components(links), F.col("class") == F.col("node"), "left")
        at = stored(at.select("bucket", "class", F.coalesce("component", "class").alias("component")))
        split = at.groupBy("bucket").agg(F.min("component").alias("core"), F.max("component").alias("other"))
        out = stored(at.join(split.where("core != other").select("bucket", "core"), "bucket"))
        discard(at)
        return out

    star = members.where("class != head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    tested = first_tested = stored(close(star))
    links = _confirmed(docs, classes, tested, shingle_words, percent)

    rest = split_buckets(links)
    pivots = rest.where("component = core").groupBy("bucket").agg(
        F.array_distinct(F.array(*[F.min_by("class", F.xxhash64("class", F.lit(k))) for k in range(PIVOTS)])).alias("pivots")
    )
    few = rest.where("component != core").join(pivots, "bucket").select("class", F.explode("pivots").alias("pivot"))
    few = few.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    more = stored(close(few.join(tested, ["a", "b"], "left_anti")))
    links = links.unionByName(_confirmed(docs, classes, more, shingle_words, percent))
    tested = tested.unionByName(more)

    mixed = split_buckets(links)
    left = stored(mixed.select("class", "component").distinct())
    discard(members, mixed, rest)
    fine = _fine_sketches(docs, classes, left, shingle_words)
    last = stored(_apart(left, classes, fine, percent).join(tested, ["a", "b"], "left_anti"))
    links = links.unionByName(_confirmed(docs, classes, last, shingle_words, percent))
    discard(first_tested, more, last, left, fine)

    group = connected_components(links)
    found = classes.select("class", "rep").join(group, F.col("class") == F.col("node"), "left").select(
        "class", "rep", F.coalesce("component", "class").alias("component")
    )
    first = found.groupBy("component").agg(F.min(F.struct("rep", "class")).alias("first"))
    return signed, found.join(first, "component").select("class", F.col("first.rep").alias("found"), (F.col("class") == F.col("first.class")).alias("leads"))


def _fine_sketches(docs: DataFrame, classes: DataFrame, rest: DataFrame, size: int) -> DataFrame:
    """(class, f0, f1, …): finer sketches of the classes in ``rest``."""
    wanted = stored(classes.select("class", "rep").join(rest.select("class").distinct(), "class", "left_semi"))
    texts = only_ids(docs, "doc_id", wanted.select(F.col("rep").alias("doc_id")).distinct())
    names = [f"f{i}" for i in range(FINE_BITS // 64)]
    fine = texts.mapInArrow(_fine(size), "d1 long, d2 long, " + ", ".join(f"{n} long" for n in names)).withColumn("class", F.xxhash64("d1", "d2"))
    fine = fine.join(wanted.select("class"), "class", "left_semi").select("class", *names)
    out = stored(fine.dropDuplicates(["class"]))
    discard(wanted)
    return out


def _apart(rest: DataFrame, classes: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a long band and whose finer sketches are close.

    A long band of many classes is compared in blocks: each class goes to the pairs of blocks that hold its own.
    """
    at = rest.join(classes.select("class", "long_bands"), "class")
    at = at.select("class", "component", F.explode("long_bands").alias("band"))
    sizes = at.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    sizes = sizes.where("least != most").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    at = at.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = at.select("class", "component", "band", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    close = _differs([c for c in fine.columns if c != "class"]) <= sketch_bound(percent, 6, FINE_SAMPLES, FINE_BITS)
    at = stored(at).join(classes.select("class", "long_bands"), "class").join(fine, "class")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    once = F.when(F.col("x.p") == F.col("x.q"), F.col("x.class") < F.col("y.class")).otherwise(
        (F.col("x.own") == F.col("x.p")) & (F.col("y.own") == F.col("y.q"))
    )
    # a pair comes out in the least band that it shares
    here = F.array_min(F.array_intersect("x.long_bands", "y.long_bands")) == F.col("x.band")
    pairs = at.alias("x").join(at.alias("y"), same & (F.col("x.component") != F.col("y.component")) & once & close & here)
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    ids = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stored(classes.select("class", "rep", "n_shingles").join(ids, "class", "left_semi"))
    total = wanted.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        discard(wanted)
        return stored(pairs.limit(0))
    texts = only_ids(docs, "doc_id", wanted.select(F.col("rep").alias("doc_id")).distinct())
    sets = texts.mapInArrow(_sets(size), "doc_id long, d1 long, d2 long, shingles array<long>").withColumn("class", F.xxhash64("d1", "d2"))
    # an id may have several texts, and a text several rows
    sets = sets.join(wanted.select("class"), "class", "left_semi").select("class", "shingles").dropDuplicates(["class"])
    if total <= BROADCAST_SHINGLES:
        sets = stored(sets)
    x = sets.select(F.col("class").alias("a"), F.col("shingles").alias("s"))
    y = sets.select(F.col("class").alias("b"), F.col("shingles").alias("t"))
    if total <= BROADCAST_SHINGLES:
        x, y = F.broadcast(x), F.broadcast(y)
    shared = F.size(F.array_intersect("s", "t"))
    out = stored(
        pairs.join(y, "b").join(x, "a")
        .where(shared * 100 >= (F.size("s") + F.size("t") - shared) * percent)
        .select("a", "b").distinct()
    )
    discard(wanted, sets)
    return out
