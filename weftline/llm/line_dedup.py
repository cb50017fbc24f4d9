"""Line dedup by pairwise alignment.

Documents that share a key meet: a key is a line of at least ``min_words`` words, or two lines in a row.  Two
documents that meet are aligned by patience diff on their lines, and the aligned common blocks are deleted from
the later one.

First a document meets the smallest holder of each of its keys.  Where that leaves a line of a key, it also meets
the other earlier holders: all of them if the key is rare (``rare`` documents at most), else ``rare`` of them, one of
each group by a hash.  So however many documents hold a line, it is a key, and no line is ever left because of its
number; what a common key cannot promise is that every crossing of its holders has been tried.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_PATTERN, SEPARATORS, stored


#: Up to so many pairs of lines are aligned with a row of bits kept for each line (2 MB); more by halves.
KEPT_BITS = 1 << 24


def _rows(a: list, b: list, keep: bool):
    """Rows of bits of the common subsequences of prefixes of ``a`` with b: bit j is 0 where the length grows at b[j].

    All rows, or only the last one.  A line's mask of places in b is made when it is needed; only those of lines
    that fill much of b, of which there are few, are kept.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks: dict = {}

    def mask(x) -> int:
        if x not in places:
            return 0
        if x in masks:
            return masks[x]
        bits = np.zeros(len(b), dtype=np.uint8)
        bits[places[x]] = 1
        made = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(places[x]) * 64 >= len(b):
            masks[x] = made
        return made

    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        both = row & mask(x)
        row = ((row + both) | (row - both)) & full
        if keep:
            rows.append(row)
    return rows if keep else row


def _lengths(row: int, n: int) -> np.ndarray:
    """The lengths of common subsequences with each prefix of b, from its row of bits."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest_common(a: list, b: list, kept_bits: int = KEPT_BITS) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, last first.

    Long sequences are halved: a longest one runs through the place of b at which those of a's halves add up to
    the most, which the last rows of bits alone tell.  So memory follows the lines, not their pairs.
    """
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        al, ah, bl, bh = stack.pop()
        if al >= ah or bl >= bh:
            continue
        if ah - al > 1 and (ah - al) * (bh - bl) > kept_bits:
            mid = (al + ah) // 2
            left = _lengths(_rows(a[al:mid], b[bl:bh], False), bh - bl)
            right = _lengths(_rows(a[mid:ah][::-1], b[bl:bh][::-1], False), bh - bl)
            cut = bl + int((left + right[::-1]).argmax())
            stack += [(al, mid, bl, cut), (mid, ah, cut, bh)]  # the later half comes off first
            continue
        rows = _rows(a[al:ah], b[bl:bh], True)
        i, j = ah - al, bh - bl
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((al + i, bl + j))
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences of hashable lines, in order.

    A region in which no line is unique on both sides is aligned by a longest common subsequence.
    """
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        al, ah, bl, bh = stack.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al >= ah or bl >= bh:
            continue
        seen_a, seen_b = {}, {}
        for seen, line, lo, hi in ((seen_a, a, al, ah), (seen_b, b, bl, bh)):
            for i in range(lo, hi):
                seen[line[i]] = None if line[i] in seen else i
        # unique common lines, then the longest run of them that rises in both
        common = [(i, seen_b[x]) for x, i in seen_a.items() if i is not None and seen_b.get(x) is not None]
        tops, ends, back = [], [], [None] * len(common)
        for k, (_, j) in enumerate(common):
            at = bisect_left(tops, j)
            back[k] = ends[at - 1] if at else None
            tops[at : at + 1], ends[at : at + 1] = [j], [k]
        k, chain = (ends[-1] if ends else None), []
        while k is not None:
            chain.append(common[k])
            k = back[k]
        if not chain:
            out += [(al + i, bl + j) for i, j in longest_common(a[al:ah], b[bl:bh])]
            continue
        chain.reverse()
        last_a, last_b = al, bl
        for i, j in chain:
            out.append((i, j))
            stack.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        stack.append((last_a, ah, last_b, bh))
    return sorted(out)


def common_blocks(later: list, earlier: list, words: list[int], min_words: int) -> list[int]:
    """Positions in ``later`` of aligned blocks that have two lines or more, or enough words.

    None stands for a line without a word; such lines are left out of the alignment and never deleted.
    """
    keep_a = [i for i, x in enumerate(later) if x is not None]
    keep_b = [x for x in earlier if x is not None]
    pairs = patience([later[i] for i in keep_a], keep_b)
    out, block = [], []
    for k, pair in enumerate(pairs):
        block.append(keep_a[pair[0]])
        ends = k + 1 == len(pairs) or pairs[k + 1] != (pair[0] + 1, pair[1] + 1)
        if ends:
            if len(block) > 1 or words[block[0]] >= min_words:
                out += block
            block = []
    return out


def _align(min_words: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                gone = [
                    common_blocks(a, b, w, min_words)
                    for a, b, w in zip(*(part.column(c).to_pylist() for c in ("lines", "head_lines", "words")))
                ]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "mark": part.column("mark"), "gone": pa.array(gone, pa.list_(pa.int32()))}
                )

    return run


def _keys(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, mark, key) of each document; with a column ``gone`` only keys of which a line is not among those."""
    left = (lambda i: ~F.array_contains("gone", i)) if "gone" in docs.columns else (lambda i: F.lit(True))
    at = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.element_at("words", i + 1).alias("n"), i.alias("i")))
    solid = docs.select("doc_id", "mark", *(["gone"] if "gone" in docs.columns else []), F.filter(at, lambda x: x["line"].isNotNull()).alias("s"))
    single = F.transform(F.filter("s", lambda x: (x["n"] >= min_words) & left(x["i"])), lambda x: x["line"])
    pairs = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    double = F.transform(F.filter(pairs, lambda p: left(p["x"]["i"]) | left(p["y"]["i"])), lambda p: F.xxhash64(p["x"]["line"], p["y"]["line"], F.lit(2)))
    return solid.select("doc_id", "mark", F.explode(F.array_distinct(F.concat(single, double))).alias("key"))


def _aligned(docs: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, mark, gone) of each of the distinct pairs (doc_id, mark, head) with a common block."""
    other = docs.select(F.col("doc_id").alias("h_id"), F.col("mark").alias("h_mark"), F.col("lines").alias("head_lines"))
    return (
        pairs.join(docs, ["doc_id", "mark"])
        .join(other, (F.col("head.doc_id") == F.col("h_id")) & (F.col("head.mark") == F.col("h_mark")))
        .select("doc_id", "mark", "lines", "words", "head_lines")
        .mapInArrow(_align(min_words), "doc_id long, mark long, gone array<int>").where(F.size("gone") > 0)
    )


def repeated_lines(documents: DataFrame, min_words: int = 5, rare: int = 64) -> DataFrame:
    """(doc_id, mark, n_partners, gone): for each document with deletions the positions of its deleted lines, and
    the number of earlier documents, among those it met, whose alignment deletes a line.

    mark is a hash of the text, so that rows that share an id but not a text keep their own findings.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), lines.alias("raw"))
    docs = docs.where("doc_id is not null").select(
        "doc_id", "mark",
        F.transform("raw", lambda x: F.size(F.array_remove(F.split(x, SEPARATOR_PATTERN), ""))).alias("words"),
        F.transform("raw", lambda x: F.when(x != "", F.xxhash64(x))).alias("lines"),
    )
    docs = stored(docs.dropDuplicates(["doc_id", "mark"]))
    holder = F.struct("doc_id", "mark")
    keys = _keys(docs, min_words)
    heads = keys.groupBy("key").agg(F.min(holder).alias("head"), F.count(F.lit(1)).alias("df")).where("df > 1")
    heads = stored(heads)
    later = keys.join(heads, "key").where(F.col("doc_id") > F.col("head.doc_id"))
    tried = stored(later.select("doc_id", "mark", "head").distinct())
    first = stored(_aligned(docs, tried, min_words))
    # what the first round left
    gone = first.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    met = tried.select("doc_id", "mark").distinct().join(gone, ["doc_id", "mark"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    alive = _keys(docs.join(met, ["doc_id", "mark"]), min_words).join(heads.where("df > 2").select("key", "df"), "key")
    alive = stored(alive)
    few = keys.join(alive.where(F.col("df") <= rare).select("key").distinct(), "key").select("key", holder.alias("head"))
    groups = keys.join(alive.where(F.col("df") > rare).select("key").distinct(), "key")
    groups = groups.groupBy("key", F.pmod(F.xxhash64("doc_id", "key"), F.lit(rare))).agg(F.min(holder).alias("head")).select("key", "head")
    more = alive.join(few.unionByName(groups), "key").where(F.col("doc_id") > F.col("head.doc_id")).select("doc_id", "mark", "head").distinct()
    more = more.join(tried, ["doc_id", "mark", "head"], "left_anti")
    found = first.unionByName(_aligned(docs, more, min_words))
    return found.groupBy("doc_id", "mark").agg(
        F.count(F.lit(1)).alias("n_partners"), F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")
    )


def line_dedup(documents: DataFrame, min_words: int = 5, rare: int = 64) -> DataFrame:
    """All columns of ``documents`` that a document has (doc_id, text, lang, source, n_chars), with the
    repeated blocks deleted from ``text``, and n_lines, n_deleted and n_partners.

    Lines are compared without surrounding white space, ends of CRLF lines included; lines without a word are
    never deleted.  n_chars follows
    a changed text.  Null texts stay null and have no lines; texts without deletions are unchanged, empty and
    very long ones included; a row without an id is left alone; documents of equal id never delete each
    other's lines; an empty table gives an empty result.
    """
    gone = repeated_lines(documents, min_words, rare).withColumnRenamed("doc_id", "g_id").withColumnRenamed("mark", "g_mark")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in documents.columns])
    docs = docs.withColumn("_mark", F.xxhash64(text)).join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("_mark") == F.col("g_mark")), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
    docs = docs.withColumn("text", F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("gone").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.withColumn("n_deleted", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn(
        "n_partners", F.coalesce("n_partners", F.lit(0)).cast("long")
    ).drop("_mark", "g_id", "g_mark", "gone")
