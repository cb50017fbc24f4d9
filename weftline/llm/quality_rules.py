"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets base counts and rule failures.  Failures are aggregated by host (the ``source`` column);
a host's failure rate is shrunk toward all hosts by a beta prior fitted to the hosts (method of moments),
and the host verdict is joined back: a document of a distrusted host must pass the soft rules as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_PATTERN, checkpointed

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A host whose shrunk failure rate is above this is distrusted.
DISTRUST = 0.5


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, source and the base counts of whole texts; a null text has no words and no lines."""
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    docs = docs.withColumn("words", F.array_remove(F.split("text", SEPARATOR_PATTERN), ""))
    docs = docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.select(
        "doc_id", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).drop("words")
    # only texts with a window found twice go on to find the positions of all such windows
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ranked = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn("ranked", F.when(again, ranked)).drop("windows")

    def repeated(e: Column, k: Column) -> Column:
        near = [F.get("ranked", k + d)["h"] == e["h"] for d in (-1, 1)]
        return F.when(F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False)), e["i"])

    docs = docs.withColumn("at", F.array_sort(F.array_compact(F.transform("ranked", repeated)))).drop("ranked")
    covered = F.transform("at", lambda p, k: F.coalesce(F.least(F.get("at", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return docs.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("at")


def quality(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    Null and empty texts have zero counts and fail; rows without a source form one host; repeated rows get
    equal results; whole texts are counted; other columns are ignored; an empty table gives an empty result.
    Window equality is by 64-bit hashes.
    """
    docs = base_counts(documents)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (
        (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    )
    docs = docs.withColumn("base_failed", failed).withColumn("soft_failed", failed | soft)
    docs = checkpointed(docs.withColumn("host", F.coalesce("source", F.lit(""))))
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("soft_failed").cast("long")).alias("f"))
    alpha, beta = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("f") + alpha) / (F.col("n") + alpha + beta) > DISTRUST).alias("distrusted"))
    # AQE broadcasts the verdicts when they turn out small, and splits a hot host otherwise
    return docs.join(verdicts, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~(F.col("distrusted") & F.col("soft_failed"))).alias("kept"),
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta distribution of failure rates over hosts, by moments (one row to the driver)."""
    rate = F.col("f") / F.col("n")
    row = hosts.agg(
        F.sum("f").alias("f"), F.sum("n").alias("n"), F.sum(F.col("n") * rate * rate).alias("square")
    ).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = (row["f"] + 0.5) / (row["n"] + 1)
    variance = max(row["square"] / row["n"] - (row["f"] / row["n"]) ** 2, 1e-9)
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 8) AS t(k) GROUP BY doc_id),
b AS (SELECT w.doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
s AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft_failed FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(soft_failed::INT)::DOUBLE AS f FROM s GROUP BY host),
m AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS mean,
        greatest(sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 1e-9) AS variance FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / variance - 1, 1.0), 1e6) AS strength FROM m),
v AS (SELECT host, (f + mean * strength) / (n + strength) > 0.5 AS distrusted FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (distrusted AND soft_failed) AS kept
FROM s JOIN v USING (host)
"""
