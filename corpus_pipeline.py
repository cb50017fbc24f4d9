"""The corpus pipeline: toxic documents go, repeated lines, near-duplicates and repeated strings go, the rest is packed.

Every stage takes the columns doc_id, text, lang, source and n_chars (others, clashing names included, are
ignored), and all but the last return them.  In any stage null and empty texts neither repeat anything nor are
toxic and stay; rows without an id are judged by their text alone and stay unless it is toxic; an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpoint_folder, table
from weftline.llm.line_dedup import line_dedup
from weftline.llm.near_dedup import drop_near_duplicates
from weftline.llm.packing import best_fit, piece_texts
from weftline.llm.suffix_dedup import suffix_dedup
from weftline.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from the labels of these documents, but for those of the held-out fold.  Repeated rows get equal
    scores; without labels nothing is rejected unless most documents are toxic by the prior alone.
    """
    return drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines are deleted from later documents; one of which no word is left goes.

    Repeated rows of one id never delete each other's lines.
    """
    cut = line_dedup(docs.select(*COLUMNS))
    return cut.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, stays of each group (five words, similarity 0.8).

    Of repeated rows one stays; rows that share an id but not a text are documents of their own, and of such a
    group the one of the smallest hash stays.
    """
    return drop_near_duplicates(docs.select(*COLUMNS), shingle_words=5, percent=80)


def remove_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes found in an earlier document are cut; a document of which nothing is left goes."""
    return suffix_dedup(docs.select(*COLUMNS), length=50).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, start_token, n_tokens, bin_id, text): the pieces of all documents, with their words, and their bins.

    A document without words has one empty piece and no bin.
    """
    return piece_texts(docs, best_fit(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("minhash", remove_near_duplicates),
    ("suffix_dedup", remove_strings),
    ("packing", pack_documents),
]

#: SQL cannot express the classifier, the alignment or best-fit packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """Apply all stages to ``documents``; each result but the last is written as Parquet and read again.

    With a ``name`` the stages' tables are kept under it in the checkpoint folder, and a run that was lost goes on
    behind its last whole table when it is started again by that name.  Tables of other rows or of other code are
    not taken up: they are written again.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark, shared=bool(name))}/pipeline-{name or uuid.uuid4().hex}"
    mark = fingerprint(spark, sf_dir) if name else ""
    for number, (stage_name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{stage_name}"
        if number + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        if not (name and written(spark, path, mark)):
            if name:  # while the table is being written, nothing says that it is whole
                spark.createDataFrame([], "mark string").write.mode("overwrite").parquet(f"{path}-whole")
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if name:
                spark.createDataFrame([(mark,)], "mark string").coalesce(1).write.mode("overwrite").parquet(f"{path}-whole")
        docs = spark.read.parquet(path)
    return docs


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the rows that the stages read and of the code that they run."""
    rows = []
    for name, columns in (("documents", COLUMNS), ("labels", ["doc_id", "toxic"])):
        hashed = table(spark, sf_dir, name).select(F.xxhash64(*columns).alias("h"))
        rows.append(tuple(hashed.agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()))
    code = [inspect.getsource(sys.modules[m]) for m in sorted(sys.modules) if m.startswith("weftline.llm.")]
    return hashlib.sha256(repr((rows, code, inspect.getsource(sys.modules[__name__]))).encode()).hexdigest()


def written(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the table at the path was written to its end, by this code and from these rows: another one beside it says so."""
    try:
        return [r["mark"] for r in spark.read.schema("mark string").parquet(f"{path}-whole").collect()] == [mark]  # one row
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
