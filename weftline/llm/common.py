"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a maximal run of anything but these separators.
SEPARATOR_PATTERN = r"[\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"

#: Spark's own setting to delete the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The most ids that are ever broadcast (8 bytes each, so 8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def checkpoint_folder(spark: SparkSession, shared: bool = False) -> str:
    """The shared folder of ``spark.checkpoint.dir``: its own part for this session, or (``shared``) as it is named.

    Where it is unset, a temporary one in local mode only.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if shared and named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Where each table of ``stored`` lies, and how many writes of a session are under way with what the user had set.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITING: dict[SparkSession, tuple[int, str | None]] = {}
_LOCK = threading.Lock()


@contextmanager
def _cleaned_shuffles(spark: SparkSession):
    """Shuffle files go at the end of each write; the user's own setting is back after the last of several at once."""
    with _LOCK:
        depth, own = _WRITING.get(spark) or (0, spark.conf.get(SHUFFLE_CLEANUP, None))
        _WRITING[spark] = depth + 1, own
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            depth, own = _WRITING.pop(spark)
            if depth > 1:
                _WRITING[spark] = depth - 1, own
            elif own is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, own)


def _at(spark: SparkSession, folder: str):
    """File system and path of a folder, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the checkpoint folder: it cuts the lineage, and a lost executor loses none of it.

    Spark deletes the shuffle files of the write as soon as the table stands.  The table lasts until ``discard``,
    at most until the driver ends: what a driver that crashes leaves lies in ``tables`` of its own part of the folder.
    """
    spark = df.sparkSession
    tables = f"{checkpoint_folder(spark)}/tables"
    path = f"{tables}/{uuid.uuid4().hex}"
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    files, folder = _at(spark, tables)
    files.deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` from which nothing is read any more; other frames are left alone."""
    for table in tables:
        place = _PLACES.pop(table, None)
        if place:
            files, path = _at(table.sparkSession, place)
            files.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text):
    """Words of a text column, in order; null for a null text."""
    return F.array_remove(F.split(text, SEPARATOR_PATTERN), "")


def only_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in the one-column ``ids`` (distinct, already computed).

    The ids are broadcast when they are counted to be few, else both sides are shuffled.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")
