"""Event feeds: poll a growing table past a watermark, filter by rules, run linked jobs, keep an audit table.

A feed is a Structured Streaming query: its source's offsets are the watermark and its checkpoint persists them.
Each micro-batch is one poll.  The source is a folder of files, or any table that Spark reads and that grows past a
watermark column (streaming.watermarks).  ``poll_table`` makes single polls without a streaming query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.rules import rules_filter
from ..plans.spec import build
from ..sources.cursor import Cursor
from .watermarks import watermark_stream

Job = Callable[[DataFrame, int], None]
AUDIT = "poll long, status string, events long, matched long, error string, event_sample string, watermark string, at timestamp"


def watch_folder(spark: SparkSession, path: str, schema: T.StructType, files_per_poll: int = 1) -> DataFrame:
    """New Parquet files of a folder, at most ``files_per_poll`` a poll."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_poll).parquet(path)


def after(stream: DataFrame, column: str, start) -> DataFrame:
    """Start from now: only rows past a watermark taken at activation."""
    return stream.where(F.col(column) > F.lit(start))


def _audit(spark: SparkSession, path: str, number: int, status: str, events=0, matched=0, error=None, sample=None, mark=None, idle=False) -> None:
    """Write a poll's row.  A poll with events has one row, which a repeated run replaces; each idle poll has a row of its own."""
    now = dt.datetime.now(dt.timezone.utc)
    place = f"poll={number:012d}" + (f"-idle-{now:%Y%m%d%H%M%S%f}" if idle else "")
    row = spark.createDataFrame([(number, status, events, matched, error, sample, mark, now)], AUDIT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/{place}")


def _fire(batch: DataFrame, number: int, rules: list[dict], jobs: list[tuple[int, Job]], audit_path: str, mark: str | None = None) -> int:
    """One poll: count and filter its events, run the jobs if any match, keep the audit row up to date.

    The number of events is returned: it is that of the rows handed on, not of a second read.
    """
    spark, events, matched, sample = batch.sparkSession, 0, 0, None
    _audit(spark, audit_path, number, "running")
    batch = batch.persist()
    try:
        events = batch.count()
        hit = rules_filter(batch, rules)
        matched = hit.count()
        if matched:
            sample = hit.select(F.to_json(F.struct("*"))).first()[0]
            for _, job in sorted(jobs, key=lambda j: j[0]):
                job(hit, number)
        _audit(spark, audit_path, number, "completed" if matched else "no_events", events, matched, None, sample, mark)
    except Exception as error:
        _audit(spark, audit_path, number, "failed", events, matched, str(error)[:500], sample)
        raise
    finally:
        batch.unpersist()
    return events


def run_feed(
    stream: DataFrame, rules: list[dict], jobs: list[tuple[int, Job]],
    audit_path: str, checkpoint: str, available_now: bool = True, interval: str = "60 seconds",
):
    """Start the feed.  ``jobs`` are (priority, function of the matching events and the poll number).

    The events of a poll are counted and sampled over the cached batch; jobs run by priority when at least one
    event matches.  A failed poll is audited with the counts it came to, and stops the feed.  The audit row of a
    poll has a folder of its own, so a poll that is run again after a failure replaces its row.
    """
    poll = lambda batch, number: _fire(batch, number, rules, jobs, audit_path) and None
    writer = stream.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime=interval).start()


def spec_job(spec: dict, node: str, sink: Callable[[DataFrame, str, int], None], targets: Callable[[dict], DataFrame] | None = None) -> Job:
    """A job specification as a job of a feed: the events are the rows of its node ``node``.

    Every sink's frame goes to ``sink``, with the sink's id and the poll number.
    """

    def job(events: DataFrame, number: int) -> None:
        built = build(events.sparkSession, spec, targets, given={node: events})
        for name in built.sinks:
            sink(built.result(name), name, number)

    return job


def poll_table(
    read: Callable[[], DataFrame], column: str, kind: str, rules: list[dict], jobs: list[tuple[int, Job]], state_path: str, batch: int = 100,
    start: str | None = None, key: str | None = None, key_kind: str = "int", columns: list[str] | None = None, where: str | None = None,
    bound: Callable[[str | None, int], str | None] | None = None,
) -> int:
    """One poll of a growing table: its next rows past the watermark, filtered, handed to the jobs and audited.

    The number of rows polled is returned.  First the poll's upper watermark is found, that of the last of the next
    ``batch`` rows; then everything up to it is read, ties of it included.  Rows that arrive meanwhile lie beyond it
    and come with the next poll.  The audit row of a poll that has finished keeps its watermark: a poll that failed,
    or was lost, is made again with the same number.  ``start`` is the first watermark (see initial_watermark for
    "from now").  ``key`` breaks the ties of a column whose values repeat.  ``read`` gives the table as it is now;
    ``bound(mark, batch)`` may find the upper watermark in another way (see Cursor.bound_jdbc).
    """
    cursor, table = Cursor(column, kind, key, key_kind), read()
    spark, audit = table.sparkSession, f"{state_path}/audit"
    done = None
    if _exists(spark, audit):
        done = read_audit(spark, audit).where("watermark is not null").orderBy(F.desc("poll")).first()
    number, mark = (done["poll"] + 1, done["watermark"]) if done else (0, start)
    upto = bound(mark, batch) if bound else cursor.bound(table, mark, batch, where)
    if upto is None:
        _audit(spark, audit, number, "no_events", idle=True)
        return 0
    return _fire(cursor.slice(read(), mark, upto, columns, where), number, rules, jobs, audit, upto)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema(AUDIT).parquet(f"{path}/poll=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def run_table_feed(
    spark: SparkSession, checkpoint: str, interval: str = "60 seconds", *, read: Callable[[], DataFrame], column: str, kind: str, rules: list[dict],
    jobs: list[tuple[int, Job]], state_path: str, batch: int = 100, start: str | None = None, key: str | None = None, key_kind: str = "int",
    columns: list[str] | None = None, where: str | None = None, bound: Callable[[str | None, int], str | None] | None = None, available_now: bool = False,
):
    """A table polled as a stream (arguments as in poll_table): the offsets in the checkpoint are its watermarks.

    Every trigger asks for the watermark of the next ``batch`` rows; if there is one, a micro-batch reads the slice
    up to it.  A batch that a killed run left is made again over the same slice, with the same number, before any
    other.  Rows must not be inserted below a watermark that was passed; hold back what is in flight with ``where``.
    With ``available_now`` the query polls until nothing is new and ends; else it runs until it is stopped.
    """
    cursor, audit = Cursor(column, kind, key, key_kind), f"{state_path}/audit"
    polls = {"next": 0}
    if _exists(spark, audit):
        polls["next"] = read_audit(spark, audit).where("watermark is not null").agg(F.coalesce(F.max("poll") + 1, F.lit(0))).first()[0]

    def find(mark: str | None) -> str | None:
        upto = bound(mark, batch) if bound else cursor.bound(read(), mark, batch, where)
        if upto is None:
            _audit(spark, audit, polls["next"], "no_events", idle=True)
        return upto

    def poll(marks: DataFrame, number: int) -> None:
        after, upto = marks.first()  # the two watermarks of this batch
        _fire(cursor.slice(read(), after or None, upto, columns, where), number, rules, jobs, audit, upto)
        polls["next"] = number + 1

    stream, close = watermark_stream(spark, find, start)
    writer = stream.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint)
    query = writer.trigger(processingTime="0 seconds" if available_now else interval).start()
    if available_now:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
            close()
    else:
        spark.streams.addListener(_Ended(str(query.runId), close))
    return query


class _Ended(StreamingQueryListener):
    """Calls ``close`` when the query has ended."""

    def __init__(self, run: str, close: Callable[[], None]):
        self.run, self.close = run, close

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.close()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(f"{path}/poll=*")


def recent(audit: DataFrame, n: int = 20) -> DataFrame:
    """The latest polls, newest first."""
    return audit.orderBy(F.desc("poll"), F.desc("at")).limit(n)
