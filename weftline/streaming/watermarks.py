"""A stream source whose offsets are the watermarks of a growing table.

A row of the stream is a pair of watermarks; the rows between them are read by Spark in the micro-batch, from
whatever source the table lies in, with filters pushed down and over as many tasks as that source has.  Spark's
checkpoint keeps the offsets, so that it alone knows what has been read.

Spark runs a Python source in a process of its own beside the driver, which has no session.  It asks the driver for
the next watermark over a local connection, one question a trigger.
"""

from __future__ import annotations

import secrets
import threading
import uuid
from collections.abc import Callable
from multiprocessing.connection import Client, Listener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "after string, upto string"
Find = Callable[[str | None], str | None]


class Between(InputPartition):
    def __init__(self, after: str, upto: str):
        self.after, self.upto = after, upto


class WatermarkReader(DataSourceStreamReader):
    def __init__(self, address: tuple[str, int], secret: bytes, start: str | None):
        self.address, self.secret, self.at = address, secret, start or ""

    def initialOffset(self) -> dict:
        return {"watermark": self.at}

    def latestOffset(self) -> dict:
        """The next watermark past the last planned one; the same one if nothing is new."""
        with Client(self.address, authkey=self.secret) as link:
            link.send(self.at)
            kind, answer = link.recv()
        if kind == "error":
            raise RuntimeError(answer)
        return {"watermark": answer if answer is not None else self.at}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        """Spark also calls this when it takes a query up again, with the last offset as both ends."""
        self.at = end["watermark"]
        return [] if start == end else [Between(start["watermark"], end["watermark"])]

    def read(self, partition: Between):
        yield partition.after, partition.upto


def serve(find: Find) -> tuple[tuple[str, int], bytes, Callable[[], None]]:
    """Answer the reader's questions from a thread of the driver; (address, secret, how to end it)."""
    secret = secrets.token_bytes(32)
    listener = Listener(("127.0.0.1", 0), authkey=secret)
    open_ = threading.Event()
    open_.set()

    def answer() -> None:
        while open_.is_set():
            try:
                with listener.accept() as link:
                    mark = link.recv()
                    try:
                        link.send(("mark", find(mark or None)))
                    except Exception as error:  # noqa: BLE001 - it fails the query, in the reader
                        link.send(("error", str(error)))
            except Exception:  # noqa: BLE001 - a caller that is gone, or does not know the secret
                continue

    threading.Thread(target=answer, daemon=True, name="watermarks").start()

    def close() -> None:
        open_.clear()
        listener.close()

    return listener.address, secret, close


def watermark_stream(spark: SparkSession, find: Find, start: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """(a stream of (after, upto), how to end its source); ``find(mark)`` gives the next watermark past one, or None."""
    address, secret, close = serve(find)
    named = f"watermarks_{uuid.uuid4().hex[:12]}"

    class Watermarks(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> WatermarkReader:
            return WatermarkReader(address, secret, start)

    spark.dataSource.register(Watermarks)
    return spark.readStream.format(named).load(), close
