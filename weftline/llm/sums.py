"""Sums of numpy arrays over all rows: one array a task, added up in two small shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tasks of the middle step; the last one reads so many rows.
FAN = 16


def _packed(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def summed(df: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], kind: type = np.float64) -> np.ndarray | None:
    """The sum of ``of(batch)``, arrays of one length, over all Arrow batches of ``df``; None without rows.

    A task sends one array, whatever it has read; the driver receives one.
    """

    def parts(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                new = of(batch)
                total = new if total is None else total + new
        yield from _packed(total)

    def add(batches):
        total = None
        for batch in batches:
            for value in batch.column("sums"):
                new = np.frombuffer(value.as_buffer(), kind)
                total = new if total is None else total + new
        yield from _packed(total)

    out = df.mapInArrow(parts, "sums binary")
    for tasks in (FAN, 1):
        out = out.repartition(tasks).mapInArrow(add, "sums binary")
    row = out.first()
    return np.frombuffer(row["sums"], kind) if row else None
