"""Lookup sides that are kept ready: one row a key, bucketed and sorted by it.

A poll that looks its events up in such a table shuffles the events only.  Keys are kept as text beside the row, NULL
included, because a null-safe comparison of the columns themselves could not use the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .combine import last_by_key, lookup_join

#: What stands for NULL among the keys' texts; no text of a key begins so.
_NULL, _TEXT = "n", "t"


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit(_TEXT), column.cast("string")), F.lit(_NULL))


class StoredDimension:
    """A table of the catalog that holds the last row of each key of a lookup's build side.

    ``buckets`` should give buckets of some hundred MB: it fixes how many tasks a lookup has.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], buckets: int = 200):
        self.spark, self.name, self.keys, self.buckets = spark, name, list(keys), buckets
        self.places = [f"_key{i}" for i in range(len(keys))]

    def save(self, df: DataFrame, order_by: list[str] | None = None, path: str | None = None) -> None:
        """Replace the table by the last rows of ``df`` (see last_by_key), under ``path`` if given."""
        rows = last_by_key(df, self.keys, order_by)
        rows = rows.withColumns({place: _key(F.col(f"`{k}`")) for place, k in zip(self.places, self.keys)})
        writer = rows.repartition(self.buckets, *self.places).write.mode("overwrite").bucketBy(self.buckets, *self.places).sortBy(*self.places)
        (writer.option("path", path) if path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, events: DataFrame, keys: list[str], kind: str = "left", names: tuple[str, str] = ("A", "B")) -> DataFrame:
        """``lookup_join(events, dimension, …, match="last")`` of kind inner or left, without a shuffle of the dimension.

        Keys of numeric types that only a widening cast makes alike are compared as numbers by ``lookup_join`` itself.
        """
        if kind not in ("inner", "left"):
            raise ValueError("a stored dimension is the right side of an inner or left lookup")
        if len(keys) != len(self.keys):
            raise ValueError("a lookup needs as many keys as the dimension")
        stored = self.read()
        types = [(events.schema[a].dataType, stored.schema[b].dataType) for a, b in zip(keys, self.keys)]
        whole = lambda t: isinstance(t, T.IntegralType)
        if any(a != b and isinstance(a, T.NumericType) and isinstance(b, T.NumericType) and not (whole(a) and whole(b)) for a, b in types):
            return lookup_join(events, stored.drop(*self.places), keys, self.keys, kind, "all", names=names)
        left = events.alias(names[0])
        on = None
        for key, place in zip(keys, self.places):
            same = _key(F.col(f"{names[0]}.`{key}`")) == F.col(f"{names[1]}.{place}")
            on = same if on is None else on & same
        return left.join(stored.alias(names[1]), on, kind)
