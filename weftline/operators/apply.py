"""Write modes as pure functions: (target, source) -> new state of the target.

NULL keys never match here, unlike in map joins.  Columns that the source lacks keep the target's value on
update and merge and are NULL on insert.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .combine import last_by_key

MODES = ("insert", "update", "merge", "delete", "truncate")


def validate(mode: str, target: DataFrame, columns: list[str], keys: list[str]) -> None:
    mode = mode.lower()
    if mode not in MODES:
        raise ValueError(f"unknown write mode {mode!r}")
    if mode in ("insert", "update", "merge") and not columns:
        raise ValueError(f"{mode} needs columns")
    if mode in ("update", "delete", "merge") and not keys:
        raise ValueError(f"{mode} needs keys")
    missing = [c for c in [*columns, *keys] if c not in target.columns]
    if missing:
        raise ValueError(f"not in the target: {missing}")


def _on(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])


def _cast(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    return source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in columns])


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def without_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a NULL in some key."""
    return df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def insert(target: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    return target.unionByName(_cast(target, source, columns), allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Set the non-key columns of matching rows; of several source rows of a key the last wins."""
    new = last_by_key(with_keys(source, keys), keys, order_by)
    new = _cast(target, new, list(dict.fromkeys([*keys, *columns]))).withColumn("_hit", F.lit(True))
    return target.alias("t").join(new.alias("s"), _on(keys), "left").select(*[
        (F.when(F.col("_hit"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in columns and c not in keys else F.col(f"t.{c}")).alias(c)
        for c in target.columns
    ])


def merge(
    target: DataFrame, source: DataFrame, keys: list[str], columns: list[str],
    order_by: list[str] | None = None, on_duplicate: str = "last",
) -> DataFrame:
    """Update matching rows and insert the others; source rows with a NULL key are inserted as they are.

    ``on_duplicate``: "last" keeps the last source row of a key, "error" raises when the plan runs.
    With no column but keys, rows are inserted if absent.
    """
    every = list(dict.fromkeys([*keys, *columns]))
    solid = with_keys(source, keys)
    if on_duplicate == "error":
        counted = solid.groupBy(*keys).agg(F.first(F.struct(*source.columns)).alias("r"), F.count(F.lit(1)).alias("n"))
        checked = F.when(F.col("n") > 1, F.raise_error(F.lit("merge: several source rows of one key")).cast("boolean")).otherwise(True)
        new = counted.where(checked).select("r.*")
    else:
        new = last_by_key(solid, keys, order_by)
    new = _cast(target, new, every).withColumn("_s", F.lit(True))
    old = target.withColumn("_t", F.lit(True))
    state = old.alias("t").join(new.alias("s"), _on(keys), "full").select(*[
        (F.when(F.col("_t").isNull() | (F.col("_s") & F.lit(c not in keys)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in every else F.col(f"t.{c}")).alias(c)
        for c in target.columns
    ])
    return insert(state, without_keys(source, keys), every)


def delete(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    gone = _cast(target, source, keys).distinct()
    return target.alias("t").join(gone.alias("s"), _on(keys), "left_anti")


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def apply(target: DataFrame, source: DataFrame, mode: str, keys: list[str] | None = None, columns: list[str] | None = None, **options) -> DataFrame:
    """The new state of ``target``; see the modes.  Take default keys of a table from sources.sql.default_keys."""
    keys, mode = list(keys or []), mode.lower()
    columns = list(columns if columns is not None else [c for c in source.columns if c in target.columns])
    validate(mode, target, columns, keys)
    if mode == "insert":
        return insert(target, source, columns)
    if mode == "update":
        return update(target, source, keys, columns, **options)
    if mode == "merge":
        return merge(target, source, keys, columns, **options)
    return delete(target, source, keys) if mode == "delete" else truncate(target)
