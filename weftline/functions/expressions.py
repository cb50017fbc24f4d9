"""Output columns of a map node.

A spec is a dict with ``name``, ``kind`` and optionally ``type``:
direct (ref "A.col" or "col"), concat (sep, args), concat_all (args), upper (args), add (args), expr (sql),
udf (function, args), null, and any other kind, which gives a typed NULL.
Arguments are references or {"lit": value}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import coerce, spark_type


def argument(arg) -> Column:
    return F.lit(arg["lit"]) if isinstance(arg, dict) else F.col(arg)


def concat(separator: str, *values: Column) -> Column:
    """Join the printed values; a NULL is an empty string and keeps its separators."""
    return F.array_join(F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values]), separator)


def concat_all(*values: Column) -> Column:
    return concat("", *values)


def output_column(spec: dict) -> Column:
    kind, name = spec.get("kind", "direct"), spec["name"]
    args = [argument(a) for a in spec.get("args", [])]
    if kind == "direct":
        out = F.col(spec["ref"])
    elif kind == "concat":
        out = concat(spec.get("sep", ""), *args)
    elif kind == "concat_all":
        out = concat_all(*args)
    elif kind == "upper":
        out = F.upper(args[0])
    elif kind == "add":
        out = reduce(lambda a, b: a + b, args)
    elif kind == "expr":
        out = F.expr(spec["sql"])
    elif kind == "udf":
        out = spec["function"](*args)  # an Arrow (pandas) UDF given by the user
    else:
        return F.lit(None).cast(spark_type(spec.get("type"))).alias(name)
    return coerce(out, spec.get("type")).alias(name)


def prefixed(spec: dict) -> dict:
    """The join-safe name of a direct column: A.id becomes a_id."""
    if spec.get("kind", "direct") == "direct" and "." in spec["ref"]:
        side, column = spec["ref"].split(".", 1)
        return spec | {"name": f"{side.lower()}_{column}"}
    return spec
