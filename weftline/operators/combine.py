"""Two-input operators of a map node: lookup joins, joins, cross product and unions.

Inputs are named; columns are referred to as "A.col".  ``match="last"`` keeps at most one build row a key,
``match="all"`` every match.  NULL keys match NULL keys; keys of different types are compared as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import output_column, prefixed
from ..functions.types import spark_type

KINDS = ("inner", "left", "right", "full", "cross", "union")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _named(df: DataFrame, name: str) -> T.StructField:
    """The column of a name, compared without case."""
    found = next((f for f in df.schema.fields if f.name.lower() == name.lower()), None)
    if found is None:
        raise ValueError(f"no column {name!r}")
    return found


def last_by_key(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order_by`` (default: all other columns that have an order); NULL keys are a key."""
    order = order_by or [f.name for f in df.schema.fields if f.name not in keys and _orderable(f.dataType)] or keys
    # an aggregate combines before the shuffle, which a window could not
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in order]))
    return df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(row.alias("r")).select("r.*")


def _same_key(left: DataFrame, right: DataFrame, a: str, b: str, names: tuple[str, str]) -> Column:
    p, q = _named(left, a), _named(right, b)
    x, y = F.col(f"{names[0]}.`{p.name}`"), F.col(f"{names[1]}.`{q.name}`")
    if p.dataType != q.dataType:
        both = isinstance(p.dataType, T.NumericType) and isinstance(q.dataType, T.NumericType)
        if not both:
            x, y = x.cast("string"), y.cast("string")
    return x.eqNullSafe(y)


def lookup_join(
    left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], kind: str = "left",
    match: str = "last", order_by: list[str] | None = None, names: tuple[str, str] = ("A", "B"),
) -> DataFrame:
    """Both inputs side by side, under their names.  An unknown kind is a left join.

    With match="last" inner and left joins keep the last right row of a key, a right join the last left row,
    a full join both.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("a join needs as many left keys as right keys, and at least one")
    kind = kind if kind in KINDS else "left"
    left_keys, right_keys = [_named(left, k).name for k in left_keys], [_named(right, k).name for k in right_keys]
    if match == "last":
        if kind in ("inner", "left", "full"):
            right = last_by_key(right, right_keys, order_by)
        if kind in ("right", "full"):
            left = last_by_key(left, left_keys, order_by if kind == "right" else None)
    on = reduce(lambda a, b: a & b, [_same_key(left, right, a, b, names) for a, b in zip(left_keys, right_keys)])
    return left.alias(names[0]).join(right.alias(names[1]), on, kind)


def cross_join(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("A", "B")) -> DataFrame:
    return left.alias(names[0]).crossJoin(right.alias(names[1]))


def project(joined: DataFrame, columns: list[dict], prefix: bool = False) -> DataFrame:
    return joined.select(*[output_column(prefixed(c) if prefix else c) for c in columns])


def add_all_columns(df: DataFrame, name: str, columns: list[dict] = ()) -> list[dict]:
    """``columns`` and, once each, those of the input ``name`` that no output column has the name of, without case."""
    out, taken = list(columns), {c["name"].lower() for c in columns}
    for c in df.columns:
        if c.lower() not in taken:
            taken.add(c.lower())
            out.append({"name": c, "ref": f"{name}.`{c}`"})
    return out


def union_by_lineage(left: DataFrame, right: DataFrame, columns: list[dict], names: tuple[str, str] = ("A", "B")) -> DataFrame:
    """All left rows, then all right rows; a column that refers to one input is NULL on the other's rows.

    An unqualified reference is taken from both; columns that are not direct are NULL.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        out = []
        for c in columns:
            ref = c.get("ref", "") if c.get("kind", "direct") == "direct" else ""
            owner, _, column = ref.rpartition(".")
            if ref and owner in ("", name) and column in df.columns:
                out.append(output_column(c | {"ref": column}))
            else:
                out.append(F.lit(None).cast(spark_type(c.get("type")) if c.get("type") else "void").alias(c["name"]))
        return df.select(*out)

    return side(left, names[0]).unionByName(side(right, names[1]))


def union_shared(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)
