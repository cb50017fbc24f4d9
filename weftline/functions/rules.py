"""The rule language: groups of conditions compiled to one boolean column.

A rule is {"all": [...], "any": [...]} of conditions {"field", "op", "value"}.  A row passes when every rule
holds; a rule holds when all of ``all`` and, if there are any, at least one of ``any`` hold.

Conditions are predicates of a filter: where NULL would count as a value they say so, else NULL stands for false,
and no function hides a column from the scan.  What a scan cannot evaluate gets a plain bound beside it that every
passing row meets.  ``strict`` makes a value of a condition.
"""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import usable_pattern


#: Integers up to this size are exact as doubles.
_EXACT = 1 << 53


def field(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """A dotted path through structs, maps, VARIANT values and JSON text; a missing field is NULL."""
    names = path.split(".")
    found = next((f for f in schema.fields if f.name.lower() == names[0].lower()), None)
    if found is None:
        return F.lit(None).cast("string"), T.StringType()
    column, kind = F.col(f"`{found.name}`"), found.dataType
    for i, name in enumerate(names[1:], 1):
        if isinstance(kind, T.StructType):
            inner = next((f for f in kind.fields if f.name.lower() == name.lower()), None)
            if inner is None:
                return F.lit(None).cast("string"), T.StringType()
            column, kind = column.getField(inner.name), inner.dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(name)), kind.valueType
        elif isinstance(kind, (T.StringType, T.VariantType)):
            rest = "$" + "".join(f"['{n}']" for n in names[i:])
            if isinstance(kind, T.StringType):
                return F.get_json_object(column, rest), T.StringType()
            return F.try_variant_get(column, rest, "string"), T.StringType()
        else:
            return F.lit(None).cast("string"), T.StringType()
    if isinstance(kind, T.VariantType):  # a value of its own: its text
        return F.try_variant_get(column, "$", "string"), T.StringType()
    return column, kind


def source(schema: T.StructType, path: str) -> Column | None:
    """The stored column that a path begins in, or the nested one if structs alone lead to it; None if there is none.

    Where it is NULL the field is NULL too, and unlike the field it can be tested in a scan.
    """
    names = path.split(".")
    found = next((f for f in schema.fields if f.name.lower() == names[0].lower()), None)
    if found is None:
        return None
    column, kind = F.col(f"`{found.name}`"), found.dataType
    for name in names[1:]:
        if not isinstance(kind, T.StructType):
            break
        inner = next((f for f in kind.fields if f.name.lower() == name.lower()), None)
        if inner is None:
            return None
        column, kind = column.getField(inner.name), inner.dataType
    return column


def _equal(column: Column, kind: T.DataType, value) -> Column:
    if value is None:
        return column.isNull()
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number and isinstance(kind, T.NumericType):
        if isinstance(kind, T.IntegralType) and isinstance(value, float) and value.is_integer() and abs(value) < _EXACT:
            value = int(value)
        return column.eqNullSafe(F.lit(value))
    if isinstance(value, bool):
        value = str(value).lower()
    elif number and isinstance(value, float) and value.is_integer():
        value = int(value)
    return column.cast("string").eqNullSafe(F.lit(str(value)))


def _bound(kind: T.DataType, value: float, above: bool) -> Decimal | None:
    """A decimal of the column's scale at or beyond which no value of the column compares as a double like ``value``."""
    if abs(value) >= 10.0 ** (kind.precision - kind.scale):
        return None  # no value of the column is as large
    step = Decimal(1).scaleb(-kind.scale)
    slack = step + Decimal(abs(value)) * Decimal("1e-15")
    edge = (Decimal(value) - slack if above else Decimal(value) + slack).quantize(step, ROUND_FLOOR if above else ROUND_CEILING)
    return edge if abs(edge) < Decimal(10) ** (kind.precision - kind.scale) else None


def _compare(column: Column, kind: T.DataType, op: str, value: float, whole: Column | None) -> Column:
    """``gt`` or ``lt`` on the double that a field stands for; what is missing or no number counts as 0."""
    above = op == "gt"
    holds = (lambda x: x > value) if above else (lambda x: x < value)
    against = (lambda c, x: c > x) if above else (lambda c, x: c < x)
    missing = holds(0.0)
    with localcontext(prec=60):
        if isinstance(kind, T.IntegralType) and abs(value) < _EXACT:
            # an integer is above a number if it is above the number's floor, and below it if below its ceiling
            plain = against(column, F.lit(math.floor(value) if above else math.ceil(value)))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            plain = against(column if isinstance(kind, T.DoubleType) else column.cast("double"), F.lit(value))
        elif isinstance(kind, T.DecimalType) and math.isfinite(value):
            plain = against(column.cast("double"), F.lit(value))
            edge = _bound(kind, value, above)
            if edge is not None:
                limit = F.lit(edge).cast(kind)
                plain = ((column >= limit) if above else (column <= limit)) & plain
        elif isinstance(kind, (T.NumericType, T.StringType)):
            number = column.try_cast("double")
            if missing:  # text that is no number passes like a missing field
                return against(F.coalesce(number, F.lit(0.0)), F.lit(value))
            plain = against(number, F.lit(value))
        else:
            return F.lit(missing)
    if missing:
        return plain | column.isNull()
    return whole.isNotNull() & plain if whole is not None else plain


def _literal(value) -> float:
    try:
        return 0.0 if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return 0.0


def condition(schema: T.StructType, spec: dict) -> Column:
    """One condition as a predicate; NULL stands for false."""
    path = spec.get("field", "")
    column, kind = field(schema, path)
    whole = source(schema, path)
    op, value = spec.get("op"), spec.get("value")
    text, false = column if isinstance(kind, T.StringType) else column.cast("string"), F.lit(False)
    if op == "eq":
        return _equal(column, kind, value)
    if op == "neq":
        return ~_equal(column, kind, value)
    if op == "contains":
        return text.contains(str(value))
    if op == "startsWith":
        return text.startswith(str(value))
    if op == "endsWith":
        return text.endswith(str(value))
    if op in ("gt", "lt"):
        return _compare(column, kind, op, _literal(value), whole)
    if op == "regex":
        pattern = usable_pattern(str(value))
        return false if pattern is None else text.rlike(pattern)
    if op == "exists":
        return column.isNotNull()
    if op == "notExists":
        return column.isNull()
    if op in ("in", "notIn"):
        listed = value if isinstance(value, (list, tuple)) else []
        held = reduce(lambda a, b: a | b, [_equal(column, kind, v) for v in listed], false)
        return held if op == "in" else ~held
    return false


def strict(predicate: Column) -> Column:
    """A predicate as a value: false where it is NULL."""
    return F.coalesce(predicate, F.lit(False))


def rule(schema: T.StructType, spec: dict) -> Column:
    held = reduce(lambda a, b: a & b, [condition(schema, c) for c in spec.get("all") or []], F.lit(True))
    some = [condition(schema, c) for c in spec.get("any") or []]
    return held & reduce(lambda a, b: a | b, some) if some else held


def rules_filter(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows for which every rule holds; no rules keep all.

    The filter is one conjunction of plain predicates, which scans of Parquet and JDBC evaluate as far as they can.
    """
    if not rules:
        return df
    return df.where(reduce(lambda a, b: a & b, [rule(df.schema, r) for r in rules]))
