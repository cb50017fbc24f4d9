"""Type names, schema conformity and column matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared output type names and the Spark types they stand for.
OUTPUT_TYPES = {
    "int": "bigint", "int16": "bigint", "int32": "bigint", "int64": "bigint", "float32": "double", "float64": "double",
    "float": "double", "decimal": "decimal(38,10)", "string": "string", "bool": "boolean", "date": "date",
    "timestamp": "timestamp", "time": "timestamp", "bytes": "binary", "json": "string",
}


def spark_type(name: str | None) -> str:
    """Spark type of a declared type name; Spark's own names pass; unknown names are text."""
    if not name:
        return "string"
    low = name.strip().lower()
    if low in OUTPUT_TYPES:
        return OUTPUT_TYPES[low]
    try:
        return T._parse_datatype_string(low).simpleString()
    except Exception:  # noqa: BLE001 - any unparsable name is text
        return "string"


def coerce(column: Column, name: str | None, source: T.DataType | None = None) -> Column:
    """Cast to a declared type; text that is no number becomes NULL instead of an error."""
    if name is None:
        return column
    kind = spark_type(name)
    return column.try_cast(kind) if source is None or isinstance(source, T.StringType) else column.cast(kind)


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get a number: id, id2, id3 (compared without case)."""
    taken = {n.lower() for n in names}
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n.lower()] = seen.get(n.lower(), 0) + 1
        new = n
        while k > 1 and (new := f"{n}{k}").lower() in taken:
            k += 1
        taken.add(new.lower())
        out.append(new)
    return out


def dedupe_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def auto_match(inputs: dict[str, DataFrame], target: T.StructType) -> list[dict]:
    """Column specs that bind each target column to the only input column of its name, without case.

    Names that no input or several inputs have stay unmapped (typed NULL).
    """
    out = []
    for field in target.fields:
        found = [f"{a}.{c}" for a, df in inputs.items() for c in df.columns if c.lower() == field.name.lower()]
        spec = {"name": field.name, "type": field.dataType.simpleString()}
        out.append(spec | ({"kind": "direct", "ref": found[0]} if len(found) == 1 else {"kind": "null"}))
    return out


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order and types; missing ones are NULL, extra ones go."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[
        (coerce(df[have[f.name.lower()]], f.dataType.simpleString(), df.schema[have[f.name.lower()]].dataType)
         if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.fields
    ])
