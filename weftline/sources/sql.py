"""SQL sources over the catalog or JDBC, schema discovery and incremental reads."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.types import dedupe_names, unique_names
from . import metadata

# Default ports and URL forms of the supported databases.
DATABASES = {
    "postgres": (5432, "jdbc:postgresql://{host}:{port}/{database}"),
    "sqlserver": (1433, "jdbc:sqlserver://{host}:{port};databaseName={database}"),
    "mysql": (3306, "jdbc:mysql://{host}:{port}/{database}"),
}


def identifier(name: str) -> str:
    """``name`` or ``schema.name`` of at most 128 characters, else an error."""
    if len(name) > 128 or not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def database_kind(connection: dict) -> str:
    """The kind of database: as named, else as the URL says."""
    return connection.get("type") or (connection.get("url", "").split(":") + ["", ""])[1].replace("postgresql", "postgres")


def default_schema(connection: dict) -> str:
    """Where unqualified names are looked up: the connection's schema, else the database's own rule."""
    kind = database_kind(connection)
    return connection.get("schema") or {"postgres": "public", "sqlserver": "dbo", "mysql": connection.get("database", "")}.get(kind, "")


def jdbc_options(connection: dict) -> dict[str, str]:
    """Options of Spark's JDBC reader and writer; ``url`` overrides host, port and database."""
    url = connection.get("url")
    if not url:
        port, form = DATABASES[connection["type"]]
        url = form.format(host=connection["host"], port=connection.get("port", port), database=connection.get("database", ""))
        if connection.get("sslmode") and connection["type"] == "postgres":
            url += f"?sslmode={connection['sslmode']}"
    out = {"url": url}
    for ours, theirs in (("user", "user"), ("password", "password"), ("driver", "driver"), ("batch_size", "fetchsize")):
        if connection.get(ours) is not None:
            out[theirs] = str(connection[ours])
    if connection.get("schema"):
        schema, kind = identifier(connection["schema"]), database_kind(connection)
        if kind == "postgres":
            out["sessionInitStatement"] = f"SET search_path TO {schema}"
        elif kind == "mysql":
            out["sessionInitStatement"] = f"USE {schema}"
        elif kind == "derby":
            out["sessionInitStatement"] = f"SET SCHEMA {schema}"
        elif kind == "sqlserver" and schema.lower() != "dbo":
            raise ValueError("SQL Server sessions have no schema of their own: qualify the names of the query")
    for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        if connection.get(k) is not None:
            out[k] = str(connection[k])
    return out


def sql_source(spark: SparkSession, query: str, connection: dict | None = None) -> DataFrame:
    """Rows of a query, over temp views and the catalog or, with a connection, over JDBC; names made unique."""
    query = query.strip().rstrip(";")
    if connection is None:
        return dedupe_names(spark.sql(query))
    options = jdbc_options(connection)
    if "partitionColumn" in options:  # a parallel read takes a derived table
        return dedupe_names(spark.read.format("jdbc").options(**options).option("dbtable", f"({query}) q").load())
    return dedupe_names(spark.read.format("jdbc").options(**options).option("query", query).load())


def split_points(df: DataFrame, column: str, parts: int, accuracy: int = 100_000) -> list:
    """Values that cut the rows into ``parts`` of about equal size, at most ``parts - 1``, in order; NULLs aside.

    Quantiles of the column by a sketch of bounded size: no row comes to the driver.  A value that fills several
    parts is one split point, so fewer come back.
    """
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(f"`{column}`"), F.array(*map(F.lit, shares)), accuracy)).first()[0]
    return sorted(set(found or []))


def _literal(value, kind: str) -> str:
    """A number, date or time in the database's SQL."""
    if not isinstance(value, dt.date):
        return str(value)
    if not isinstance(value, dt.datetime):
        return f"CAST('{value}' AS DATE)"
    stamp = {"mysql": "DATETIME(6)", "sqlserver": "DATETIME2"}.get(kind, "TIMESTAMP")
    return f"CAST('{value:%Y-%m-%d %H:%M:%S.%f}' AS {stamp})"


def split_predicates(points: list, column: str, connection: dict) -> list[str]:
    """Conditions in the database's SQL, one a part, that hold for each row exactly once; NULLs are in the first."""
    kind = database_kind(connection)
    c = quoted(column, kind)
    values = [_literal(v, kind) for v in points]
    if not values:
        return [f"{c} = {c} OR {c} IS NULL"]
    first = [f"{c} <= {values[0]} OR {c} IS NULL"]
    middle = [f"{c} > {lo} AND {c} <= {hi}" for lo, hi in zip(values, values[1:])]
    return [*first, *middle, f"{c} > {values[-1]}"]


def quoted(name: str, kind: str) -> str:
    return {"mysql": "`{}`", "sqlserver": "[{}]"}.get(kind, '"{}"').format(name)


def parallel_source(spark: SparkSession, query: str, connection: dict, column: str, parts: int = 8, scan_parts: int | None = None) -> DataFrame:
    """``sql_source`` read in parallel, in parts of about equal numbers of rows whatever the distribution of ``column``.

    The column (a number, date or timestamp of the query's) is read alone first, for its quantiles: in
    ``scan_parts`` even intervals between its ends, or over one connection.  A value that more than one part's share
    of the rows has stays in one part: choose a column whose values are many.
    """
    query = query.strip().rstrip(";")
    kind = database_kind(connection)
    alone = f"SELECT {quoted(column, kind)} FROM ({query}) q"
    narrow = {k: v for k, v in connection.items() if k not in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")}
    points = split_points(sql_source(spark, alone, _even(spark, alone, narrow, column, scan_parts)), column, parts)
    options = jdbc_options(narrow)
    options.pop("url")
    rows = spark.read.options(**options).jdbc(jdbc_options(narrow)["url"], f"({query}) q", predicates=split_predicates(points, column, connection), properties={})
    return dedupe_names(rows)


def _even(spark: SparkSession, query: str, connection: dict, column: str, parts: int | None) -> dict:
    """The connection with even intervals between the ends of a column, for a first look at it."""
    if not parts or parts < 2:
        return connection
    c = quoted(column, database_kind(connection))
    low, high = sql_source(spark, f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM ({query}) e", connection).first()
    if low is None or low == high:
        return connection
    return connection | {"partitionColumn": c, "lowerBound": low, "upperBound": high, "numPartitions": parts}


def infer_schema(spark: SparkSession, query: str, connection: dict | None = None) -> DataFrame:
    """(ordinal, name, source_type, type, length, precision, scale, nullable) of a query, without running it.

    Over the catalog the source type is Spark's own; a length comes from char and varchar columns.  Over JDBC the
    driver prepares the query and tells what it would give; repeated names get numbers, as in ``sql_source``.
    """
    if connection is not None:
        found = metadata.query_columns(spark, query, jdbc_options(connection))
        names = unique_names([r["name"] for r in found.orderBy("ordinal").select("name").collect()])  # columns of a query
        renamed = F.element_at(F.array(*map(F.lit, names)), F.col("ordinal"))
        return found.withColumn("name", renamed)
    rows = []
    for i, f in enumerate(sql_source(spark, query).schema.fields, 1):
        declared = f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", f.dataType.simpleString())
        size = re.fullmatch(r"(?:var)?char\((\d+)\)", declared)
        number = (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, DecimalType) else (None, None)
        rows.append((i, f.name, declared, f.dataType.simpleString(), int(size[1]) if size else None, *number, f.nullable))
    return spark.createDataFrame(rows, metadata.QUERY)


def filled(df: DataFrame) -> DataFrame:
    """(name, rows, filled): for each column how many rows there are and how many have a value, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col("_rows").alias("rows"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(df.columns)])
    return counts.select(F.inline(each))


def list_tables(spark: SparkSession, connection: dict | None = None, like: str | None = None) -> DataFrame:
    """(schema, name) of base tables, without system schemas, in order."""
    if connection is None:
        found = [((t.namespace or [""])[-1], t.name) for t in spark.catalog.listTables(pattern=like)]
        return spark.createDataFrame(found, "schema string, name string").orderBy("schema", "name")
    return metadata.tables(spark, jdbc_options(connection))


def list_columns(spark: SparkSession, table: str, connection: dict | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, name, type, nullable, is_primary) of a table; the catalog has no keys, so they can be named."""
    if connection is None:
        fields = spark.table(table).schema.fields
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable, f.name in keys) for i, f in enumerate(fields, 1)]
        return spark.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean, is_primary boolean")
    return metadata.with_primary(metadata.columns(spark, identifier(table), jdbc_options(connection)))


def default_keys(columns: DataFrame) -> list[str]:
    """The primary key of a table, from its listed columns (see list_columns), in the key's order where it is known."""
    order = ["key_position", "ordinal"] if "key_position" in columns.columns else ["ordinal"]
    return [r["name"] for r in columns.where("is_primary").orderBy(*order).select("name").collect()]  # a key's columns: few


#: Views of the standard's information schema that describe_schema reads, and their columns.
METADATA = {
    "columns": "table_schema table_name column_name ordinal_position data_type is_nullable character_maximum_length numeric_precision numeric_scale column_default",
    "key_column_usage": "table_schema table_name column_name constraint_name ordinal_position position_in_unique_constraint",
    "table_constraints": "table_schema table_name constraint_name constraint_type",
    "referential_constraints": "constraint_schema constraint_name unique_constraint_schema unique_constraint_name update_rule delete_rule",
}
#: Columns that not every database has, by view: without them constraint names must be unique in a schema.
MORE_METADATA = {"referential_constraints": ("table_name", "referenced_table_name")}


def describe_schema(spark: SparkSession, connection: dict | None = None, views: dict[str, DataFrame] | None = None, comments: DataFrame | None = None) -> DataFrame:
    """The column catalog: type, length, precision, scale, default, constraint, foreign-key target and its rules, comment.

    With a connection the driver's metadata says it all, comments included.  Else ``views`` are frames of the
    standard's information schema (say, exported from a database that Spark cannot reach), and ``comments`` has
    (schema, table, column, comment).  One row a column and constraint; columns of system schemas are left out.  Each
    column of a foreign key has the column of the same place in the key that it refers to.
    """
    if connection is not None:
        return metadata.describe(spark, jdbc_options(connection))
    read = {}
    for view, names in METADATA.items():
        df = views[view].toDF(*[c.lower() for c in views[view].columns])
        read[view] = df.select(*names.split(), *[c for c in MORE_METADATA.get(view, ()) if c in df.columns])
    columns = read["columns"].where(~F.lower("table_schema").isin(*metadata.SYSTEM_SCHEMAS))
    uses = read["key_column_usage"].join(read["table_constraints"], ["table_schema", "table_name", "constraint_name"], "left")
    # a foreign key's column stands for the column at the same place of the key that it refers to
    target = read["key_column_usage"].select(
        F.col("table_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"),
        F.col("ordinal_position").alias("position_in_unique_constraint"), F.col("table_name").alias("referenced_table_name"),
        F.concat_ws(".", "table_name", "column_name").alias("refers_to"),
    )
    links = read["referential_constraints"].withColumnRenamed("constraint_schema", "table_schema")
    by_name = [c for c in ("table_schema", "table_name", "constraint_name") if c in links.columns]
    uses = uses.join(links, by_name, "left")
    place = ["unique_constraint_schema", "unique_constraint_name", "position_in_unique_constraint"]
    if "referenced_table_name" in links.columns:  # names like PRIMARY repeat from table to table
        place.append("referenced_table_name")
    else:
        target = target.drop("referenced_table_name")
    uses = uses.join(target, place, "left").drop("ordinal_position")
    out = columns.join(uses, ["table_schema", "table_name", "column_name"], "left").select(
        F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("column_name").alias("column"),
        F.col("ordinal_position").cast("int").alias("ordinal"), F.col("data_type").alias("type"), (F.upper("is_nullable") == "YES").alias("nullable"),
        F.col("character_maximum_length").cast("long").alias("length"), F.col("numeric_precision").cast("int").alias("precision"),
        F.col("numeric_scale").cast("int").alias("scale"), F.col("column_default").cast("string").alias("default"),
        "constraint_type", "constraint_name", "refers_to", "update_rule", "delete_rule",
    )
    if comments is not None:
        out = out.join(comments, ["schema", "table", "column"], "left")
    return out.orderBy("schema", "table", "ordinal", "constraint_name")


# The watermark that stands for "nothing read yet" of each kind.
ZERO = {"int": "0", "timestamp": "0001-01-01 00:00:00", "uuid": ""}
_SPARK = {"int": "bigint", "timestamp": "timestamp_ntz", "uuid": "string"}


def watermark(text: str | None, kind: str):
    """A stored watermark as a typed literal."""
    if kind not in ZERO:
        raise ValueError(f"unknown watermark kind {kind!r}")
    return F.lit(text if text else ZERO[kind]).cast(_SPARK[kind])


def encode_watermark(value, kind: str) -> str:
    """The stored form of a watermark: timestamps keep microseconds."""
    if value is None:
        return ZERO[kind]
    return value.isoformat(sep=" ") if kind == "timestamp" and not isinstance(value, str) else str(value)


def poll_increment(
    df: DataFrame, column: str, last: str | None, kind: str = "int", columns: list[str] | None = None,
    where: str | None = None, batch: int = 100, include_ties: bool = False,
) -> DataFrame:
    """The next rows past a watermark, in its order, at most ``batch`` (plus ties of the last with include_ties)."""
    identifier(column)
    new = df.where(F.col(column) > watermark(last, kind))
    if where:
        new = new.where(F.expr(where))
    if columns:
        new = new.select(*dict.fromkeys([column, *columns]))
    first = new.orderBy(column).limit(batch)
    if not include_ties:
        return first
    edge = first.agg(F.max(column).alias("_edge"))  # one row
    return new.join(F.broadcast(edge), F.col(column) <= F.col("_edge")).drop("_edge").orderBy(column)


def initial_watermark(df: DataFrame, column: str) -> DataFrame:
    """One row: the current maximum, so that only later rows count."""
    return df.agg(F.max(identifier(column)).alias("watermark"))
