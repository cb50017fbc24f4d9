"""Writers: state of a Parquet table, JDBC tables, log lines and messages."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import compiled
from ..operators.apply import apply, validate, with_keys, without_keys
from ..operators.combine import last_by_key
from ..sources.metadata import jdbc_link, primary_key, stored_name
from ..sources.sql import identifier, jdbc_options


class ParquetTable:
    """A table of versioned Parquet folders; a write makes a new version, then a row of a small log names it.

    A plan never overwrites a path it reads, and a failed write leaves the old version in place.  All access
    goes through Spark's readers and writers, so any store that Spark can open will do.  One writer at a time.
    """

    LOG = "number long, name string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _last(self) -> tuple[int, str | None]:
        try:
            row = self.spark.read.schema(self.LOG).parquet(f"{self.path}/log").orderBy(F.desc("number")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return tuple(row) if row else (-1, None)

    def exists(self) -> bool:
        return self._last()[1] is not None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{self._last()[1]}")

    def replace(self, state: DataFrame) -> None:
        number = self._last()[0] + 1
        name = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        state.write.parquet(f"{self.path}/data/{name}")
        self.spark.createDataFrame([(number, name)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def apply(self, source: DataFrame, mode: str, keys=None, columns=None, **options) -> None:
        target = self.read() if self.exists() else self.spark.createDataFrame([], source.schema)
        self.replace(apply(target, source, mode, keys, columns, **options))


def _run_sql(spark: SparkSession, connection: dict, statements: list[str]) -> None:
    """Statements in one transaction, over a JDBC connection of the driver."""
    with jdbc_link(spark, jdbc_options(connection)) as link:
        link.setAutoCommit(False)
        for text in statements:
            statement = link.createStatement()
            statement.execute(text)
            statement.close()
        link.commit()


def change_statements(mode: str, table: str, stage: str, keys: list[str], columns: list[str], quote=lambda name: f'"{name}"') -> list[str]:
    """Set-based statements that bring a table to the state that its staging table asks for.

    Only forms that every supported database has; NULL keys match nothing.
    """
    on = " AND ".join(f"{table}.{quote(k)} = s.{quote(k)}" for k in keys)
    match = f"SELECT 1 FROM {stage} s WHERE {on}"
    if mode == "delete":
        return [f"DELETE FROM {table} WHERE EXISTS ({match})"]
    rest = [c for c in columns if c not in keys]
    out = []
    if rest:
        values = ", ".join(f"{quote(c)} = (SELECT s.{quote(c)} FROM {stage} s WHERE {on})" for c in rest)
        out.append(f"UPDATE {table} SET {values} WHERE EXISTS ({match})")
    if mode == "merge":
        names = list(dict.fromkeys([*keys, *columns]))
        listed = ", ".join(map(quote, names))
        out.append(f"INSERT INTO {table} ({listed}) SELECT {', '.join(f's.{quote(c)}' for c in names)} FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {on})")
    return out


def write_jdbc(
    df: DataFrame, table: str, connection: dict, mode: str = "insert", batch: int = 500, keys: list[str] | None = None,
    columns: list[str] | None = None, order_by: list[str] | None = None,
) -> None:
    """Write rows to a JDBC table.  Insert appends them, truncate empties the table.

    Update, merge and delete load the rows, one a key, into a staging table in parallel and then change the table
    by set-based statements in one transaction; the staging table goes in any case.  Keys default to the table's
    primary key.  A table is found in the case it was given in, else in upper, else in lower case.  Names that are not qualified are those of the connection's schema.
    """
    spark, mode = df.sparkSession, mode.lower()
    options = {k: v for k, v in jdbc_options(connection).items() if k != "fetchsize"}
    writer = lambda rows, name: rows.write.format("jdbc").options(**options).option("dbtable", name).option("batchsize", batch)
    if "." not in table and connection.get("schema"):
        table = f"{connection['schema']}.{table}"
    identifier(table)
    there = stored_name(spark, table, options) or table
    if mode in ("insert", "truncate"):
        rows = df if mode == "insert" else df.limit(0)
        writer(rows, there).option("truncate", "true").mode("append" if mode == "insert" else "overwrite").save()
        return
    target = spark.read.format("jdbc").options(**options).option("dbtable", there).load()
    if keys is None:
        keys = primary_key(spark, table, options)
    columns = list(columns if columns is not None else [c for c in df.columns if c in target.columns])
    validate(mode, target, columns, keys)
    names = list(dict.fromkeys([*keys, *columns])) if mode != "delete" else list(keys)
    solid = with_keys(df, keys)
    rows = last_by_key(solid, keys, order_by) if mode != "delete" else solid.select(*keys).distinct()
    if mode == "merge":  # rows with a NULL key match nothing and are inserted
        rows = rows.unionByName(without_keys(df, keys))
    rows = rows.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in names])
    stage = f"{table}_{uuid.uuid4().hex[:12]}"
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier
    writer(rows, stage).mode("errorifexists").save()
    try:
        _run_sql(spark, connection, change_statements(mode, there, stage, keys, columns, quote))
    finally:
        _run_sql(spark, connection, [f"DROP TABLE {stage}"])


def printed(column: str, kind: T.DataType) -> Column:
    value = F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(column).cast("string")
    return F.coalesce(value, F.lit("null"))


def log_lines(df: DataFrame, separator: str = " | ") -> DataFrame:
    """One text line a row: » a: 1 | b: null «."""
    parts = [F.concat(F.lit(f"{f.name}: "), printed(f.name, f.dataType)) for f in df.schema.fields]
    return df.select(F.concat(F.lit("» "), F.concat_ws(separator, *parts), F.lit(" «")).alias("value"))


def messages(df: DataFrame, subject: str, body: str, to: list[str], cc: list[str] = (), bcc: list[str] = (), html: bool = False) -> DataFrame:
    """(to, cc, bcc, subject, body, content_type) for each row whose templates do not fail; fields are checked when the plan is made."""
    return all_messages(df, subject, body, to, cc, bcc, html)[0]


def all_messages(
    df: DataFrame, subject: str, body: str, to: list[str], cc: list[str] = (), bcc: list[str] = (), html: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The messages, and the rows whose templates fail: (row as JSON, error).

    Both come from one plan over ``df``; persist it if both are used and it is dear.
    """
    (head, head_error), (text, text_error) = compiled(subject, df.schema), compiled(body, df.schema)
    error = F.coalesce(head_error, text_error)
    sent = df.where(error.isNull()).select(
        F.lit(",".join(to)).alias("to"), F.lit(",".join(cc)).alias("cc"), F.lit(",".join(bcc)).alias("bcc"),
        head.alias("subject"), text.alias("body"), F.lit("text/html" if html else "text/plain").alias("content_type"),
    )
    return sent, df.where(error.isNotNull()).select(F.to_json(F.struct("*")).alias("row"), error.alias("error"))
