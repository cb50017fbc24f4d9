"""Cursors: watermarks of one column, or of a column and a key that breaks its ties, and the slices between them.

A slice ``after < (value, key) <= upto`` is fixed by its two watermarks: read again, it holds the same rows, and any
that came to lie in it since.  Both ends are plain comparisons, which reach Parquet and JDBC.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metadata
from .sql import database_kind, encode_watermark, identifier, jdbc_options, watermark


@dataclass(frozen=True)
class Cursor:
    """The place of a poll in a table: ``column`` of a kind (int, timestamp, uuid) and, if its values repeat, a ``key``.

    A watermark is text: the value, or a JSON list of the value and the key.  None and "" stand for the beginning.
    """

    column: str
    kind: str = "int"
    key: str | None = None
    key_kind: str = "int"

    def __post_init__(self):
        for name in filter(None, (self.column, self.key)):
            identifier(name)
        watermark(None, self.kind), watermark(None, self.key_kind)

    @property
    def columns(self) -> list[str]:
        return [self.column, *([self.key] if self.key else [])]

    def encode(self, value, key=None) -> str:
        text = encode_watermark(value, self.kind)
        return json.dumps([text, encode_watermark(key, self.key_kind)]) if self.key else text

    def decode(self, mark: str) -> tuple[str, str | None]:
        """(value, key) of a watermark; one without a key, as from before the cursor had one, has all of its value's ties behind it."""
        if self.key and mark.startswith("["):
            value, key = json.loads(mark)
            return value, key
        return mark, None

    def after(self, mark: str | None) -> Column:
        """Rows past a watermark."""
        value, key = self.decode(mark or "")
        column, bound = F.col(self.column), watermark(value, self.kind)
        if not self.key or key is None:
            return column > bound
        # the first half alone bounds the column, so that files and row groups before it are not read
        return (column >= bound) & ((column > bound) | (F.col(self.key) > watermark(key, self.key_kind)))

    def upto(self, mark: str) -> Column:
        """Rows at or before a watermark."""
        value, key = self.decode(mark)
        column, bound = F.col(self.column), watermark(value, self.kind)
        if not self.key or key is None:
            return column <= bound
        return (column <= bound) & ((column < bound) | (F.col(self.key) <= watermark(key, self.key_kind)))

    def poll(self, df: DataFrame, mark: str | None, batch: int = 100, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """The next rows past a watermark, in order, at most ``batch``; with a key, no tie is ever lost between polls."""
        new = df.where(self.after(mark))
        if where:
            new = new.where(F.expr(where))
        if columns:
            new = new.select(*dict.fromkeys([*self.columns, *columns]))
        return new.orderBy(*self.columns).limit(batch)

    def bound(self, df: DataFrame, mark: str | None, batch: int = 100, where: str | None = None) -> str | None:
        """The watermark of the last of the next ``batch`` rows; None if there is no row past ``mark``.  One row comes to the driver."""
        last = self.poll(df, mark, batch, [self.column], where).agg(F.max(F.struct(*self.columns))).first()[0]
        return None if last is None else self.encode(*last)

    def slice(self, df: DataFrame, mark: str | None, upto: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """The rows between two watermarks."""
        new = df.where(self.after(mark) & self.upto(upto))
        if where:
            new = new.where(F.expr(where))
        return new.select(*dict.fromkeys([*self.columns, *columns])) if columns else new

    def bound_query(self, table: str, kind: str, mark: str | None, skip: int, where: str | None = None, last: bool = False) -> str:
        """SQL of the database for the row ``skip`` places past the next one, or for the ``last`` row of all."""
        quote = {"mysql": "`{}`", "sqlserver": "[{}]"}.get(kind, '"{}"').format
        stamp = {"mysql": "DATETIME(6)", "sqlserver": "DATETIME2"}.get(kind, "TIMESTAMP")

        def literal(text: str | None, what: str) -> str:
            text = text or encode_watermark(None, what)
            if what == "int":
                return str(int(text))
            quoted = "'" + text.replace("'", "''") + "'"
            return f"CAST({quoted} AS {stamp})" if what == "timestamp" else quoted

        value, key = self.decode(mark or "")
        c, v = quote(self.column), literal(value, self.kind)
        past = f"{c} > {v}"
        if self.key and key is not None:
            past = f"{c} >= {v} AND ({c} > {v} OR {quote(self.key)} > {literal(key, self.key_kind)})"
        if where:
            past = f"{past} AND ({where})"
        names = [quote(n) for n in self.columns]
        order = ", ".join(f"{n} DESC" for n in names) if last else ", ".join(names)
        page = f"LIMIT 1 OFFSET {skip}" if kind == "mysql" else f"OFFSET {skip} ROWS FETCH NEXT 1 ROWS ONLY"
        return f"SELECT {', '.join(names)} FROM {identifier(table)} WHERE {past} ORDER BY {order} {page}"

    def bound_jdbc(self, spark: SparkSession, table: str, connection: dict, mark: str | None, batch: int = 100, where: str | None = None) -> str | None:
        """``bound`` of a table behind JDBC, by the database's own ordered read: one row leaves it.

        Where fewer than ``batch`` rows are new, it is the last row of all; ``where`` is in the database's SQL.
        """
        kind = database_kind(connection)
        options = jdbc_options(connection)
        with metadata.jdbc_link(spark, options) as link:
            statement = link.createStatement()
            for skip, last in ((batch - 1, False), (0, True)):
                found = statement.executeQuery(self.bound_query(table, kind, mark, skip, where, last))
                if found.next():
                    return self.encode(*[found.getString(i) for i in range(1, len(self.columns) + 1)])
        return None
