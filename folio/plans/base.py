"""How queries, their fixtures and their SQL are kept together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, long: str = ""):
    """Registers a query and its SQL; long: columns that the SQL's literals leave too narrow."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            wide = ", ".join(f"{c}::BIGINT AS {c}" for c in long.split())
            SQL[f.__name__] = f"SELECT * REPLACE ({wide}) FROM ({sql})" if long else sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


class Rows:
    """A small table that both engines see alike: schema as in DDL."""

    def __init__(self, schema: str, *rows: Sequence):
        self.schema, self.rows = schema, [tuple(r) for r in rows]
        self.names = [c.split()[0] for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        kinds = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        cols = ", ".join(f"{c.split()[0]}::{kinds[c.split()[1]]} AS {c.split()[0]}" for c in self.schema.split(", "))
        return f"(SELECT {cols} FROM (VALUES {rows}) AS v({', '.join(self.names)})) AS t"

    def select(self) -> str:
        return f"SELECT * FROM {self.sql}"
