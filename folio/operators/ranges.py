"""Scans over rows in order within groups of any size: prefix sums, numbers, neighbours, the last or next known value.

The rows are dealt out by ranges of their whole key, so one large group lies in many parts. Each part is scanned for itself by a
window; what a part hands on is a row a group and part, and these are scanned in turn. No task has more than its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.rounds import written


class Ranges:
    """The rows of df in order of `order` within groups of `by`, none of which is null; rows of one key are in one part, in any order."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        self.by, self.order = by, order
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = written(df.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), "ranges")

    def scan(self, df: DataFrame, **columns: tuple[str, Column]) -> DataFrame:
        """df (the rows, with `part`, and what earlier scans added) with new columns, each from a kind and an expression: `sum` and `min` of the
        rows so far; `before`, of the row before; `last` known so far; `next` known from the row on."""
        here = Window.partitionBy(*self.by, "part").orderBy(*self.order)
        so_far, from_here = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(0, Window.unboundedFollowing)
        parts = Window.partitionBy(*self.by).orderBy("part")
        earlier, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
        key = F.struct(*self.order)
        local, edge, carry, out = {}, {}, {}, {}
        for name, (kind, x) in columns.items():
            mine, given = F.col(f"own__{name}"), F.col(f"edge__{name}")
            known = F.when(x.isNotNull(), F.struct(key.alias("k"), x.alias("x")))
            if kind == "sum":
                local[name], edge[name], carry[name] = F.sum(x).over(so_far), F.sum(x), F.sum(given).over(earlier)
                out[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(given, F.lit(0))
            elif kind == "min":
                local[name], edge[name], carry[name] = F.min(x).over(so_far), F.min(x), F.min(given).over(earlier)
                out[name] = F.least(mine, given)
            elif kind == "before":
                local[name], edge[name], carry[name] = F.lag(F.struct(x.alias("x"))).over(here), F.max_by(F.struct(x.alias("x")), key), F.lag(given).over(parts)
                out[name] = F.coalesce(mine, given)["x"]
            elif kind == "last":
                local[name], edge[name], carry[name] = F.last(x, True).over(so_far), F.max(known)["x"], F.last(given, True).over(earlier)
                out[name] = F.coalesce(mine, given)
            elif kind == "next":
                local[name], edge[name], carry[name] = F.first(x, True).over(from_here), F.min(known)["x"], F.first(given, True).over(later)
                out[name] = F.coalesce(mine, given)
            else:
                raise ValueError(kind)
        edges = df.groupBy(*self.by, "part").agg(*[e.alias(f"edge__{n}") for n, e in edge.items()])
        edges = edges.select(*self.by, "part", *[c.alias(f"edge__{n}") for n, c in carry.items()])
        both = df.withColumns({f"own__{n}": c for n, c in local.items()}).join(edges, [*self.by, "part"])
        return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def either(*conditions: Column) -> Column:
    """Whether any holds; what is unknown doesn't."""
    return reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions])
