"""Lines, runs and units of a page: cleaning, splitting, sizes and the union of kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.scripts import BLANK
from folio.functions.text import half_points, strip
from folio.operators.layout import mode
from folio.operators.rounds import spread

BOX = ("x0", "y0", "x1", "y1")


def cleaned(text: Column, vertical: Column | None = None) -> Column:
    """A run's text without replacement characters, trimmed, with white space as one blank; a column loses it all."""
    t = F.regexp_replace(text, "�", "")
    flat = F.regexp_replace(F.regexp_replace(t, f"^{BLANK}+|{BLANK}+$", ""), f"{BLANK}+", " ")
    return flat if vertical is None else F.when(vertical, F.regexp_replace(t, BLANK, "")).otherwise(flat)


def pruned(runs: DataFrame) -> DataFrame:
    """Units (doc_id, page, unit, n_runs, box) of the runs that aren't blank; a unit without any goes."""
    full = runs.where(strip(F.col("text")) != "")
    return full.groupBy("doc_id", "page", "unit").agg(F.count("*").alias("n_runs"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def split_at_gutters(pieces: DataFrame, gutters: DataFrame, parts: int | None = None) -> DataFrame:
    """Pieces of lines (doc_id, page, line, x0, x1) with `part`: a new part begins across any gutter of the page.

    A page's gutters are few (they lie side by side in its width), so they ride along as an array.
    """
    own = gutters.groupBy("doc_id", "page").agg(F.collect_list(F.struct("g0", "g1")).alias("gs"))
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    rows = spread(pieces, "doc_id", "page", parts=parts).withColumn("px1", F.lag("x1").over(w)).join(own, ["doc_id", "page"], "left")
    cross = F.exists("gs", lambda g: (F.col("px1") <= g["g0"] + 0.5) & (F.col("x0") >= g["g1"] - 0.5))
    return rows.withColumn("cross", F.coalesce(cross, F.lit(False)).cast("int")).withColumn("part", F.sum("cross").over(w)).drop("px1", "gs", "cross")


def unit_sizes(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, size, n_chars, vertical): the most frequent size of non-space glyphs (ties to the larger), their number, and whether half stand vertically."""
    solid = glyphs.where(strip(F.col("c")) != "").withColumn("size", half_points(F.col("size")))
    per = solid.groupBy("doc_id", "page", "size").agg(F.count("*").alias("n"), F.count_if("vertical").alias("v"))
    return per.groupBy("doc_id", "page").agg(mode(F.col("size"), F.col("n")).alias("size"), F.sum("n").alias("n_chars"), (F.sum("v") * 2 >= F.sum("n")).alias("vertical"))


def united(*kinds: DataFrame) -> DataFrame:
    """Text, tables, drawings and images in this order: ord goes on from kind to kind."""
    tagged = [k.select("doc_id", "page", F.lit(i).alias("turn"), "kind", "ord", *BOX) for i, k in enumerate(kinds)]
    w = Window.partitionBy("doc_id", "page").orderBy("turn", "ord")
    return reduce(DataFrame.unionByName, tagged).withColumn("ord", F.row_number().over(w) - 1).drop("turn")


def rotated(rotation: Column, width: Column, height: Column) -> list[Column]:
    """A box as it lies on the page turned by 0, 90, 180 or 270 degrees; width and height are the page's before the turn."""
    x0, y0, x1, y1 = (F.col(c) for c in BOX)
    pick = lambda a, b, c, d: F.when(rotation == 90, b).when(rotation == 180, c).when(rotation == 270, d).otherwise(a)
    return [
        pick(x0, height - y1, width - x1, y0).alias("x0"),
        pick(y0, x0, height - y1, width - x1).alias("y0"),
        pick(x1, height - y0, width - x0, y1).alias("x1"),
        pick(y1, x1, height - y0, width - x0).alias("y1"),
    ]


def allowed_only(rows: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """The rows whose value, in lower case, is in the list; an empty list lets nothing through."""
    names = allowed.select(F.lower(F.trim(F.col(column))).alias("allowed__")).distinct()
    return rows.join(names, F.lower(F.trim(F.col(column))) == F.col("allowed__"), "left_semi")
