"""Queries of lines, runs and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.scripts import BLANK
from folio.operators import layout as L
from folio.operators import units as U
from folio.plans.base import Rows, query, table
from folio.plans.texts import _GLYPHS, _GRID, _GUTTERS, _HOLES, _columns, _lines, _parts, _strip


@query(f"WITH {_GRID}, c AS (SELECT doc_id, page, line, replace(text, chr(65533), '') AS t FROM lines) SELECT doc_id, page, line, CASE WHEN line % 5 = 0 THEN regexp_replace(t, '{BLANK}', '', 'g') ELSE regexp_replace(regexp_replace(t, '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+', ' ', 'g') END AS text FROM c")
def cleaned_runs(spark, sf_dir):
    """Every fifth line as a column."""
    return _lines(spark, sf_dir).select("doc_id", "page", "line", U.cleaned(F.col("text"), F.col("line") % 5 == 0).alias("text"))


@query(f"WITH {_GRID} SELECT doc_id, page, line // 4 AS unit, count(*) AS n_runs, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines WHERE {_strip('text')} <> '' GROUP BY ALL")
def pruned_units(spark, sf_dir):
    return U.pruned(_lines(spark, sf_dir).withColumn("unit", F.expr("cast(line div 4 AS int)")))


@query(
    f"""WITH {_GRID}, {_HOLES}, {_GUTTERS},
p AS (SELECT doc_id, page, line, x0, x1, lag(x1) OVER (PARTITION BY doc_id, page, line ORDER BY x0) AS px1 FROM hl),
c AS (SELECT p.*, EXISTS (SELECT 1 FROM gu WHERE gu.doc_id = p.doc_id AND gu.page = p.page AND px1 <= g0 + 0.5 AND x0 >= g1 - 0.5) AS b FROM p)
SELECT doc_id, page, line, x0, x1, (sum(b::INT) OVER (PARTITION BY doc_id, page, line ORDER BY x0))::BIGINT AS part FROM c"""
)
def gutter_split(spark, sf_dir):
    pieces = _columns(spark, sf_dir).select("doc_id", "page", "line", "x0", "x1")
    parts = _parts(spark, sf_dir)
    return U.split_at_gutters(pieces, L.gutters(_columns(spark, sf_dir), parts=parts), parts)


@query(
    f"""WITH {_GRID}, {_GLYPHS}, s AS (SELECT doc_id, page, size, count(*) AS n, count(*) FILTER (WHERE line % 2 = 0) AS v FROM gl WHERE {_strip('c')} <> '' GROUP BY ALL)
SELECT doc_id, page, arg_max(size, {{'a': n, 'b': size}}) AS size, sum(n)::BIGINT AS n_chars, sum(v) * 2 >= sum(n) AS vertical FROM s GROUP BY ALL"""
)
def unit_sizes(spark, sf_dir):
    """Even lines as vertical ones."""
    return U.unit_sizes(L.glyphs(_lines(spark, sf_dir)).withColumn("vertical", F.col("line") % 2 == 0))


_TEXT = Rows("doc_id long, page int, kind string, ord int, x0 double, y0 double, x1 double, y1 double", (1, 1, "text", 4, 0.0, 0.0, 1.0, 1.0), (1, 1, "text", 7, 0.0, 2.0, 1.0, 3.0), (1, 2, "text", 0, 0.0, 0.0, 1.0, 1.0))
_TABLE = Rows("doc_id long, page int, kind string, ord int, x0 double, y0 double, x1 double, y1 double", (1, 1, "table", 0, 0.0, 5.0, 1.0, 6.0))
_IMAGE = Rows("doc_id long, page int, kind string, ord int, x0 double, y0 double, x1 double, y1 double", (1, 1, "image", 0, 0.0, 8.0, 1.0, 9.0), (1, 2, "image", 3, 0.0, 8.0, 1.0, 9.0))


@query("SELECT * FROM (VALUES (1, 1, 'text', 0), (1, 1, 'text', 1), (1, 1, 'table', 2), (1, 1, 'image', 3), (1, 2, 'text', 0), (1, 2, 'image', 1)) t(doc_id, page, kind, ord)", long="doc_id")
def united_units(spark, sf_dir):
    return U.united(_TEXT.df(spark), _TABLE.df(spark), _IMAGE.df(spark)).select("doc_id", "page", "kind", "ord")


_TURNED = Rows("id long, rotation int, x0 double, y0 double, x1 double, y1 double, want string", (1, 0, 10.0, 20.0, 30.0, 60.0, "10 20 30 60"), (2, 90, 10.0, 20.0, 30.0, 60.0, "140 10 180 30"), (3, 180, 10.0, 20.0, 30.0, 60.0, "70 140 90 180"), (4, 270, 10.0, 20.0, 30.0, 60.0, "20 70 60 90"))


@query(f"SELECT id, want AS box FROM {_TURNED.sql}")
def rotated_boxes(spark, sf_dir):
    boxes = U.rotated(F.col("rotation"), F.lit(100.0), F.lit(200.0))
    return _TURNED.df(spark).select("id", *boxes).select("id", F.concat_ws(" ", *[F.col(c).cast("int").cast("string") for c in U.BOX]).alias("box"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) IN (SELECT lower(event_type) FROM events WHERE user_id % 50 = 0 AND event_type <> 'click')")
def allowed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return U.allowed_only(e, e.where("user_id % 50 = 0 AND event_type <> 'click'"), "event_type").select("event_id", "event_type")
