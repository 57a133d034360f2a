"""Queries over inline tables, for what the driver's tables can't show: scripts, geometry, packages, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import scripts as S
from folio.functions import text as T
from folio.operators import catalog as C
from folio.operators import layout as L
from folio.operators import package as P
from folio.operators import spatial as SP
from folio.operators import structure as ST
from folio.plans.base import Rows, query

_TAGS = Rows("id long, declared string, guessed string, want string", (1, "ja-JP", "ja", "ja-JP"), (2, "zh", "zh-TW", "zh-TW"), (3, "en-US", "ja", "ja"), (4, "not a tag!", "ko", "ko"), (5, None, "en", "en"), (6, "zh_Hant_TW", "zh-TW", "zh-Hant-TW"), (7, "", "de", "de"), (8, "en", "en", "en"), (9, "zh", "zh", "zh"))


@query(f"SELECT id, want AS language FROM {_TAGS.sql}")
def lang_resolution(spark, sf_dir):
    return _TAGS.df(spark).select("id", S.resolve_language(F.col("declared"), F.col("guessed")).alias("language"))


_MODELS = Rows("id long, tag string, want string", (1, "zh-TW", "chi_tra"), (2, "x-zh-hant", "chi_tra"), (3, "zh-Hans-SG", "chi_sim"), (4, "zh", "chi_tra+chi_sim"), (5, "ja", "jpn"), (6, "ko-KR", "kor"), (7, "EN-gb", "eng"), (8, "fr", "deu+fra"), (9, None, "deu+fra"), (10, "", "deu+fra"))


@query(f"SELECT id, want AS langs FROM {_MODELS.sql}")
def ocr_lang_build(spark, sf_dir):
    return _MODELS.df(spark).select("id", S.recognition_languages(F.col("tag"), F.lit("deu+fra")).alias("langs"))


_ASKED = Rows("id long, asked string, have array<string>, usable string, dropped string", (1, "chi_tra+eng+jpn", ["jpn", "chi_tra"], "chi_tra+jpn", "eng"), (2, "eng", [], "eng", ""), (3, "eng++eng", ["eng"], "eng+eng", ""), (4, "kor", ["eng"], "", "kor"))


@query(f"SELECT id, usable, dropped FROM {_ASKED.sql}")
def ocr_lang_resolve(spark, sf_dir):
    usable, dropped = S.usable_languages(F.col("asked"), F.col("have"))
    return _ASKED.df(spark).select("id", usable.alias("usable"), dropped.alias("dropped"))


_OCR = Rows(
    "id long, mode string, pages int, coverage double, fraction double, done boolean, after double, unit string, whole string, note string",
    (1, "off", 3, 0.0, 1.0, False, 0.0, "off", "off", ""),
    (2, "auto", 3, 0.1, 0.0, True, 0.5, "clean", "scan", "text recovered via OCR (scanned PDF)"),
    (3, "auto", 3, 0.9, 0.1, True, 0.9, "pua", "rebuild", "text layer rebuilt via OCR (PUA-obfuscated PDF)"),
    (4, "always", 3, 0.9, 0.0, True, 0.9, "always", "keep", ""),
    (5, "auto", 3, 0.2, 0.05, False, 0.2, "clean", "keep", ""),
    (6, "auto", 0, 0.0, 0.5, False, 0.0, "pua", "off", ""),
    (7, "auto", 3, 0.1, 0.5, True, 0.1, "pua", "scan", "OCR ran but recovered little text; pages kept as images"),
    (8, "auto", 3, 0.1, 0.0, False, 0.1, "clean", "scan", "scanned PDF; OCR unavailable, pages kept as images"),
    (9, "auto", 3, 0.9, 0.5, False, 0.9, "pua", "rebuild", "text layer is PUA-obfuscated and OCR failed; text may be garbled"),
)


@query(f"SELECT id, unit, whole, note FROM {_OCR.sql}")
def ocr_decision(spark, sf_dir):
    c = F.col
    whole = S.prepare_action(c("mode"), c("pages"), c("coverage"), c("fraction"), F.lit(0.1))
    return _OCR.df(spark).select("id", S.ocr_action(c("mode"), c("fraction"), F.lit(0.1)).alias("unit"), whole.alias("whole"), F.coalesce(S.prepare_note(whole, c("done"), c("after")), F.lit("")).alias("note"))


_HYPHENS = Rows("id long, parts array<string>, vertical boolean, want string", (1, ["The commu-", "nication failed"], False, "The communication failed"), (2, ["吾輩は猫で", "ある。"], False, "吾輩は猫である。"), (3, ["내리기도", "한다."], False, "내리기도한다."), (4, ["PARAGRAPH-", "END"], False, "PARAGRAPH-END"), (5, ["a 1-", "b"], False, "a 1- b"), (6, ["co-", "op"], True, "co- op"), (7, ["soft­", "ly", " ", "done"], False, "softly done"), (8, [], False, ""))


@query(f"SELECT id, want AS joined FROM {_HYPHENS.sql}")
def dehyphenate(spark, sf_dir):
    return _HYPHENS.df(spark).select("id", T.dehyphenate(F.col("parts"), F.col("vertical")).alias("joined"))


_SIG = Rows("id long, line string, want string, number boolean", (1, "Chapter One · 17", "chapter one · #", False), (2, "Chapter One · 132", "chapter one · #", False), (3, "第三章　12", "第#章 #", False), (4, "第三章　345", "第#章 #", False), (5, "— 12 —", "— # —", True), (6, "Page 3/10", "page #/#", True), (7, "ＸＩＶ", "#", False), (8, "a mild did I", "a # # #", False), (9, "12ページ", "#ページ", True), (10, "３", "#", False))


@query(f"SELECT id, want AS signature, number FROM {_SIG.sql}")
def signature_cases(spark, sf_dir):
    return _SIG.df(spark).select("id", T.band_signature(F.col("line")).alias("signature"), T.is_page_number(F.col("line")).alias("number"))


_FONT = Rows("id long, flags int, font string, wmode int, dx double, dy double, want string", (1, 16, "Times", 0, 1.0, 0.0, "b"), (2, 2, "Arial-SemiBold", 1, 1.0, 0.0, "biv"), (3, 9, "Courier", 0, 0.0, -1.0, "msv"), (4, 0, "Georgia-Oblique", 0, 1.0, 0.0, "i"), (5, 0, "Plain", 0, 1.0, 0.5, ""))


@query(f"SELECT id, want AS style FROM {_FONT.sql}")
def span_styles(spark, sf_dir):
    d = _FONT.df(spark).select("id", *T.font_style(F.col("flags"), F.col("font")), T.is_vertical(F.col("wmode"), F.col("dx"), F.col("dy")).alias("v"))
    return d.select("id", F.concat(*[F.when(F.col(c), x).otherwise("") for c, x in (("bold", "b"), ("italic", "i"), ("mono", "m"), ("sup", "s"), ("v", "v"))]).alias("style"))


_SCALARS = Rows("id long, y double, size double, ladder array<double>, pos int, half double, level int", (1, 7.5, 10.24, [18.0, 14.0, 12.0], 2, 10.0, 4), (2, 4.5, 13.99, [18.0, 14.0, 12.0], 2, 14.0, 2), (3, 1.5, 18.25, [18.0], 0, 18.0, 1), (4, 100.0, 5.0, [], 33, 5.0, 4), (5, 10.5, 12.0, [30.0, 24.0, 20.0, 16.0, 12.0], 4, 12.0, 4))


@query(f"SELECT id, pos, half, level FROM {_SCALARS.sql}")
def position_keys(spark, sf_dir):
    return _SCALARS.df(spark).select("id", T.position_key(F.col("y")).alias("pos"), T.half_points(F.col("size")).alias("half"), T.heading_level(F.col("ladder"), F.col("size")).alias("level"))


_HEADING = Rows("id long, chars int, runs int, size double, bold boolean, terminal boolean, want boolean", (1, 20, 1, 11.5, False, False, True), (2, 20, 1, 10.0, True, False, True), (3, 20, 1, 10.0, True, True, False), (4, 61, 1, 10.0, True, False, False), (5, 161, 1, 20.0, False, False, False), (6, 20, 5, 20.0, False, False, False), (7, 0, 0, 20.0, False, False, False), (8, 20, 2, 10.0, True, False, False))


@query(f"SELECT id, want AS heading FROM {_HEADING.sql}")
def heading_like(spark, sf_dir):
    return _HEADING.df(spark).select("id", L.is_heading_like(F.col("chars"), F.col("runs"), F.col("size"), F.lit(10.0), F.col("bold"), F.col("terminal")).alias("heading"))


_STACK = Rows("doc_id long, block int, line int, text string, x0 double, y0 double, x1 double, y1 double", *[(1, 0, i, c, 50.0, 10.0 * i, 60.0, 10.0 * i + 10) for i, c in enumerate("吾輩は猫")], *[(1, 1, i, c, 50.0, 10.0 * i, 60.0, 10.0 * i + 10) for i, c in enumerate("abcd")], *[(1, 2, i, c, 50.0, 10.0 * i, 60.0, 10.0 * i + 10) for i, c in enumerate("吾輩")], *[(1, 3, i, "吾輩は猫である", 50.0, 10.0 * i, 120.0, 10.0 * i + 10) for i in range(4)])


@query("SELECT * FROM (VALUES (1, 0, true), (1, 1, false), (1, 2, false), (1, 3, false)) t(doc_id, block, stacked)", long="doc_id")
def stacked_blocks(spark, sf_dir):
    return L.is_stacked(_STACK.df(spark))


def _glyph_rows(doc: int, text: str, x: float, y: float, size: float = 10.0):
    return [(doc, 1, i, c, x + i * size * 0.5, float(y), x + (i + 1) * size * 0.5, y + size) for i, c in enumerate(text)]


_GLYPHS = Rows("doc_id long, page int, g int, c string, x0 double, y0 double, x1 double, y1 double", *_glyph_rows(1, "see the link here", 50, 100), *_glyph_rows(2, "table text", 50, 300))
_LINKS = Rows("doc_id long, page int, k int, x0 double, y0 double, x1 double, y1 double, href string", (1, 1, 0, 90.0, 100.0, 110.0, 110.0, "a"), (1, 1, 1, 70.0, 100.0, 95.0, 110.0, "b"), (1, 1, 2, 300.0, 10.0, 310.0, 60.0, "c"))
_HITS = "h AS (SELECT g.doc_id, g.page, g.g, min(l.k) AS k, arg_min(l.href, l.k) AS href FROM g JOIN l ON g.doc_id = l.doc_id AND g.page = l.page AND (g.x0 + g.x1) / 2 BETWEEN l.x0 - 1 AND l.x1 + 1 AND (g.y0 + g.y1) / 2 BETWEEN l.y0 - 1 AND l.y1 + 1 GROUP BY ALL)"


@query(f"WITH g AS ({_GLYPHS.select()}), l AS ({_LINKS.select()}), {_HITS} SELECT * FROM h")
def link_hits(spark, sf_dir):
    return SP.link_hits(_GLYPHS.df(spark), _LINKS.df(spark))


_VRUNS = Rows("doc_id long, page int, run int, vertical boolean, size double, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, True, 10.0, 320.0, 0.0, 330.0, 100.0), (1, 1, 1, True, 10.0, 336.0, 0.0, 346.0, 100.0), (1, 1, 2, False, 10.0, 311.0, 0.0, 315.0, 100.0))


_MISSED = """m AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = l.doc_id AND h.page = l.page AND h.k = l.k)),
n AS (SELECT m.doc_id, m.page, m.k, m.href, m.y0, m.y1, v.run, row_number() OVER (PARTITION BY m.doc_id, m.page, m.k ORDER BY abs((v.x0 + v.x1) / 2 - (m.x0 + m.x1) / 2), v.run) AS turn FROM m JOIN v ON v.doc_id = m.doc_id AND v.page = m.page AND v.vertical
 AND greatest(0, least(m.y1, v.y1) - greatest(m.y0, v.y0)) >= 0.6 * (m.y1 - m.y0) AND abs((v.x0 + v.x1) / 2 - (m.x0 + m.x1) / 2) <= 3 * v.size)"""
#: The last two have the address of one that hit, and the stretch of a column of which the first has a part.
_MORE_LINKS = Rows(_LINKS.schema, *_LINKS.rows, (1, 1, 3, 300.0, 40.0, 310.0, 95.0, "a"), (1, 1, 4, 900.0, 0.0, 910.0, 100.0, "a"))
_VGLYPHS = Rows("doc_id long, page int, g int, run int, c string, x0 double, y0 double, x1 double, y1 double", *[(d, p, g, 9, c, x0, y0, x1, y1) for d, p, g, c, x0, y0, x1, y1 in _GLYPHS.rows], *[(1, 1, 100 + i, 0, "字", 320.0, 10.0 * i, 330.0, 10.0 * i + 10) for i in range(10)])


@query(f"WITH g AS ({_GLYPHS.select()}), l AS ({_MORE_LINKS.select()}), v AS ({_VRUNS.select()}), {_HITS}, {_MISSED} SELECT doc_id, page, k, href, run, y0, y1 FROM n WHERE turn = 1")
def link_columns(spark, sf_dir):
    links = _MORE_LINKS.df(spark)
    return SP.link_columns(_VRUNS.df(spark), links, SP.link_hits(_GLYPHS.df(spark), links))


@query(
    f"""WITH g AS ({_VGLYPHS.select()}), l AS ({_MORE_LINKS.select()}), v AS ({_VRUNS.select()}), {_HITS}, {_MISSED},
c AS (SELECT g.doc_id, g.page, g.g, min(n.k) AS k, arg_min(n.href, n.k) AS href FROM g JOIN n ON n.doc_id = g.doc_id AND n.page = g.page AND n.run = g.run AND turn = 1 AND (g.y0 + g.y1) / 2 BETWEEN n.y0 - 1 AND n.y1 + 1 GROUP BY ALL)
SELECT * FROM h UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = c.doc_id AND h.page = c.page AND h.g = c.g)"""
)
def linked_glyphs(spark, sf_dir):
    return SP.linked_glyphs(_VGLYPHS.df(spark), _VRUNS.df(spark), _MORE_LINKS.df(spark))


_BOXES = Rows("doc_id long, page int, x0 double, y0 double, x1 double, y1 double", (1, 1, 50.0, 95.0, 66.0, 112.0), (2, 1, 74.0, 299.0, 200.0, 312.0), (3, 1, 0.0, 0.0, 999.0, 999.0))


@query(f"WITH g AS ({_GLYPHS.select()}), b AS ({_BOXES.select()}) SELECT doc_id, page, g, c FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = g.doc_id AND b.page = g.page AND (g.x0 + g.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (g.y0 + g.y1) / 2 BETWEEN b.y0 - 1 AND b.y1 + 1)")
def table_strip(spark, sf_dir):
    return SP.strip_boxes(_GLYPHS.df(spark), _BOXES.df(spark)).select("doc_id", "page", "g", "c")


_RUBY = Rows("doc_id long, page int, run int, text string, size double, vertical boolean, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, "吾輩は", 10.0, False, 50.0, 100.0, 80.0, 110.0), (1, 1, 1, "わがはい", 5.0, False, 50.0, 94.0, 70.0, 99.0), (1, 1, 2, "note 1", 5.0, False, 50.0, 94.0, 70.0, 99.0), (2, 1, 0, "猫である", 12.0, True, 100.0, 50.0, 112.0, 98.0), (2, 1, 1, "ねこ", 6.0, True, 112.5, 50.0, 118.5, 62.0), (3, 1, 0, "國", 10.0, False, 0.0, 100.0, 10.0, 110.0), (3, 1, 1, "ㄍㄨㄛ", 5.0, False, 200.0, 94.0, 210.0, 99.0), (4, 1, 0, "愚公山", 10.0, False, 0.0, 100.0, 30.0, 110.0), (4, 1, 1, "ㄩˊ ㄍㄨㄥ", 5.0, False, 0.0, 94.0, 30.0, 99.0))


@query("SELECT * FROM (VALUES (1, 1, 1, 0, 0, 1), (1, 1, 2, 0, 0, 0), (2, 1, 1, 0, 0, 0), (4, 1, 1, 0, 0, 0), (4, 1, 1, 0, 1, 2)) t(doc_id, page, ruby_run, base_run, lo, hi)", long="doc_id")
def ruby_attach(spark, sf_dir):
    return SP.attach_ruby(_RUBY.df(spark), 10.0)


_RUNS = Rows("doc_id long, page int, block int, run int, vertical boolean, size double, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, 0, False, 10.0, 50.0, 100.0, 200.0, 110.0), (1, 1, 0, 1, False, 10.0, 50.0, 114.0, 200.0, 124.0), (1, 1, 0, 2, False, 10.0, 300.0, 100.0, 400.0, 110.0), (1, 1, 0, 3, False, 10.0, 50.0, 200.0, 200.0, 210.0), (1, 1, 0, 4, False, 10.0, 300.0, 130.0, 400.0, 140.0), (1, 1, 0, 5, True, 10.0, 50.0, 100.0, 60.0, 300.0))


@query("SELECT * FROM (VALUES (1, 1, 0, 0, 0), (1, 1, 0, 1, 0), (1, 1, 0, 2, 2), (1, 1, 0, 3, 3), (1, 1, 0, 4, 2), (1, 1, 0, 5, 5)) t(doc_id, page, block, run, cluster)", long="doc_id")
def run_clusters(spark, sf_dir):
    return SP.clusters(_RUNS.df(spark))


_BASE = Rows("doc_id long, page int, run int, text string, size double, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, "one", 10.0, 50.0, 100.0, 65.0, 110.0), (1, 1, 1, "two", 10.0, 70.0, 101.0, 85.0, 111.0), (1, 1, 2, "far", 10.0, 200.0, 100.0, 215.0, 110.0), (1, 1, 3, "next", 10.0, 50.0, 114.0, 70.0, 124.0))


@query("SELECT * FROM (VALUES (1, 1, 0, 'one two', 50.0, 100.0, 85.0, 111.0), (1, 1, 1, 'far', 200.0, 100.0, 215.0, 110.0), (1, 1, 2, 'next', 50.0, 114.0, 70.0, 124.0)) t(doc_id, page, part, text, x0, y0, x1, y1)".replace(".0,", ".0::DOUBLE,").replace(".0)", ".0::DOUBLE)"), long="doc_id")
def baseline_merge(spark, sf_dir):
    return SP.merge_baselines(_BASE.df(spark))


_PLACED = Rows("doc_id long, page int, p int, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, 10.0, 10.0, 50.0, 50.0), (1, 1, 1, 100.0, 10.0, 150.0, 50.0))
_XREFS = Rows("doc_id long, page int, k int, xref int, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, 7, 11.0, 9.0, 51.0, 50.5), (1, 1, 1, 8, 10.0, 10.0, 50.0, 50.0), (1, 1, 2, 9, 100.0, 10.0, 153.0, 50.0))


@query("SELECT 1 AS doc_id, 1 AS page, 0 AS p, 7 AS xref", long="doc_id")
def image_xref(spark, sf_dir):
    return SP.image_references(_PLACED.df(spark), _XREFS.df(spark))


_MARKS = Rows("doc_id long, page int, idx int, x double, y double, tolerance double, vertical boolean", (1, 1, 0, 60.0, 105.0, 10.0, False), (1, 1, 1, 10.0, 150.0, 10.0, False), (1, 1, 2, 10.0, 900.0, 10.0, False), (1, 2, 3, 0.0, 0.0, 10.0, False), (1, 1, 4, None, None, 10.0, False), (1, 1, 5, 45.0, 900.0, 10.0, True))
_UNITS = Rows("doc_id long, page int, ord int, x0 double, y0 double, x1 double, y1 double", (1, 1, 0, 50.0, 50.0, 200.0, 90.0), (1, 1, 1, 50.0, 100.0, 200.0, 120.0), (1, 1, 2, 50.0, 160.0, 200.0, 190.0))


@query("SELECT * FROM (VALUES (1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, -1), (1, 4, 0), (1, 5, 0)) t(doc_id, idx, ord)", long="doc_id")
def bookmark_units(spark, sf_dir):
    return SP.bookmark_units(_MARKS.df(spark), _UNITS.df(spark)).fillna(-1, ["ord"])


_IMAGES = Rows("id long, x0 double, y0 double, x1 double, y1 double, w int, h int, page_area double, page_chars int, want boolean", (1, 0.0, 0.0, 100.0, 100.0, 50, 50, 1e5, 0, True), (2, 0.0, 0.0, 3.0, 100.0, 50, 50, 1e5, 0, False), (3, 0.0, 0.0, 100.0, 100.0, 3, 50, 1e5, 0, False), (4, 0.0, 0.0, 300.0, 300.0, 50, 50, 1e5, 200, False), (5, 0.0, 0.0, 300.0, 300.0, 50, 50, 1e5, 199, True))


@query(f"SELECT id FROM {_IMAGES.sql} WHERE want")
def image_admission(spark, sf_dir):
    return L.admitted_images(_IMAGES.df(spark)).select("id")


_DRAWN = Rows("doc_id long, page int, k int, x0 double, y0 double, x1 double, y1 double, page_area double", (1, 1, 0, 0.0, 0.0, 100.0, 100.0, 1e5), (1, 1, 1, 0.0, 0.0, 19.0, 400.0, 1e5), (1, 1, 2, 200.0, 0.0, 300.0, 100.0, 1e5), (1, 1, 3, 0.0, 200.0, 100.0, 300.0, 1e5))
_TABLES = Rows("doc_id long, page int, x0 double, y0 double, x1 double, y1 double", (1, 1, 240.0, 0.0, 300.0, 100.0))
_CENTRES = Rows("doc_id long, page int, cx double, cy double", *[(1, 1, 10.0 + i, 250.0) for i in range(13)], (1, 1, 50.0, 50.0))


@query("SELECT 1 AS doc_id, 1 AS page, 0 AS k", long="doc_id")
def drawing_admission(spark, sf_dir):
    return L.admitted_drawings(_DRAWN.df(spark), _TABLES.df(spark), _CENTRES.df(spark)).select("doc_id", "page", "k")


_CELLS = Rows("doc_id long, page int, k int, r int, c int, text string", *[(1, 1, 0, r, c, "x") for r in range(3) for c in range(2)], *[(1, 1, 1, 0, c, "x") for c in range(3)], *[(1, 1, 2, r, c, " ") for r in range(2) for c in range(2)], (1, 1, 3, 0, 0, "a"), (1, 1, 3, 0, 1, ""), (1, 1, 3, 1, 0, "b"), (1, 1, 3, 1, 1, "c"))


@query("SELECT * FROM (VALUES (1, 1, 0, 3, 2, true), (1, 1, 3, 2, 2, false)) t(doc_id, page, k, n_rows, n_cols, header)", long="doc_id")
def table_admission(spark, sf_dir):
    return L.admitted_tables(_CELLS.df(spark))


_ORDER = Rows(
    "doc_id long, page int, tag string, x0 double, y0 double, x1 double, y1 double, vertical boolean, body double",
    (1, 1, "H", 50.0, 50.0, 350.0, 70.0, False, 10.0),
    *[row for i in range(5) for row in ((1, 1, f"R{i}", 210.0, 100.0 + 14 * i, 350.0, 112.0 + 14 * i, False, 10.0), (1, 1, f"L{i}", 50.0, 100.0 + 14 * i, 190.0, 112.0 + 14 * i, False, 10.0))],
    *[(2, 1, f"C{i}", 300.0 - 20 * i, 50.0, 312.0 - 20 * i, 400.0, True, 12.0) for i in reversed(range(4))],
    *[(3, 1, f"B{i}", 300.0 - 20 * i, 240.0, 312.0 - 20 * i, 400.0, True, 12.0) for i in range(3)],
    *[(3, 1, f"T{i}", 300.0 - 20 * i, 50.0, 312.0 - 20 * i, 200.0, True, 12.0) for i in range(3)],
)
_READ = [(d, i, t) for d, tags in ((1, ["H"] + [f"L{i}" for i in range(5)] + [f"R{i}" for i in range(5)]), (2, [f"C{i}" for i in range(4)]), (3, [f"T{i}" for i in range(3)] + [f"B{i}" for i in range(3)])) for i, t in enumerate(tags)]


@query(f"SELECT * FROM {Rows('doc_id long, ord int, tag string', *_READ).sql}")
def reading_order(spark, sf_dir):
    return ST.reading_order(_ORDER.df(spark)).select("doc_id", "ord", "tag")


_LINES = Rows("doc_id long, unit int, line int, text string, indented boolean", (1, 0, 0, "First line", True), (1, 0, 1, "goes on.", False), (1, 0, 2, "Second", True), (1, 0, 3, "Third", True), (2, 0, 0, "「猫」", False), (2, 0, 1, "「犬」", False), (2, 0, 2, "続き", False))


@query("SELECT * FROM (VALUES (1, 0, 0, 0), (1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 3, 1), (2, 0, 0, 0), (2, 0, 1, 1), (2, 0, 2, 1)) t(doc_id, unit, line, para)", long="doc_id")
def paragraph_breaks(spark, sf_dir):
    return ST.paragraph_breaks(_LINES.df(spark)).select("doc_id", "unit", "line", F.col("para").cast("int").alias("para"))


_FLOW = Rows(
    "doc_id long, page int, ord int, kind string, text string, nchars int, size double, body double, n_runs int, heading boolean, ladder_level int, toc_level int, has_toc boolean, indented boolean, full boolean, align string, vertical boolean, gap double",
    (1, 1, 0, "text", "Chapter One", 11, 18.0, 10.0, 1, True, 1, None, False, False, False, None, False, 0.0),
    (1, 1, 1, "text", "A paragraph that", 16, 10.0, 10.0, 1, False, 4, None, False, True, True, None, False, 5.0),
    (1, 2, 0, "text", "goes over the page.", 19, 10.0, 10.0, 1, False, 4, None, False, False, False, None, False, 0.0),
    (1, 2, 1, "text", "Another.", 8, 8.0, 10.0, 1, False, 4, None, False, True, False, None, False, 4.0),
    (1, 2, 2, "image", "", 0, 10.0, 10.0, 0, False, 4, None, False, False, False, None, False, 4.0),
    (1, 2, 3, "text", "（了）", 3, 10.0, 10.0, 1, False, 4, None, False, False, False, "center", False, 4.0),
    (1, 3, 0, "text", "Chapter Two", 11, 18.0, 10.0, 1, True, 1, None, False, False, False, None, False, 0.0),
    (1, 3, 1, "text", "Last.", 5, 10.0, 10.0, 1, False, 4, None, False, False, False, None, False, 4.0),
)
_PARAS = Rows("doc_id long, chapter int, para int, kind string, level int, page int, classes string, text string", (1, 0, 0, "h", 1, 1, "", "Chapter One"), (1, 0, 1, "p", 0, 1, "indent", "A paragraph that goes over the page."), (1, 0, 2, "p", 0, 2, "indent small", "Another."), (1, 0, 3, "image", 0, 2, "", ""), (1, 0, 4, "p", 0, 2, "center", "（了）"), (1, 1, 5, "h", 1, 3, "", "Chapter Two"), (1, 1, 6, "p", 0, 3, "noindent", "Last."))


@query(f"SELECT * FROM {_PARAS.sql}")
def paragraphs(spark, sf_dir):
    return ST.build_paragraphs(_FLOW.df(spark))


_MARKED = Rows(_PARAS.schema, *_PARAS.rows, *[(2, i, i, "h", 1 + i, i, "", f"H{i}") for i in range(4)], (3, 0, 0, "p", 0, 1, "indent", "x"), (3, 1, 1, "image", 0, 2, "", ""), (4, 0, 0, "h", 3, 1, "", "deep"), (4, 0, 1, "h", 2, 1, "", "less"))
_BOOKMARKS = Rows("doc_id long, idx long, level int", (2, 0, 3), (2, 1, 1), (2, 2, 4), (2, 3, 4), (2, 4, 2))


@query(
    f"""WITH p AS ({_MARKED.select()}), b AS ({_BOOKMARKS.select()}),
l AS (SELECT doc_id, idx AS place, level FROM b UNION ALL SELECT doc_id, para, level FROM p WHERE kind = 'h' AND level <= 2 AND doc_id NOT IN (SELECT doc_id FROM b)),
e AS (SELECT * FROM l UNION ALL SELECT DISTINCT doc_id, chapter, 1 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM l)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM e),
t AS (WITH RECURSIVE t(doc_id, i, now) AS (SELECT doc_id, i, 1 FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, least(o.level, t.now + 1) FROM t JOIN o ON o.doc_id = t.doc_id AND o.i = t.i + 1) SELECT * FROM t)
SELECT p.doc_id, count(DISTINCT chapter) AS n_chapters, count(*) FILTER (WHERE kind = 'image') AS n_images, (SELECT max(level) FROM e WHERE e.doc_id = p.doc_id) AS depth, (SELECT max(now) FROM t WHERE t.doc_id = p.doc_id)::INT AS tree_depth FROM p GROUP BY p.doc_id"""
)
def result_counts(spark, sf_dir):
    return ST.result_counts(_MARKED.df(spark), _BOOKMARKS.df(spark))


@query(f"SELECT doc_id, count(*) FILTER (WHERE kind = 'p' AND list_contains(string_split(classes, ' '), 'indent')) AS indent, count(*) FILTER (WHERE kind = 'p' AND list_contains(string_split(classes, ' '), 'noindent')) AS noindent, indent > noindent AS all_indent FROM {_MARKED.sql} GROUP BY doc_id HAVING bool_or(kind = 'p')")
def indent_votes(spark, sf_dir):
    return ST.indent_vote(_MARKED.df(spark))


_EDGES = Rows("id long, edge double, margin double, indented boolean, whole boolean", (1, 60.0, 50.0, True, True), (2, 55.0, 50.0, False, True), (3, 90.0, 50.0, False, True), (4, 40.0, 50.0, False, False), (5, 41.0, 50.0, False, True), (6, 10.0, None, False, True))


@query(f"SELECT id, indented, whole FROM {_EDGES.sql}")
def indents(spark, sf_dir):
    e, m = F.col("edge"), F.col("margin")
    return _EDGES.df(spark).select("id", ST.is_indented(e, m, F.lit(10.0)).alias("indented"), ST.is_full(e, m, F.lit(10.0)).alias("whole"))


_ALIGN = Rows("id long, a double, b double, want string", (1, 100.0, 102.0, "center"), (2, 200.0, 4.0, "right"), (3, 0.0, 200.0, "none"), (4, 100.0, 160.0, "none"))


@query(f"SELECT id, want AS align FROM {_ALIGN.sql}")
def alignments(spark, sf_dir):
    return _ALIGN.df(spark).select("id", F.coalesce(ST.alignment(F.col("a"), F.col("b"), F.lit(10.0), F.lit(300.0)), F.lit("none")).alias("align"))


_INK = Rows(
    "doc_id long, para int, pos int, c string, link string, bold boolean, italic boolean, sup boolean, mono boolean, ruby_id int, ruby string",
    *[(1, 0, i, c, "https://x.y/?a=1&b=2" if i > 2 else None, i < 2, i > 2, False, False, None, None) for i, c in enumerate("ab cd")],
    *[(2, 0, i, c, None, False, False, False, False, 0 if i < 2 else None, "わがはい" if i < 2 else None) for i, c in enumerate("吾輩は")],
    *[(3, 0, i, c, None, False, False, False, False, None, None) for i, c in enumerate("a<b&c")],
    *[(4, 0, i, c, None, True, False, False, False, None, None) for i, c in enumerate("Title")],
    *[(5, 0, i, c, None, False, False, i == 1, i == 2, None, None) for i, c in enumerate("x2c  y")],
)
_HTML = Rows("doc_id long, html string", (1, '<strong>ab</strong> <a href="https://x.y/?a=1&amp;b=2"><em>cd</em></a>'), (2, "<ruby>吾輩<rt>わがはい</rt></ruby>は"), (3, "a&lt;b&amp;c"), (4, "Title"), (5, "x<sup>2</sup><code>c</code> y"))


@query(f"SELECT doc_id, 0 AS para, html FROM {_HTML.sql}")
def inline_html(spark, sf_dir):
    return ST.inline_html(_INK.df(spark))


_BLOCKS = Rows(
    "id long, kind string, level int, ids array<string>, classes array<string>, body string, image string, width int, want string",
    (1, "p", 0, ["pg1", "t2"], ["indent", "small"], "x", None, None, '<p id="pg1" class="small"><span id="t2"></span>x</p>'),
    (2, "h", 2, [], ["center"], "T", None, None, '<h2 class="center">T</h2>'),
    (3, "image", 0, ["a"], [], None, "i.png", 120, '<div class="figure" id="a"><img src="../images/i.png" alt="" width="120"/></div>'),
    (4, "table", 0, [], [], "<table/>", None, None, '<div class="tablewrap"><table/></div>'),
    (5, "p", 0, ["a"], [], " ", None, None, ""),
    (6, "p", 0, ["a", "b"], [], " ", None, None, '<p id="a"><span id="b"></span></p>'),
)


@query(f"SELECT id, want AS html FROM {_BLOCKS.sql}")
def paragraph_html(spark, sf_dir):
    c = F.col
    return _BLOCKS.df(spark).select("id", ST.paragraph_html(c("kind"), c("level"), c("ids"), c("classes"), c("body"), c("image"), c("width"), F.lit(True)).alias("html"))


_LEVELS = Rows("id long, levels array<int>, want string", (1, [1, 2, 3], "1,2,3"), (2, [3, 3, 1, 4], "1,2,1,2"), (3, [2, 1], "1,1"), (4, [], ""))


@query(f"SELECT id, want AS levels FROM {_LEVELS.sql}")
def nav_levels(spark, sf_dir):
    return _LEVELS.df(spark).select("id", F.array_join(ST.clamped_levels(F.col("levels")).cast("array<string>"), ",").alias("levels"))


_TOC = Rows("doc_id long, idx long, page1 int", (1, 0, 1), (1, 1, 3), (1, 2, 4), (1, 3, 99))
_OWN = Rows("doc_id long, idx long, href string", (1, 1, "c2.xhtml#toc1"))
_STARTS = Rows("doc_id long, page int, href string", (1, 1, "c1.xhtml"), (1, 3, "c2.xhtml"), (1, 6, "c3.xhtml"))


@query("SELECT * FROM (VALUES (1, 0, 'c1.xhtml'), (1, 1, 'c2.xhtml#toc1'), (1, 2, 'c3.xhtml'), (1, 3, 'c1.xhtml')) t(doc_id, idx, href)", long="doc_id idx")
def nav_targets(spark, sf_dir):
    return ST.navigation_targets(_TOC.df(spark), _OWN.df(spark), _STARTS.df(spark))


_OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> </dc:title><dc:title> {title} </dc:title><dc:language>{lang}</dc:language>{meta}</metadata><manifest>{items}</manifest><spine{way}>{refs}</spine><spine page-progression-direction="rtl"><itemref idref="other"/></spine></package>"""
_DRM = '<encryption xmlns:enc="http://www.w3.org/2001/04/xmlenc#">{}</encryption>'
_METHOD = '<enc:EncryptedData><enc:EncryptionMethod Algorithm="{}"/></enc:EncryptedData>'
_PACKAGES = Rows(
    "doc_id long, opf_xml string, container_xml string, encryption_xml string",
    (1, _OPF.format(title="One", lang="en", meta='<meta property="rendition:layout">pre-paginated</meta>', items='<item id="a" href="a.xhtml"/><item id="i" href="i.png" media-type="image/png" properties="svg cover-image"/>', way=' page-progression-direction="ltr"', refs='<itemref idref="a"/><itemref idref="b"/>'), '<container><rootfiles><rootfile full-path=""/><rootfile full-path="OEBPS/x.opf"/></rootfiles></container>', None),
    (2, _OPF.format(title="Two", lang="ja", meta='<meta name="cover" content="c"/>', items='<item id="c" href="c.jpg"/>', way="", refs='<itemref idref="z"/>'), "<container/>", _DRM.format(_METHOD.format("http://www.idpf.org/2008/embedding"))),
    (3, _OPF.format(title=" ", lang=" ", meta="", items='<item id="x" href="MyCover.JPG" media-type="image/jpeg"/>', way=' page-progression-direction="default"', refs=""), "<container/>", _DRM.format(_METHOD.format("http://ns.adobe.com/pdf/enc#RC") + _METHOD.format("http://www.w3.org/2001/04/xmlenc#aes128-cbc"))),
)


@query("SELECT * FROM (VALUES (1, 'OEBPS/x.opf', 'One', 'en', true, 'ltr'), (2, '', 'Two', 'ja', false, 'rtl'), (3, '', 'stem', '', false, 'rtl')) t(doc_id, opf, title, language, fixed, direction)", long="doc_id")
def opf_metadata(spark, sf_dir):
    x = F.col("opf_xml")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return _PACKAGES.df(spark).select("doc_id", blank(P.opf_path(F.col("container_xml"))).alias("opf"), P.title(x, F.lit("stem")).alias("title"), blank(P.language(x)).alias("language"), P.is_fixed_layout(x).alias("fixed"), blank(P.page_direction(x)).alias("direction"))


@query("SELECT * FROM (VALUES (1, 0, 'a'), (1, 1, 'b'), (2, 0, 'z')) t(doc_id, pos, idref)", long="doc_id")
def opf_spine(spark, sf_dir):
    return P.spine(_PACKAGES.df(spark))


@query("SELECT * FROM (VALUES (1, 'i.png'), (2, 'c.jpg'), (3, 'MyCover.JPG')) t(doc_id, cover)", long="doc_id")
def opf_cover(spark, sf_dir):
    return _PACKAGES.df(spark).select("doc_id", P.cover_href(F.col("opf_xml")).alias("cover"))


@query("SELECT * FROM (VALUES (1, false), (2, false), (3, true)) t(doc_id, drm)", long="doc_id")
def drm_check(spark, sf_dir):
    return _PACKAGES.df(spark).select("doc_id", P.is_protected(F.col("encryption_xml")).alias("drm"))


_HEADS = Rows("id long, head string, password boolean, pages int, mimetype string, container string, pdf string, epub string", (1, "%PDF-1.7", False, 3, "application/epub+zip", "c", "ok", "not a zip archive"), (2, "junk %PDF", True, 3, None, "c", "password-protected", "not a zip archive"), (3, "%PDF", False, 0, "", "c", "no pages", "not a zip archive"), (4, "PK\u0003\u0004", False, 1, "text/plain", "c", "not a valid PDF", "wrong mimetype"), (5, "PK\u0003\u0004", False, 1, "application/epub+zip ", None, "not a valid PDF", "missing container"), (6, "PK\u0003\u0004", False, 1, "", "c", "not a valid PDF", "ok"))


@query(f"SELECT id, pdf, epub FROM {_HEADS.sql}")
def file_verdicts(spark, sf_dir):
    head = F.col("head").cast("binary")
    return _HEADS.df(spark).select("id", P.pdf_verdict(head, F.col("password"), F.col("pages")).alias("pdf"), P.package_verdict(head, F.col("mimetype"), F.col("container"), F.lit(None).cast("string")).alias("epub"))


_COVERS = Rows("id long, w int, h int, ext string, mode string, page int, chars int, share double, want string", (1, 400, 601, ".png", "RGBA", 1, 0, 0.9, "200x300.png1"), (2, 100, 50, ".jpeg", "RGB", 1, 50, 0.9, "100x50.jpg0"), (3, 1000, 2, ".svg", "RGB", 1, 0, 0.7, "200x1as is1"), (4, 201, 100, ".jpg", "P", 2, 0, 0.9, "200x99.png0"))


@query(f"SELECT id, want AS cover FROM {_COVERS.sql}")
def cover_thumbnails(spark, sf_dir):
    w, h = P.thumbnail_size(F.col("w"), F.col("h"))
    return _COVERS.df(spark).select("id", F.concat(w.cast("string"), F.lit("x"), h.cast("string"), P.thumbnail_format(F.col("ext"), F.col("mode")), P.is_cover(F.col("page"), F.col("chars"), F.col("share"), F.col("w")).cast("int").cast("string")).alias("cover"))


_TITLES = Rows("id long, title string, name string, want string, way string, media string, safe boolean", (1, " My Book ", "a.pdf", "My Book", "pdf-to-epub", "application/pdf", True), (2, "Untitled", "b.epub", "stem", "epub-to-pdf", "application/epub+zip", True), (3, "Microsoft Word - x", "../c.PDF", "stem", "pdf-to-epub", "application/pdf", False), (4, "draft.docx", "", "stem", "epub-to-pdf", "application/octet-stream", False), (5, None, "..", "stem", "epub-to-pdf", "application/octet-stream", False), (6, "doc.html about", "x/y.epub", "doc.html about", "epub-to-pdf", "application/epub+zip", False))


@query(f"SELECT id, want AS title, way, media, safe FROM {_TITLES.sql}")
def titles_and_names(spark, sf_dir):
    n = F.col("name")
    return _TITLES.df(spark).select("id", T.clean_title(F.col("title"), F.lit("stem")).alias("title"), T.direction_for(n).alias("way"), T.media_type(n).alias("media"), T.is_safe_member(n).alias("safe"))


_MAIL = Rows("id long, email string, allowed string, want boolean", (1, "A@x.y", " a@x.y , b@x.y", True), (2, "c@x.y", "a@x.y", False), (3, "a@x.y", "", False), (4, None, "a@x.y", False))


@query(f"SELECT id, want AS allowed FROM {_MAIL.sql}")
def allow_list(spark, sf_dir):
    return _MAIL.df(spark).select("id", T.is_allowed(F.col("email"), F.col("allowed")).alias("allowed"))


_RENDER = Rows("id long, browser string, size string, fixed boolean, way string, want string", (1, None, "A5", False, "rtl", "vivliostyle build a.epub -o a.pdf --timeout 300 -s A5 --reading-progression rtl"), (2, "/c", "A5", True, None, "vivliostyle build a.epub -o a.pdf --timeout 300 --executable-browser /c"), (3, "", "", False, "ttb", "vivliostyle build a.epub -o a.pdf --timeout 300"))


@query(f"SELECT id, want AS command FROM {_RENDER.sql}")
def render_commands(spark, sf_dir):
    c = F.col
    return _RENDER.df(spark).select("id", F.array_join(T.render_command(F.lit("a.epub"), F.lit("a.pdf"), F.lit(300), c("browser"), c("size"), c("fixed"), c("way")), " ").alias("command"))


def _css_sql() -> str:
    """The whole text by the rules' list: what depends on the book is put in by SQL."""
    join = lambda rules: "\n".join(rules).replace("'", "''")
    p = "CASE WHEN indent THEN 'p { margin: 0; text-indent: ' || i || '; }' ELSE 'p { margin: 0 0 0.8em 0; text-indent: 0; }' END"
    text = f"replace(replace('{join(P._RULES)}', '{{p}}', {p}), '{{indent}}', i) || CASE WHEN vertical THEN chr(10) || '{join(P._VERTICAL)}' ELSE '' END || chr(10) || '{join(P._COVER)}' || chr(10)"
    return f"SELECT id, {text} AS css FROM (SELECT *, CASE WHEN starts_with(lang, 'zh') THEN '2em' ELSE '1em' END AS i FROM {_CSS.sql})"


_CSS = Rows("id long, vertical boolean, lang string, indent boolean", (1, False, "en", False), (2, True, "zh-TW", True), (3, False, "ja", True), (4, True, "zh", False))


@query(_css_sql())
def stylesheets(spark, sf_dir):
    return _CSS.df(spark).select("id", P.stylesheet(F.col("vertical"), F.col("lang"), F.col("indent")).alias("css"))


_TRIES = Rows("doc_id long, chunk int, attempt int, ok boolean, message string", (1, 0, 1, False, "timeout"), (1, 0, 2, True, ""), (1, 1, 1, False, "Protected by DRM"), (1, 1, 2, True, ""), (2, 0, 1, False, "timeout"), (2, 0, 2, False, "timeout"), (2, 0, 3, False, "crash"))


@query("SELECT * FROM (VALUES (1, 0, true, 2, ''), (1, 1, false, 1, 'Protected by DRM'), (2, 0, false, 3, 'crash')) t(doc_id, chunk, ok, attempts, message)", long="doc_id")
def retry_outcomes(spark, sf_dir):
    return C.retry_outcomes(_TRIES.df(spark))


_PARTS = Rows("doc_id long, unit int, ocred int, failed int, clean int", (1, 0, 1, 0, 0), (1, 1, 0, 1, 0), (2, 0, 1, 0, 0), (3, 0, 0, 1, 1), (4, 0, 0, 0, 1))


@query(f"SELECT doc_id, sum(ocred)::BIGINT AS ocred, sum(failed)::BIGINT AS failed, sum(clean)::BIGINT AS clean, CASE doc_id WHEN 1 THEN 'text layer partially rebuilt via OCR; 1 section(s) may remain unselectable' WHEN 2 THEN 'text layer rebuilt via OCR' WHEN 3 THEN 'OCR attempted but failed; text layer may be unusable' ELSE '' END AS note FROM {_PARTS.sql} GROUP BY doc_id")
def ocr_outcomes(spark, sf_dir):
    return C.recognition_outcomes(_PARTS.df(spark)).fillna("", ["note"])


_FILES = Rows("name string, bytes long, mtime long", ("a.pdf", 2048, 30), ("b.epub", 100, 40), ("c.x.pdf", 3 << 20, 30), ("d.pdf", 1, 10))
_SIDE = Rows("base string, json string", ("a", '{"title": "Alpha", "cover": "a.png", "ocr_note": "n"}'), ("b", "not json"), ("c.x", '{"cover": "gone.png"}'))
_COVER_FILES = Rows("name string", ("a.png",))


@query("SELECT * FROM (VALUES ('b.epub', 'b', 'epub', '100 B', 40, '', ''), ('a.pdf', 'Alpha', 'pdf', '2.0 KB', 30, 'a.png', 'n'), ('c.x.pdf', 'c.x', 'pdf', '3.0 MB', 30, '', '')) t(name, title, format, size, mtime, cover, note)", long="mtime")
def list_books(spark, sf_dir):
    return C.list_books(_FILES.df(spark), _SIDE.df(spark), _COVER_FILES.df(spark), 3).fillna("", ["cover", "note"])


_WANTED = Rows("id long, name string, want string", (1, "a.pdf", "a (2).pdf"), (2, "a.pdf", "a (4).pdf"), (3, "a (3).pdf", "a (3) (2).pdf"), (4, "a (2).pdf", "a (2) (2).pdf"), (5, "a.epub", "a.epub"), (6, "b", "b"), (7, "b", "b (2)"), (8, "b (2)", "b (2) (2)"), (9, "a (5).pdf", "a (5).pdf"), (10, "a.pdf", "a (6).pdf"))
_TAKEN = Rows("name string", ("a.pdf",), ("a (3).pdf",), ("c.pdf",))


@query(f'SELECT id, name, want AS "unique" FROM {_WANTED.sql}')
def unique_names_taken(spark, sf_dir):
    """Names that others have, or that look like numbered ones."""
    return C.unique_names(_WANTED.df(spark), _TAKEN.df(spark))


_ASKED_BOOKS = Rows("asked string", ("a.pdf",), ("b.epub",), ("../a.pdf",), ("x/a.pdf",), ("a.png",), ("gone.pdf",), ("..",), ("",))


@query("SELECT * FROM (VALUES ('a.pdf', 2048), ('b.epub', 100)) t(name, bytes)", long="bytes")
def book_lookup(spark, sf_dir):
    return C.book_lookup(_FILES.df(spark), _ASKED_BOOKS.df(spark)).select("name", "bytes")


_ASK = Rows("slot int, job_id long, start double, end double", (0, 1, 0.0, 10.0), (0, 2, 5.0, 30.0), (0, 3, 10.0, 12.0), (0, 4, 11.0, 13.0), (0, 5, 12.0, 13.0))


@query("SELECT * FROM (VALUES (0, 1, true), (0, 2, false), (0, 3, true), (0, 4, false), (0, 5, true)) t(slot, job_id, admitted)", long="job_id")
def job_admission(spark, sf_dir):
    return C.admitted_jobs(_ASK.df(spark))


_ENTRIES = Rows("doc_id long, ord int, name string, id string", (1, 0, "a.xhtml", "a"), (1, 1, "mimetype", ""), (1, 2, "b.xhtml", "b"), (1, 3, "style.css", "s"), (1, 4, "c.xhtml", "c"))
_SPINE = Rows("doc_id long, pos int, idref string", (1, 0, "a"), (1, 1, "b"), (1, 2, "c"))


@query("SELECT * FROM (VALUES (1, 0, 'mimetype'), (1, 1, 'a.xhtml'), (1, 3, 'b.xhtml'), (1, 4, 'style.css')) t(doc_id, ord, name)", long="doc_id")
def chunk_entries(spark, sf_dir):
    return P.chunk_entries(_ENTRIES.df(spark), _SPINE.df(spark), 0, 2).select("doc_id", "ord", "name")


_MERGE = Rows("doc_id long, chunk int, chunk_page int", (1, 1, 0), (1, 0, 0), (1, 0, 1), (2, 0, 0))


@query("SELECT * FROM (VALUES (1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 2), (2, 0, 0, 0)) t(doc_id, chunk, chunk_page, page)", long="doc_id")
def merged_pages(spark, sf_dir):
    from folio.sources.files import merged

    return merged(_MERGE.df(spark))


_STORE = Rows("id long, title string, cover string, pdf string, note string, want string", (1, "T", "t.png", "t.pdf", None, '{"title":"T","file":"f","format":"epub","cover":"t.png","pdf":"t.pdf"}'), (2, "U", None, None, "n", '{"title":"U","file":"f","format":"epub","ocr_note":"n"}'))


@query(f"SELECT id, want AS json FROM {_STORE.sql}")
def sidecars(spark, sf_dir):
    c = F.col
    return _STORE.df(spark).select("id", C.sidecar_json(c("title"), F.lit("f"), F.lit("epub"), c("cover"), c("pdf"), c("note")).alias("json"))


_SETTINGS = Rows("name string, value string", ("secret", ""), ("allowed_emails", "a@x.y"), ("client_id", "id"), ("https", "false"), ("ocr_mode", "maybe"), ("max_mb", "100"))


@query("SELECT * FROM (VALUES ('no session secret'), ('cookies without https'), ('unknown recognition mode')) t(rule)")
def config_warnings(spark, sf_dir):
    return C.config_warnings(_SETTINGS.df(spark))


_LOG = Rows("id long, log string, n int, want string", (1, "a\nb\nc\nd", 3, "b\nc\nd"), (2, "a", 3, "a"), (3, "", 3, ""))


@query(f"SELECT id, want AS tail FROM {_LOG.sql}")
def log_tails(spark, sf_dir):
    lines = F.split("log", "\n", -1)
    return _LOG.df(spark).select("id", F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - F.col("n") + 1), F.col("n")), "\n").alias("tail"))


@query("SELECT * FROM (VALUES ('d.pdf', 'd')) t(name, base)")
def catalog_delete(spark, sf_dir):
    books = _FILES.df(spark).select("name", F.regexp_replace("name", r"\.[^.]*$", "").alias("base"))
    return C.without(books, _SIDE.df(spark)).select("name", "base")


_BOOK = Rows("doc_id long, title string, lang string, vertical boolean, all_indent boolean, uid string, modified string, author string", (1, 'Tom & "Jerry" <1>', "ja", True, True, "u1", "2020-01-01T00:00:00Z", "A & B"), (2, "Bare", "", False, False, "u2", "2020-01-01T00:00:00Z", None))
_CHAPTERS = Rows("doc_id long, chapter int, title string, html string", (1, 0, "One & <two>", "<p>a</p>"), (1, 1, None, "<p>b</p>"))
_NAVIGATION = Rows("doc_id long, idx long, level int, title string, href string", (1, 0, 3, "First & last", "text/chapter0000.xhtml"), (1, 1, 2, "Under", "text/chapter0000.xhtml#a"), (1, 2, 4, " ", "text/chapter0000.xhtml#b"), (1, 3, 1, "Top", "text/chapter0001.xhtml"))
_NAV = {
    1: '<ol><li><a href="text/chapter0000.xhtml">First &amp; last</a><ol><li><a href="text/chapter0000.xhtml#a">Under</a><ol><li><a href="text/chapter0000.xhtml#b">—</a></li></ol></li></ol></li><li><a href="text/chapter0001.xhtml">Top</a></li></ol>',
    2: '<ol><li><a href="text/chapter0000.xhtml">Bare</a></li></ol>',
}


def book_entries(spark):
    images = spark.createDataFrame([(1, 0, "i.png", bytearray(b"x"))], "doc_id long, k int, name string, bytes binary")
    covers = spark.createDataFrame([(1, "cover.jpg", bytearray(b"c"))], "doc_id long, name string, bytes binary")
    return P.package_entries(_BOOK.df(spark), _CHAPTERS.df(spark), images, covers, _NAVIGATION.df(spark))


_NAMES = {
    1: [(0, "mimetype", False), (1, "META-INF/container.xml", True), (2, "OEBPS/css/book.css", True), (3, "OEBPS/images/cover.jpg", False), (4, "OEBPS/cover.xhtml", True), (10, "OEBPS/images/i.png", False), (1000000, "OEBPS/text/chapter0000.xhtml", True), (1000001, "OEBPS/text/chapter0001.xhtml", True)],
    2: [(0, "mimetype", False), (1, "META-INF/container.xml", True), (2, "OEBPS/css/book.css", True), (1000000, "OEBPS/text/chapter0000.xhtml", True)],
}
_LAST = [(9000000, "OEBPS/nav.xhtml", True), (9000001, "OEBPS/toc.ncx", True), (9000002, "OEBPS/content.opf", True)]
_PACKED = Rows("doc_id long, ord int, name string, compress boolean", *[(d, *e) for d, es in _NAMES.items() for e in es + _LAST])


@query(_PACKED.select())
def package_entries(spark, sf_dir):
    return book_entries(spark).select("doc_id", "ord", "name", "compress")


_READ_BACK = Rows(
    "doc_id long, title string, language string, direction string, cover string, spine string, nav string, points string, titles string",
    (1, 'Tom & "Jerry" <1>', "ja", "rtl", "images/cover.jpg", "cover,c0,c1", _NAV[1], "np1 np2 np3 np4", "One & <two>|Section 2"),
    (2, "Bare", "en", "", "", "c0", _NAV[2], "np1", "Bare"),
)


@query(_READ_BACK.select())
def package_texts(spark, sf_dir):
    """What the package's own documents say when they are parsed as XML: titles with signs, nesting, cover, spine and both navigations."""
    e = book_entries(spark).select("doc_id", "name", F.decode("body", "UTF-8").alias("xml"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("xml")))
    chapters = F.sort_array(F.collect_list(F.when(F.col("name").contains("/text/"), F.struct("name", "xml"))))
    b = e.where("name NOT LIKE '%/images/%'").groupBy("doc_id").agg(of("OEBPS/content.opf").alias("opf"), of("OEBPS/nav.xhtml").alias("nav"), of("OEBPS/toc.ncx").alias("ncx"), chapters.alias("cs"))
    spine = F.array_join(F.xpath("opf", F.lit("//*[local-name()='itemref']/@idref")), ",")
    heads = F.transform("cs", lambda c: F.get(F.xpath(c["xml"], F.lit("//*[local-name()='title']/text()")), 0))
    points = F.array_join(F.xpath("ncx", F.lit("//*[local-name()='navPoint']/@id")), " ")
    return b.select(
        "doc_id", P.title(F.col("opf"), F.lit("")).alias("title"), P.language(F.col("opf")).alias("language"), F.coalesce(P.page_direction(F.col("opf")), F.lit("")).alias("direction"), F.coalesce(P.cover_href(F.col("opf")), F.lit("")).alias("cover"),
        spine.alias("spine"), F.regexp_extract("nav", "(?s)</h1>\n(.*)\n</nav>", 1).alias("nav"), points.alias("points"), F.array_join(heads, "|").alias("titles"),
    )


@query("SELECT * FROM (VALUES (1, 0, 'mimetype'), (1, 10, 'OEBPS/content.opf'), (2, 0, 'mimetype')) t(doc_id, ord, entry)", long="doc_id")
def written_archive(spark, sf_dir):
    """Packages written as archives and read again: first and last entries."""
    from folio.sources.files import archive_entries, write_archives

    books = write_archives(book_entries(spark)).select(F.col("doc_id").cast("string").alias("name"), "content")
    return archive_entries(books).where("ord IN (0, 10)").select(F.col("name").cast("long").alias("doc_id"), "ord", "entry")


def sample_archives() -> list[tuple[str, bytearray]]:
    """Archives of every verdict, made here: sound, protected, of another kind, with an encrypted and with a damaged entry, and none at all."""
    import io
    import zipfile

    def packed(**files: str) -> bytes:
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in files.items():
                z.writestr(zipfile.ZipInfo({"container": "META-INF/container.xml", "encryption": "META-INF/encryption.xml"}.get(name, name), (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
        return sink.getvalue()

    good = packed(mimetype=P.MIMETYPE, container=P.CONTAINER)
    locked, at = bytearray(good), good.index(b"PK\x01\x02")
    locked[6] |= 1  # the first entry's own flags, and those in the directory
    locked[at + 8] |= 1
    broken, at = bytearray(good), good.index(b"META-INF/container.xml") + len("META-INF/container.xml")
    broken[at : at + 8] = b"\xff" * 8
    drm = _DRM.format(_METHOD.format("http://www.w3.org/2001/04/xmlenc#aes256-cbc"))
    return [
        ("good", bytearray(good)), ("bare", bytearray(packed(container=P.CONTAINER))), ("drm", bytearray(packed(mimetype=P.MIMETYPE, container=P.CONTAINER, encryption=drm))),
        ("other", bytearray(packed(mimetype="application/pdf", container=P.CONTAINER))), ("hollow", bytearray(packed(mimetype=P.MIMETYPE))),
        ("locked", locked), ("broken", broken), ("cut", bytearray(good[: len(good) // 2])), ("none", bytearray(b"%PDF-1.4")),
    ]


@query("SELECT * FROM (VALUES ('good', 'ok'), ('bare', 'ok'), ('drm', 'protected by drm'), ('other', 'wrong mimetype'), ('hollow', 'missing container'), ('locked', 'encrypted entry mimetype'), ('broken', 'damaged entry META-INF/container.xml'), ('cut', 'missing container'), ('none', 'not a zip archive')) t(name, verdict)")
def archive_verdicts(spark, sf_dir):
    from folio.sources.files import archive_verdicts as verdicts

    return verdicts(spark.createDataFrame(sample_archives(), "name string, content binary"))


@query("SELECT * FROM (VALUES ('good.epub', 'ok'), ('drm.epub', 'protected by drm'), ('none.pdf', 'not a zip archive')) t(name, verdict)")
def library_files(spark, sf_dir):
    """Books written to a folder that all executors see, listed by their extensions and read; other files there are none."""
    import uuid

    from folio.sources.files import archive_verdicts as verdicts
    from folio.sources.files import book_files

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/library-{uuid.uuid4().hex}"
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, content in sample_archives():
        if name in ("good", "drm", "none", "other"):
            out = files.create(path(f"{folder}/{name}.{dict(none='pdf', other='txt').get(name, 'epub')}"))
            out.write(content)
            out.close()
    try:
        rows = verdicts(book_files(spark, folder, content=True)).collect()
    finally:
        files.delete(path(folder), True)
    return spark.createDataFrame(rows, "name string, verdict string")
