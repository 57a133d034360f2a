"""Queries over the driver's documents: scripts, lines, pages and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import scripts as S
from folio.functions import text as T
from folio.operators import layout as L
from folio.operators import structure as ST
from folio.operators.rounds import parts_for
from folio.plans.base import Rows, query, table

#: Texts in scripts that the documents lack.
FIXTURE = Rows(
    "doc_id long, text string",
    (-1, "吾輩は猫である。名前はまだ無い。"),
    (-2, "한국의 봄은 삼월에 시작된다."),
    (-3, "這個國家的學生們說，時間會證明一切。"),
    (-4, "这个国家的学生们说，时间会证明一切。"),
    (-5, "The quick brown fox jumps over the lazy dog."),
    (-6, "中"),
    (-7, "　 \t \u001c"),
    (-8, "Привет ㄅㄆ １２ ａｂ"),
)
_DOCS = f"d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {FIXTURE.sql})"
_COUNT = "len(regexp_extract_all(text, '{0}'))"
_COUNTS = f"""c AS (SELECT doc_id, {_COUNT.format(S.HAN)} AS han, {_COUNT.format(S.KANA)} AS kana, {_COUNT.format(S.HANGUL)} AS hangul,
 len(regexp_extract_all(regexp_replace(text, '{S.CLASSED}', '', 'g'), '\\p{{L}}')) AS latin, {_COUNT.format(S.SIMPLIFIED)} AS simplified, {_COUNT.format(S.TRADITIONAL)} AS traditional,
 {_COUNT.format(S.PUA)} AS pua, length(regexp_replace(text, '{S.SPACE}', '', 'g')) AS total FROM d)"""
_GUESS = """CASE WHEN han + kana + hangul = 0 OR latin > 3 * (han + kana + hangul) THEN 'en' WHEN kana > greatest((han + kana + hangul) * 0.03::DOUBLE, 5) THEN 'ja'
 WHEN hangul > (han + kana + hangul) * 0.3::DOUBLE THEN 'ko' WHEN simplified > traditional THEN 'zh-CN' WHEN traditional > simplified THEN 'zh-TW' ELSE 'zh' END"""
_PUA = "CASE WHEN total = latin THEN 0.0::DOUBLE ELSE pua::DOUBLE / (total - latin) END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(FIXTURE.df(spark))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *S.script_counts(F.col("text")))


@query(f"WITH {_DOCS}, {_COUNTS} SELECT doc_id, han, kana, hangul, latin, simplified, traditional, pua, total, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE (han + kana + hangul)::DOUBLE / total END AS cjk_fraction FROM c")
def doc_script_stats(spark, sf_dir):
    return _counted(spark, sf_dir).withColumn("cjk_fraction", S.cjk_fraction())


@query(f"WITH {_DOCS}, {_COUNTS} SELECT doc_id, {_GUESS} AS language FROM c")
def doc_language(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", S.guess_language().alias("language"))


@query(f"WITH {_DOCS}, {_COUNTS} SELECT doc_id, {_PUA} AS pua_fraction, CASE WHEN {_PUA} < 0.1 THEN 'clean' ELSE 'pua' END AS action FROM c")
def doc_pua_ocr(spark, sf_dir):
    return _counted(spark, sf_dir).select("doc_id", S.pua_fraction().alias("pua_fraction")).withColumn("action", S.ocr_action(F.lit("auto"), F.col("pua_fraction"), F.lit(0.1)))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S.SPACE}+|{S.SPACE}+$', '', 'g')"


_ROMAN = r"'(^|[^\p{L}\p{Nd}_])[ivxlcdm]+([^\p{L}\p{Nd}_]|$)', '\1#\2', 'g'"


def _signature(x: str) -> str:
    digits = f"regexp_replace(lower({_strip(x)}), '[0-9〇一二三四五六七八九十百千]+', '#', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({digits}, {_ROMAN}), {_ROMAN}), '{S.SPACE}+', ' ', 'g')"


_BANDS = """b AS (SELECT doc_id // 12 AS book, doc_id AS page, 'top' AS place, string_split(text, chr(10))[1] AS text FROM documents
 UNION ALL SELECT doc_id // 12, doc_id, 'bottom', string_split(text, chr(10))[-1] FROM documents),
p AS (SELECT doc_id // 12 AS book, count(*) AS n_pages FROM documents GROUP BY 1)"""
_MIN = "CASE WHEN n_pages <= 2 THEN 99 ELSE greatest(3, floor(n_pages * 0.25)) END"


def _bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and last lines of twelve documents in a row as the heads and feet of a book's pages: a stand-in."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 12").alias("book"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("lines"))
    ends = F.explode(F.array(F.struct(F.lit("top").alias("place"), F.get("lines", 0).alias("text")), F.struct(F.lit("bottom").alias("place"), F.element_at("lines", -1).alias("text"))))
    return d.select("book", "page", ends.alias("e")).select("book", "page", "e.*"), d.groupBy("book").agg(F.count("*").alias("n_pages"))


@query(f"WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, {_signature('line')} AS signature FROM l")
def band_signature(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    return lines.select("line", T.band_signature(F.col("line")).alias("signature"))


_HEADS = f"h AS (SELECT book, place, signature, count(DISTINCT page) AS n FROM (SELECT book, page, place, {_signature('text')} AS signature FROM b) WHERE signature <> '' GROUP BY ALL), r AS (SELECT h.* FROM h JOIN p USING (book) WHERE n >= {_MIN})"


@query(f"WITH {_BANDS}, {_HEADS} SELECT book, place, signature, n FROM r")
def running_heads(spark, sf_dir):
    return L.band_signatures(*_bands(spark, sf_dir))


_POS = f"""q AS (SELECT *, row_number() OVER (PARTITION BY book, page, place, pos ORDER BY block DESC) AS k FROM (SELECT book, page, place, text, 0 AS block, 10.0 AS size, round_even((30 + length(text) % 5) / 3.0, 0)::INT AS pos FROM b)),
 z AS (SELECT book, place, pos, count(*) AS n FROM q WHERE k = 1 AND (size < 0.92 * 10 OR length(text) <= 40) GROUP BY ALL), rp AS (SELECT z.* FROM z JOIN p USING (book) WHERE n >= greatest({_MIN}, floor(n_pages * 0.4)))"""


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bands, pages = _bands(spark, sf_dir)
    y = (30 + F.length("text") % 5).cast("double")
    return bands.withColumns({"block": F.lit(0), "size": F.lit(10.0), "body_size": F.lit(10.0), "y0": y, "y1": y}), pages


@query(f"WITH {_BANDS}, {_POS} SELECT book, place, pos, n FROM rp")
def running_heads_pos(spark, sf_dir):
    return L.band_positions(*_placed(spark, sf_dir))


@query(
    f"""WITH {_BANDS}, {_HEADS}, {_POS}, u AS (SELECT b.*, {_signature("text")} AS signature, round_even((30 + length(text) % 5) / 3.0, 0)::INT AS pos FROM b)
SELECT u.book, u.page, u.place, u.text FROM u LEFT JOIN r ON r.book = u.book AND r.place = u.place AND r.signature = u.signature LEFT JOIN rp ON rp.book = u.book AND rp.place = u.place AND rp.pos = u.pos AND length(u.text) <= 40
WHERE r.n IS NULL AND rp.n IS NULL AND NOT (regexp_matches(lower(text), '^[\\s\\x{{A0}}\\x{{3000}}–—・·|-]*(page|p\\.|頁|ページ|第)?[\\s\\x{{A0}}\\x{{3000}}–—・-]*[0-9〇一二三四五六七八九十百千]+[\\s\\x{{A0}}\\x{{3000}}–—・|-]*(頁|ページ|ページ目|/\\s*[0-9]+)?[\\s\\x{{A0}}\\x{{3000}}–—・|-]*$') AND length(text) <= 12)"""
)
def text_after_drop(spark, sf_dir):
    placed, pages = _placed(spark, sf_dir)
    placed = L.signed(placed)
    units = placed.withColumn("pos", T.position_key(F.col("y0")))
    return L.drop_running_heads(units, L.band_signatures(placed, pages), L.band_positions(placed, pages)).select("book", "page", "place", "text")


_GRID = """g AS (SELECT doc_id, unnest(range(0, len(ls))) AS r, unnest(ls) AS text FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda t: list_transform(range(0, greatest(1, (length(t) + 59) // 60)), lambda i: substr(t, (i * 60 + 1)::BIGINT, 60)))) AS ls FROM documents)),
l AS (SELECT doc_id, (r // 40)::INT AS page, (r % 40)::INT AS line, text, CASE WHEN r = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS size, 40.0::DOUBLE AS x0, 60 + (r % 40) * 14.0::DOUBLE AS y0 FROM g),
lines AS (SELECT *, 40 + length(text) * size / 2 AS x1, y0 + size AS y1 FROM l)"""
_W = f"length({_strip('text')})"
_HIST = f"hist AS (SELECT doc_id, size, sum({_W})::BIGINT AS chars FROM lines WHERE {_W} > 0 GROUP BY ALL), body AS (SELECT doc_id, arg_max(size, {{'a': chars, 'b': -size}}) AS body_size FROM hist GROUP BY 1)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grid_lines(table(spark, sf_dir, "documents"))


@query(f"WITH {_GRID}, {_HIST} SELECT doc_id, body_size FROM body")
def body_size(spark, sf_dir):
    return L.body_sizes(_lines(spark, sf_dir))


@query(f"WITH {_GRID}, {_HIST} SELECT doc_id, body_size, coalesce((SELECT string_agg(printf('%.1f', size), ',' ORDER BY size DESC) FROM hist WHERE hist.doc_id = body.doc_id AND size >= body_size * 1.15::DOUBLE), '') AS ladder FROM body")
def heading_ladder(spark, sf_dir):
    return L.heading_ladders(_lines(spark, sf_dir)).withColumn("ladder", F.array_join(F.transform("ladder", lambda x: F.format_string("%.1f", x)), ","))


@query(f"WITH {_GRID}, pg AS (SELECT doc_id, page, sum({_W}) AS chars FROM lines GROUP BY ALL) SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE chars >= 20) AS n_text_pages, (count(*) FILTER (WHERE chars >= 20))::DOUBLE / count(*) AS coverage FROM pg GROUP BY 1")
def text_coverage(spark, sf_dir):
    return L.text_coverage(_lines(spark, sf_dir))


@query(f"WITH {_GRID}, m AS (SELECT doc_id, sum(CASE WHEN line % 3 = 0 THEN {_W} ELSE 0 END)::BIGINT AS v_chars, sum(CASE WHEN line % 3 = 0 THEN 0 ELSE {_W} END)::BIGINT AS h_chars FROM lines GROUP BY 1) SELECT *, v_chars > h_chars AND v_chars > 0 AS is_vertical FROM m")
def writing_mode(spark, sf_dir):
    """Every third line counts as vertical here: the documents have no direction."""
    return L.writing_modes(_lines(spark, sf_dir).withColumn("vertical", F.col("line") % 3 == 0))


_GLYPHS = "gl AS (SELECT doc_id, page, line, size, y0, y1, p AS pos, substr(text, (p + 1)::BIGINT, 1) AS c, 40 + p * size / 2 AS x0, 40 + p * size / 2 + size / 2 AS x1 FROM (SELECT *, unnest(range(0, length(text))) AS p FROM lines WHERE length(text) > 0))"


_BLANK = f"regexp_matches(c, '^{S.BLANK}$')"


@query(
    f"""WITH {_GRID}, {_GLYPHS}, w AS (SELECT * REPLACE (x0 + (pos // 7) * 60 AS x0, x1 + (pos // 7) * 60 AS x1), {_BLANK} AS blank FROM gl),
a AS (SELECT *, last_value(CASE WHEN NOT blank THEN x1 END IGNORE NULLS) OVER w AS px, last_value(CASE WHEN NOT blank THEN size END IGNORE NULLS) OVER w AS ps FROM w WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, sum(CASE WHEN NOT blank AND x0 - px > 4 * greatest(size, ps, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line ORDER BY pos) AS part FROM a)
SELECT doc_id, page, line, part::BIGINT AS part, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM f WHERE NOT blank GROUP BY doc_id, page, line, part"""
)
def gap_split_runs(spark, sf_dir):
    """Every seven glyphs stand 60 points further, so that there are gaps to split at, and in a title's larger type too small ones."""

    def edges(pos, size):
        x0 = 40 + pos * size / 2
        return x0 + pos // 7 * 60, x0 + size / 2 + pos // 7 * 60

    return L.line_runs(_lines(spark, sf_dir), edges)


_HOLES = "hl AS (SELECT doc_id, page, line, size, 40 + k * 125.0::DOUBLE AS x0, 40 + k * 125.0::DOUBLE + length(substr(text, (k * 20 + 1)::BIGINT, 20)) * 5 AS x1, y0, y1 FROM (SELECT *, unnest(range(0, 3)) AS k FROM lines) WHERE length(text) > k * 20)"


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as three columns of 20 characters, 25 points apart."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 20).cast("int")), lambda k: F.struct((40 + k * 125.0).alias("x0"), (F.length(F.substring("text", k * 20 + 1, F.lit(20))) * 5).alias("w")))
    parts = _lines(spark, sf_dir).where("text <> ''").select("doc_id", "page", "line", "size", "y0", "y1", F.explode(pieces).alias("p"))
    return parts.select("doc_id", "page", "line", "size", F.col("p.x0").alias("x0"), (F.col("p.x0") + F.col("p.w")).alias("x1"), "y0", "y1")


def _parts(spark: SparkSession, sf_dir: str, width: int = 20) -> int:
    """Tasks for the pieces of ``_columns``, or others of this width: there is one for each line and for each so many characters, at most."""
    text = F.col("text")
    most = table(spark, sf_dir, "documents").agg(F.sum(F.length(text) / width + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0]
    return parts_for(spark, int(most or 0))


_GUTTERS = """ln AS (SELECT doc_id, page, line, min(x0) AS l0, max(x1) AS l1 FROM hl GROUP BY ALL HAVING count(*) >= 2),
pn AS (SELECT doc_id, page, min(l0) AS xmin, count(*) AS n_lines FROM ln GROUP BY ALL HAVING count(*) >= 6),
cv AS (SELECT doc_id, page, xmin, n_lines, bin, count(*) AS cover FROM (SELECT doc_id, page, xmin, n_lines, unnest(range(floor(l0 - xmin)::BIGINT, floor(l1 - xmin)::BIGINT + 1)) AS bin FROM ln JOIN pn USING (doc_id, page)) GROUP BY ALL),
ik AS (SELECT doc_id, page, bin, count(*) AS ink FROM (SELECT DISTINCT doc_id, page, line, unnest(range(floor(x0 - xmin)::BIGINT, floor(x1 - xmin)::BIGINT + 1)) AS bin FROM hl JOIN pn USING (doc_id, page) SEMI JOIN ln USING (doc_id, page, line)) GROUP BY ALL),
gg AS (SELECT cv.*, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS island FROM cv LEFT JOIN ik USING (doc_id, page, bin) WHERE cover >= greatest(5, floor(n_lines * 0.3::DOUBLE)) AND cover - coalesce(ink, 0) >= 0.9::DOUBLE * cover),
gu AS (SELECT doc_id, page, xmin + min(bin) AS g0, xmin + max(bin) + 1 AS g1 FROM gg GROUP BY doc_id, page, xmin, island HAVING max(bin) + 1 - min(bin) >= 6)"""


@query(f"WITH {_GRID}, {_HOLES}, {_GUTTERS} SELECT doc_id, page, g0, g1 FROM gu")
def gutters(spark, sf_dir):
    return L.gutters(_columns(spark, sf_dir), parts=_parts(spark, sf_dir))


@query(
    f"""WITH {_GRID}, {_HOLES}, n AS (SELECT doc_id, page, round_even(x0 / 2, 0) AS q, size, x0, x1, count(*) AS n FROM hl GROUP BY ALL),
m AS (SELECT a.doc_id, a.page, a.size, a.x0, a.x1, b.q, sum(b.n) AS n FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.page = b.page AND abs(b.size - a.size) <= 0.25 * a.size AND least(a.x1, b.x1) > greatest(a.x0, b.x0) GROUP BY ALL)
SELECT doc_id, page, size, x0, x1, CASE WHEN sum(n) >= 3 THEN arg_max(q, {{'a': n, 'b': q}}) * 2 END AS edge FROM m GROUP BY doc_id, page, size, x0, x1"""
)
def margins(spark, sf_dir):
    return L.modal_edges(_columns(spark, sf_dir))


@query(f"WITH {_GRID} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY ALL")
def unit_bbox(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query(
    f"""WITH {_GRID}, {_HOLES}, r AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hl),
gp AS (SELECT *, x0 - reach AS gap, (x0 + reach) / 2 AS cut FROM r WHERE x0 - reach > 0.5) SELECT doc_id, page, max(gap) AS gap, arg_max(cut, {{'a': gap, 'b': -x0}}) AS cut FROM gp GROUP BY ALL"""
)
def widest_gap(spark, sf_dir):
    return L.widest_gaps(_columns(spark, sf_dir), "x0", "x1")


@query(
    f"""WITH RECURSIVE {_GRID}, {_HOLES}, r AS (SELECT doc_id, page, line * 10 + round_even((x0 - 40) / 125, 0)::INT AS tag, x0, y0, x1, y1, '' AS path, true AS going FROM hl
UNION ALL SELECT doc_id, page, tag, x0, y0, x1, y1, CASE WHEN cut IS NULL THEN path ELSE path || CASE WHEN mid >= cut THEN '1' ELSE '0' END END, cut IS NOT NULL FROM (
SELECT *, CASE WHEN gx.g >= 10 AND (gy.g IS NULL OR gy.g < 3 OR gx.g > gy.g) THEN -gx.n - gx.g / 2 WHEN gy.g >= 3 THEN -gy.n - gy.g / 2 END AS cut, CASE WHEN gx.g >= 10 AND (gy.g IS NULL OR gy.g < 3 OR gx.g > gy.g) THEN (x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS mid FROM (
SELECT *, max(CASE WHEN x0 - rx > 0.5 THEN {{'g': x0 - rx, 'n': -x0}} END) OVER (PARTITION BY doc_id, page, path) AS gx, max(CASE WHEN y0 - ry > 0.5 THEN {{'g': y0 - ry, 'n': -y0}} END) OVER (PARTITION BY doc_id, page, path) AS gy FROM (
SELECT *, max(x1) OVER (PARTITION BY doc_id, page, path ORDER BY x0, x1, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rx, max(y1) OVER (PARTITION BY doc_id, page, path ORDER BY y0, y1, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ry FROM r WHERE going))))
SELECT doc_id, page, tag, (row_number() OVER (PARTITION BY doc_id, page ORDER BY path, y0, x0, tag) - 1)::INT AS ord FROM r WHERE NOT going"""
)
def page_reading_order(spark, sf_dir):
    """The documents' pages in three columns, in which bands that blank lines leave are read before columns where they are wider apart."""
    units = _columns(spark, sf_dir).withColumns({"tag": F.col("line") * 10 + F.round((F.col("x0") - 40) / 125).cast("int"), "vertical": F.lit(False), "body": F.lit(10.0)})
    return ST.reading_order(units.select("doc_id", "page", "tag", "x0", "y0", "x1", "y1", "vertical", "body"), _parts(spark, sf_dir))


@query(
    f"""WITH {_GRID}, {_HOLES}, c AS (SELECT doc_id, page, line * 10 + round_even((x0 - 40) / 125, 0)::INT AS run, x0, y0, y0 - lag(y1) OVER w AS gap, 2.5 * greatest(size, lag(size) OVER w) AS reach, coalesce(y0 - max(CASE WHEN size = 18 THEN y1 END) OVER (PARTITION BY doc_id, page, x0) <= 45, false) AS titled FROM hl WINDOW w AS (PARTITION BY doc_id, page, x0 ORDER BY y0)),
i AS (SELECT *, sum((gap IS NULL OR (gap > reach AND NOT titled))::INT) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0) AS island FROM c)
SELECT doc_id, page, 0 AS block, run, min(run) OVER (PARTITION BY doc_id, page, x0, island) AS cluster FROM i"""
)
def grid_clusters(spark, sf_dir):
    """The pieces of a page in three columns, its one block: each column falls apart where blank lines leave room."""
    from folio.operators.spatial import clusters

    run = F.col("line") * 10 + F.round((F.col("x0") - 40) / 125).cast("int")
    return clusters(_columns(spark, sf_dir).withColumns({"block": F.lit(0), "run": run, "vertical": F.lit(False)}), _parts(spark, sf_dir))


_CAP = 30_000
_BOOK_LINES = f"""bl AS (SELECT doc_id // 50 AS book, ((doc_id % 50) * 1000 + page)::INT AS page, line, text, length(text) AS len, {_W} AS nch, size, doc_id % 10 = 0 AND page = 0 AND line = 0 AS head, length(text) >= 50 AS full_, regexp_matches(text, '^[ \t]') AS indented, doc_id AS d FROM lines WHERE text <> ''),
bb AS (SELECT *, lag(head) OVER w AS p_head, lag(page) OVER w AS p_page, lag(line) OVER w AS p_line, lag(full_) OVER w AS p_full, lag(size) OVER w AS p_size FROM bl WINDOW w AS (PARTITION BY book ORDER BY page, line)),
bf AS (SELECT *, p_page IS NULL OR head OR p_head OR indented OR NOT p_full OR size <> p_size OR (page = p_page AND (line - p_line) * 14 - p_size > 1.2 * size) AS forced FROM bb),
bs AS (SELECT *, sum(CASE WHEN forced THEN 3 * len + 40 ELSE 3 * nch END) OVER (PARTITION BY book ORDER BY page, line) - CASE WHEN forced THEN 3 * len + 40 ELSE 3 * nch END AS off, CASE WHEN forced THEN 0 ELSE 3 * len + 40 - 3 * nch END AS more FROM bf),
bc AS (SELECT book, page, line, off, more, head, row_number() OVER (PARTITION BY book ORDER BY page, line) AS k FROM bs WHERE p_page IS NOT NULL AND (head OR page <> p_page)),
ch AS (SELECT book, 0::BIGINT AS k, 0::HUGEINT AS base FROM bl GROUP BY book UNION ALL SELECT ch.book, min(bc.k), arg_min(bc.off - bc.more, bc.k) FROM ch JOIN bc ON bc.book = ch.book AND bc.k > ch.k AND (bc.head OR bc.off - ch.base > {_CAP}) GROUP BY ch.book, ch.k),
bp AS (SELECT bs.*, sum((forced OR ch.k IS NOT NULL)::INT) OVER w - 1 AS para, sum((ch.k IS NOT NULL)::INT) OVER w AS chapter FROM bs LEFT JOIN bc ON bc.book = bs.book AND bc.page = bs.page AND bc.line = bs.line LEFT JOIN ch ON ch.book = bc.book AND ch.k = bc.k WINDOW w AS (PARTITION BY bs.book ORDER BY bs.page, bs.line))"""
_BOOK_PARAGRAPHS = """SELECT book AS doc_id, any_value(chapter)::INT AS chapter, para::INT AS para, CASE WHEN bool_or(head) THEN 'h' ELSE 'p' END AS kind, bool_or(head)::INT AS level, min(page) AS page,
 CASE WHEN bool_or(head) THEN '' WHEN arg_min(indented, {'p': page, 'l': line}) THEN 'indent' ELSE 'noindent' END AS classes, md5(string_agg(text, ' ' ORDER BY page, line)) AS digest FROM bp GROUP BY book, para"""


def _book_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents in a row as a book, their lines as its units; every tenth begins with a heading."""
    c = F.col
    lines = _lines(spark, sf_dir).where("text <> ''")
    head = (c("doc_id") % 10 == 0) & (c("page") == 0) & (c("line") == 0)
    return lines.select(
        F.expr("doc_id div 50").alias("doc_id"), ((c("doc_id") % 50) * 1000 + c("page")).cast("int").alias("page"), c("line").alias("ord"), F.lit("text").alias("kind"), "text", F.length(T.strip(c("text"))).alias("nchars"), "size", F.lit(10.0).alias("body"),
        F.lit(1).alias("n_runs"), head.alias("heading"), F.lit(1).alias("ladder_level"), F.lit(None).cast("int").alias("toc_level"), F.lit(False).alias("has_toc"), c("text").rlike("^[ \t]").alias("indented"), (F.length("text") >= 50).alias("full"),
        F.lit(None).cast("string").alias("align"), F.lit(False).alias("vertical"), c("line").alias("tag"), "x0", "y0", "x1", "y1")


@query(f"WITH RECURSIVE {_GRID}, {_BOOK_LINES} {_BOOK_PARAGRAPHS}")
def book_paragraphs(spark, sf_dir):
    """Paragraphs and chapters of at most 30,000 bytes or so, of books that are many tasks each."""
    parts = _parts(spark, sf_dir, 60)
    gap = F.col("y0") - F.lag("y1").over(Window.partitionBy("doc_id", "stretch", "page").orderBy("ord"))
    units = ST.dealt(_book_units(spark, sf_dir), parts).withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    return ST.scanned_paragraphs(units, _CAP, parts).select("doc_id", "chapter", "para", "kind", "level", "page", "classes", F.md5("text").alias("digest"))


_JOIN = f"""ls AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM documents)"""


@query(f"WITH {_JOIN} SELECT doc_id, md5(array_to_string(ls, ' ')) AS joined FROM ls")
def line_join(spark, sf_dir):
    """Lines joined to a text; no document has CJK, so each joiner is a blank. The digest stands for the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_joined(F.split("text", "\n", -1))).alias("joined"))


_WRAP = f"""w AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda t: list_transform(range(0, greatest(1, (length(t) + 39) // 40)), lambda i: substr(t, (i * 40 + 1)::BIGINT, 40) || CASE WHEN regexp_matches(substr(t, (i * 40 + 40)::BIGINT, 2), '^\\p{{L}}\\p{{L}}$') THEN '-' ELSE '' END))) AS ls FROM documents),
h AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM w),
e AS (SELECT doc_id, ls, list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i = len(ls) THEN 0 WHEN NOT regexp_matches(right(ls[i], 2), '\\p{{L}}[-‐­]$') OR NOT regexp_matches(ls[i + 1], '^\\p{{L}}') THEN 1 WHEN regexp_matches(ls[i + 1], '^\\p{{Ll}}') THEN 2 ELSE 3 END) AS k FROM h)"""


@query(f"WITH {_WRAP}, t AS (SELECT doc_id, array_to_string(list_transform(range(1, len(ls) + 1), lambda i: CASE k[i] WHEN 1 THEN ls[i] || ' ' WHEN 2 THEN left(ls[i], length(ls[i]) - 1) ELSE ls[i] END), '') AS t FROM e) SELECT doc_id, length(t) AS n, md5(t) AS joined FROM t", long="n")
def doc_dehyphenated(spark, sf_dir):
    """The documents set in lines of 40 characters, with words broken by hyphens at their ends, and put together again."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.wrapped(F.col("text"), 40).alias("lines"))
    return d.select("doc_id", T.dehyphenate(F.col("lines")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("joined"))


@query(f"WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT doc_id, (i - 1)::INT AS line, {_strip('line')} <> '' AND instr('.!?:;\"'')]」』】〉》）］…。！？」』', right({_strip('line')}, 1)) > 0 AS terminal FROM l")
def terminal_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).select("doc_id", "line", T.is_terminal(T.strip(F.col("t"))).alias("terminal"))


@query("SELECT doc_id, md5(e) AS escaped, length(e) AS n, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS attribute FROM (SELECT page_id AS doc_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e, url FROM pages)", long="n")
def escaped_pages(spark, sf_dir):
    """Whole pages, escaped; a digest and the length stand for the text."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), T.escape(F.col("html")).alias("e"), T.escape(F.col("url"), True).alias("attribute"))
    return p.select("doc_id", F.md5("e").alias("escaped"), F.length("e").cast("long").alias("n"), "attribute")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * 37 AS n FROM documents)")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.human_size(F.col("n_chars") * 37).alias("size"))


_NAME = f"""regexp_replace(regexp_replace({_strip("replace(replace(text, '/', '_'), chr(92), '_')")}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_.\\- ]', '', 'g'), '^[ .]+|[ .]+$', '', 'g')"""


@query(f"SELECT doc_id, CASE WHEN f = '' THEN 'untitled' ELSE left(f, 180) END AS name FROM (SELECT doc_id, {_NAME} AS f FROM documents)")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_filename(F.col("text")).alias("name"))


_PAGES = "pg AS (SELECT doc_id // 40 AS doc, doc_id AS page, text, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id // 40) AS n FROM documents)"


@query(f"WITH {_PAGES}, s AS (SELECT * FROM pg WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda k: (k * n) // 12), i)) SELECT doc AS doc_id, sum({_COUNT.format(S.PUA)})::BIGINT AS pua, sum({_COUNT.format('[^' + chr(92) + 'x{0}-' + chr(92) + 'x{7F}]')})::BIGINT AS beyond, CASE WHEN beyond = 0 THEN 0.0 ELSE pua::DOUBLE / beyond END AS fraction FROM s GROUP BY doc")
def pua_sample(spark, sf_dir):
    """Forty documents in a row as the pages of one; at most twelve are looked at."""
    return L.obfuscation(table(spark, sf_dir, "documents").select(F.expr("doc_id div 40").alias("doc_id"), F.col("doc_id").alias("page"), "text"))


@query(
    """WITH d AS (SELECT doc_id // 50 AS book, doc_id AS id, md5(text) AS digest, CASE WHEN n_chars % 3 = 0 THEN 'xref:' || (n_chars % 30) ELSE md5(text) END AS k FROM documents),
f AS (SELECT *, min(id) OVER (PARTITION BY book, k) AS first FROM d), o AS (SELECT book, first, row_number() OVER (PARTITION BY book ORDER BY first) AS number FROM (SELECT DISTINCT book, first FROM f))
SELECT book AS doc_id, id, digest, first, number::INT AS number FROM f JOIN o USING (book, first)"""
)
def content_dedupe(spark, sf_dir):
    """Fifty documents in a row as one book's images, some with a reference number."""
    from folio.operators.catalog import deduplicated

    d = table(spark, sf_dir, "documents")
    return deduplicated(d.select(F.expr("doc_id div 50").alias("doc_id"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") % 3 == 0, F.col("n_chars") % 30).alias("xref"), F.col("text").cast("binary").alias("content")))


@query("WITH a AS (SELECT doc_id // 30 AS d, doc_id AS page FROM documents WHERE n_chars % 3 = 0), l AS (SELECT doc_id // 30 AS d, doc_id AS link FROM documents), m AS (SELECT l.d, link, min(a.page) AS page FROM l LEFT JOIN a ON a.d = l.d AND a.page >= link GROUP BY ALL) SELECT d AS doc_id, link, CASE WHEN page IS NULL THEN '#' ELSE '#pg' || page END AS href FROM m")
def page_link_asof(spark, sf_dir):
    from folio.operators.spatial import page_link_targets

    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 30").alias("doc_id"), F.col("doc_id").alias("page"), "n_chars")
    return page_link_targets(d.select("doc_id", "page", F.col("page").alias("link")), d.where("n_chars % 3 = 0").select("doc_id", "page", F.concat(F.lit("pg"), F.col("page").cast("string")).alias("anchor")))


@query("SELECT doc_id // 25 AS doc_id, doc_id AS para, (sum(CASE WHEN n_chars % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id // 25 ORDER BY doc_id))::BIGINT AS chapter FROM documents")
def chapter_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("doc_id"), F.col("doc_id").alias("para"), (F.col("n_chars") % 4 == 0).alias("starts"))
    return ST.chapters(d).select("doc_id", "para", "chapter")


@query(
    """WITH u AS (SELECT doc_id // 25 AS d, doc_id AS page, n_chars AS ord FROM documents WHERE n_chars % 3 <> 0), p AS (SELECT doc_id // 25 AS d, doc_id AS page FROM documents),
f AS (SELECT p.d, p.page, u.ord FROM p LEFT JOIN u USING (d, page)) SELECT d AS doc_id, page, 'pg' || page AS anchor, coalesce(first_value(ord IGNORE NULLS) OVER (PARTITION BY d ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS ord FROM f"""
)
def page_anchors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 25").alias("doc_id"), F.col("doc_id").alias("page"), F.col("n_chars").alias("ord"))
    return ST.page_anchors(d.where("ord % 3 <> 0"), d).fillna(-1, ["ord"])


@query("WITH i AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT doc_id, (CASE WHEN n <= 3 THEN 0 ELSE pos // 3 END)::INT AS chunk, count(*) AS n_items, min(pos)::INT AS first_pos FROM i GROUP BY ALL")
def chunk_plan(spark, sf_dir):
    """Line items of an order as the spine items of a book, three to a chunk."""
    from folio.operators.catalog import chunk_plan as plan

    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("pos"))
    return plan(i, 3)


@query("WITH c AS (SELECT o_orderkey AS doc_id, (o_custkey % 60)::BIGINT AS n FROM orders) SELECT doc_id, a::INT AS attempt, (greatest(300, 60 + 10 * n) * a)::BIGINT AS attempt_timeout, CASE a WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 0 END::BIGINT AS wait_after FROM c, range(1, 4) AS r(a)")
def retry_schedule(spark, sf_dir):
    from folio.operators.catalog import retry_schedule as plan

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.greatest(F.lit(300), T.chunk_timeout(F.col("o_custkey") % 60)).cast("long").alias("timeout"))
    return plan(o).select("doc_id", "attempt", "attempt_timeout", "wait_after")


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, arg_max(CAST(value AS VARCHAR) IS NOT NULL, event_id) AS has_message, count(*) FILTER (WHERE event_type = 'click') AS n_steps, max(event_id) AS last_seq FROM events GROUP BY 1")
def job_state(spark, sf_dir):
    """A user's events as a job's: a stand-in."""
    from folio.operators.catalog import job_states

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "step").otherwise(F.col("event_type")).alias("kind"), F.col("value").isNotNull().alias("message"))
    return job_states(e).select("job_id", F.when(F.col("status") == "step", "click").otherwise(F.col("status")).alias("status"), F.col("message").alias("has_message"), "n_steps", "last_seq")


@query("SELECT event_id AS name, ts AS mtime FROM events ORDER BY ts DESC, event_id LIMIT 25")
def library_newest(spark, sf_dir):
    from folio.operators.catalog import newest

    return newest(table(spark, sf_dir, "events").select(F.col("event_id").alias("name"), F.col("ts").alias("mtime")), 25)


@query("SELECT event_id AS id, event_type || '.' || (user_id % 3) || '.pdf' AS name, CASE WHEN k = 1 THEN event_type || '.' || u || '.pdf' ELSE event_type || '.' || u || ' (' || k || ').pdf' END AS \"unique\" FROM (SELECT *, user_id % 3 AS u, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id) AS k FROM events)")
def unique_names(spark, sf_dir):
    from folio.operators.catalog import unique_names as names

    return names(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("."), (F.col("user_id") % 3).cast("string"), F.lit(".pdf")).alias("name")))


@query(
    """WITH r AS (SELECT user_id AS upload, event_id AS part, sum(event_id % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS running FROM events),
c AS (SELECT upload, max(running) AS total, min(part) FILTER (WHERE running > 10000) AS cut_part, min(running) FILTER (WHERE running > 10000) AS cut FROM r GROUP BY upload)
SELECT upload, coalesce(cut, total)::BIGINT AS received, cut_part, cut_part IS NULL AS accepted FROM c"""
)
def upload_totals(spark, sf_dir):
    """A user's events as an upload's parts, some of which pass the cap."""
    from folio.operators.catalog import upload_cut

    return upload_cut(table(spark, sf_dir, "events").select(F.col("user_id").alias("upload"), F.col("event_id").alias("part"), (F.col("event_id") % 1000).alias("bytes")), 10000)


@query("WITH s AS (SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_seq FROM events GROUP BY 1) SELECT a.job_id, coalesce(status, 'unknown') AS status, coalesce(last_seq, -1) AS last_seq FROM (SELECT DISTINCT l_suppkey AS job_id FROM lineitem) a LEFT JOIN s USING (job_id)", long="last_seq")
def job_lookup(spark, sf_dir):
    """Jobs asked for by number, known or not."""
    from folio.operators.catalog import job_lookup as lookup
    from folio.operators.catalog import job_states

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.lit("").alias("message"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("job_id")).distinct()
    return lookup(job_states(e).select("job_id", "status", "last_seq"), asked).fillna(-1, ["last_seq"])
