"""Queries over packages made from the documents: written as archives by tasks, read back entry by entry, cut to chunks and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import package as P
from folio.operators.convert import converted_books
from folio.operators.rounds import by_task, new_folder
from folio.operators.structure import nested_levels
from folio.plans.base import query, table
from folio.plans.texts import _BOOK_LINES, _GRID
from folio.plans.texts import _CAP as CAP
from folio.plans.texts import _book_units as book_units
from folio.plans.texts import _parts as line_parts
from folio.sources.archives import read_archives, write_archives

LINES = 4  # of a chapter
_TITLE = "'Book ' || doc_id || ' & <' || source || '>'"
_CHAPTERS = f"""c AS (SELECT doc_id, lang, {_TITLE} AS book, unnest(range(0, (len(ls) + {LINES - 1}) // {LINES})) AS chapter, ls FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)),
ch AS (SELECT doc_id, lang, book, chapter, (len(ls) + {LINES - 1}) // {LINES} AS n, '<p>' || array_to_string(list_transform(ls[chapter * {LINES} + 1:chapter * {LINES} + {LINES}], lambda t: replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '</p>' || chr(10) || '<p>') || '</p>' AS html FROM c)"""
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XHTML = f"""'<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="' || lang || '"><head><title>' || CASE WHEN chapter = 0 THEN {_ESCAPED.format('book')} ELSE 'Section ' || (chapter + 1) END
 || '</title><link rel="stylesheet" type="text/css" href="../css/book.css"/></head><body>' || chr(10) || '<section epub:type="chapter">' || chr(10) || html || chr(10) || '</section>' || chr(10) || '</body></html>' || chr(10)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a book for each document, a chapter for each four lines."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    title = F.concat(F.lit("Book "), F.col("doc_id").cast("string"), F.lit(" & <"), "source", F.lit(">"))
    books = d.select("doc_id", title.alias("title"), "lang", F.lit(False).alias("vertical"), F.lit(False).alias("all_indent"), F.concat(F.lit("urn:book:"), F.col("doc_id").cast("string")).alias("uid"), F.lit("2020-01-01T00:00:00Z").alias("modified"))
    lines = F.split("text", "\n", -1)
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("ls") / LINES).cast("int") - 1), lambda k: F.slice("ls", k * LINES + 1, LINES))
    chapters = d.select("doc_id", lines.alias("ls")).select("doc_id", F.posexplode(parts).alias("chapter", "part"))
    paragraphs = F.concat(F.lit("<p>"), F.array_join(F.transform("part", lambda t: T.escape(t)), "</p>\n<p>"), F.lit("</p>"))
    chapters = chapters.select("doc_id", "chapter", F.lit(None).cast("string").alias("title"), paragraphs.alias("html"))
    images = spark.createDataFrame([], "doc_id long, k int, name string, bytes binary")
    return P.package_entries(books, chapters, images)


def library(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of these books."""
    folder = new_folder(spark, "library")
    named = packages(spark, sf_dir).select(F.concat(F.lit("book"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("name"), "ord", F.col("name").alias("entry"), "body", (~F.col("compress")).alias("stored"))
    write_archives(named, folder, folders=True)
    return folder


def _number() -> Column:
    return F.regexp_extract("name", r"(\d+)\.epub$", 1).try_cast("long").alias("doc_id")


@query(f"WITH {_CHAPTERS}, x AS (SELECT doc_id, chapter, {_XHTML} AS x FROM ch) SELECT doc_id, printf('OEBPS/text/chapter%04d.xhtml', chapter) AS entry, strlen(x) AS size, md5(x) AS digest FROM x")
def archived_chapters(spark, sf_dir):
    """The chapters of all books as they stand in their archives; only these entries are decompressed."""
    e = read_archives(spark, library(spark, sf_dir), "name string, entry string, size long, body binary", entry="OEBPS/text/*")
    return e.select(_number(), "entry", "size", F.md5("body").alias("digest"))


@query(f"WITH {_CHAPTERS} SELECT doc_id, 'ok' AS verdict, any_value(book) AS title, any_value(lang) AS language, NULL::VARCHAR AS direction, false AS fixed, 'OEBPS/content.opf' AS package, string_agg('c' || chapter, ',' ORDER BY chapter) AS spine, any_value(n)::BIGINT AS n_marks, 'mimetype' AS first FROM ch GROUP BY doc_id")
def archived_metadata(spark, sf_dir):
    """What each archive's own documents say of it: whether it can be read, title, language, direction, layout, spine and navigation."""
    needed = ["mimetype", "META-INF/container.xml", "META-INF/encryption.xml", "OEBPS/content.opf", "OEBPS/nav.xhtml"]
    e = read_archives(spark, library(spark, sf_dir), "name string, ord int, entry string, body binary", entry=needed)
    of = lambda entry: F.decode(F.max(F.when(F.col("entry") == entry, F.col("body"))), "UTF-8")
    sums = e.groupBy("name").agg(*[of(x).alias(k) for k, x in zip(("mimetype", "container", "encryption", "opf", "nav"), needed, strict=True)], F.min_by("entry", "ord").alias("first"))
    opf = F.col("opf")
    return sums.select(
        _number(), P.package_verdict(F.lit(b"PK\x03\x04"), F.col("mimetype"), F.col("container"), F.col("encryption")).alias("verdict"), P.title(opf, F.lit("?")).alias("title"), P.language(opf).alias("language"), P.page_direction(opf).alias("direction"),
        P.is_fixed_layout(opf).alias("fixed"), P.opf_path(F.col("container")).alias("package"), F.array_join(P.spine_ids(opf), ",").alias("spine"), F.size(F.xpath(F.col("nav"), F.lit("//*[local-name()='nav']//*[local-name()='a']/@href"))).cast("long").alias("n_marks"), "first")


@query(
    f"""WITH {_CHAPTERS}, x AS (SELECT doc_id, chapter, n, 'chapter' || chapter || ' of ' || n || CASE WHEN chapter + 1 < n THEN ' on to chapter' || (chapter + 1) ELSE '' END AS links, md5(html) AS digest FROM ch)
SELECT doc_id, chapter::BIGINT AS chapter, 'c' || chapter AS id, printf('text/chapter%04d.xhtml', chapter) AS href, chapter // 3 AS chunk, links, digest FROM x"""
)
def merged_chunks(spark, sf_dir):
    """Each book's chapters cut to chunks of three, each a package that counts from nought, and merged again: numbers, manifest ids and
    links are those of the whole book."""
    e = packages(spark, sf_dir).where("name LIKE 'OEBPS/text/%'").select("doc_id", F.regexp_extract("name", r"(\d+)\.xhtml$", 1).try_cast("long").alias("chapter"), F.decode("body", "UTF-8").alias("xhtml"))
    last = e.groupBy("doc_id").agg(F.max("chapter").alias("last"))
    note = lambda k, more: F.concat(F.lit('<a href="'), F.format_string("chapter%04d.xhtml", k), F.lit(more))
    linked = e.join(last, "doc_id").withColumn("xhtml", F.concat("xhtml", note(F.col("chapter"), '#top">up</a>'), F.when(F.col("chapter") < F.col("last"), note(F.col("chapter") + 1, '">on</a>')).otherwise("")))
    chunks = P.split_chapters(linked.select("doc_id", "chapter", "xhtml"), 3)
    m = P.merge_chapters(chunks)
    n = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    links = F.regexp_extract_all("xhtml", F.lit(r'<a href="chapter(\d{4})\.xhtml(?:#top)?">'), 1)
    on = F.element_at(links, -1).cast("long")
    said = F.concat(F.lit("chapter"), F.get(links, 0).cast("long").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.when(on != F.get(links, 0).cast("long"), F.concat(F.lit(" on to chapter"), on.cast("string"))).otherwise(""))
    html = F.regexp_extract("xhtml", r'(?s)<section epub:type="chapter">\n(.*)\n</section>', 1)
    return m.join(n, "doc_id").select("doc_id", "chapter", "id", "href", "chunk", said.alias("links"), F.md5(html).alias("digest"))


_OUTLINE = """h AS (SELECT page_id, i - 1 AS idx, CASE ls[i] WHEN 'h1' THEN 1 WHEN 'ul' THEN 2 WHEN 'p' THEN 2 WHEN 'li' THEN 3 WHEN 'b' THEN 5 ELSE 6 END AS level FROM (SELECT page_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(h1|ul|li|a|p|b)[ >]', 1) AS ls FROM pages))),
t(page_id, idx, level, nested) AS (SELECT page_id, idx, level, 1 FROM h WHERE idx = 0 UNION ALL SELECT h.page_id, h.idx, h.level, least(h.level, t.nested + 1) FROM t JOIN h ON h.page_id = t.page_id AND h.idx = t.idx + 1)"""


@query(f"WITH RECURSIVE {_OUTLINE} SELECT page_id AS doc_id, idx::INT AS idx, level::INT AS level, nested::INT AS nested FROM t")
def page_outline(spark, sf_dir):
    """Headings, lists, paragraphs and links of web pages as the entries of a navigation, at levels that skip some, nested."""
    tags = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<(h1|ul|li|a|p|b)[ >]"), 1)).alias("idx", "tag"))
    level = F.when(F.col("tag") == "h1", 1).when(F.col("tag").isin("ul", "p"), 2).when(F.col("tag") == "li", 3).when(F.col("tag") == "b", 5).otherwise(6)
    return nested_levels(tags.select("doc_id", "idx", level.alias("level")))


_SHOWN = "CASE WHEN trim(text) = '' THEN '' WHEN head THEN '<h1 id=\"h' || para || '\">' || text || '</h1>' WHEN indented AND NOT all_indent THEN '<p class=\"indent\">' || text || '</p>' WHEN NOT indented AND all_indent THEN '<p class=\"noindent\">' || text || '</p>' ELSE '<p>' || text || '</p>' END"


@query(
    f"""WITH RECURSIVE {_GRID}, {_BOOK_LINES}, pa AS (SELECT book, para, chapter, bool_or(head) AS head, arg_min(indented, {{'p': page, 'l': line}}) AS indented, {_ESCAPED.format("string_agg(text, ' ' ORDER BY page, line)")} AS text FROM bp GROUP BY book, para, chapter),
v AS (SELECT book, count(*) FILTER (WHERE NOT head AND indented) > count(*) FILTER (WHERE NOT head AND NOT indented) AS all_indent FROM pa GROUP BY book),
c AS (SELECT book, chapter, arg_min(text, para) FILTER (WHERE head) AS title, string_agg({_SHOWN}, chr(10) ORDER BY para) AS html, coalesce(string_agg(para || ':' || CASE WHEN trim(text) = '' THEN '—' ELSE text END, '|' ORDER BY para) FILTER (WHERE head), '') AS marks FROM pa JOIN v USING (book) GROUP BY book, chapter)
SELECT book AS doc_id, chapter::BIGINT AS chapter, CASE WHEN trim(title) <> '' THEN title WHEN chapter = 0 THEN 'Book ' || book ELSE 'Section ' || (chapter + 1) END AS title, md5(html) AS digest, md5(marks) AS marks FROM c"""
)
def converted_documents(spark, sf_dir):
    """Fifty documents in a row as a book, converted from the lines of its pages to an archive: chapters and navigation as they stand there."""
    units = book_units(spark, sf_dir).drop("ord")  # the conversion finds it, and the gaps
    name = F.concat(F.lit("Book "), F.col("doc_id").cast("string"))
    books = table(spark, sf_dir, "documents").where(F.replace("text", F.lit("\n"), F.lit("")) != "").select(F.expr("doc_id div 50").alias("doc_id")).distinct().select("doc_id", name.alias("title"), F.lit("en").alias("lang"), F.lit(False).alias("vertical"), F.concat(F.lit("urn:"), F.col("doc_id").cast("string")).alias("uid"), F.lit("2020-01-01T00:00:00Z").alias("modified"))
    entries = converted_books(books, units, CAP, line_parts(spark, sf_dir, 60))
    folder = new_folder(spark, "converted")
    named = entries.select(F.concat(F.lit("book"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("name"), "ord", F.col("name").alias("entry"), "body", (~F.col("compress")).alias("stored"))
    write_archives(named, folder, folders=True)
    entries = lambda wanted: read_archives(spark, folder, "name string, entry string, body binary", entry=wanted)
    text = F.decode("body", "UTF-8")
    chapters = entries("OEBPS/text/*").select(_number(), F.regexp_extract("entry", r"(\d+)\.xhtml$", 1).try_cast("long").alias("chapter"), F.regexp_extract(text, "(?s)<title>(.*?)</title>", 1).alias("title"), F.md5(F.regexp_extract(text, r'(?s)<section epub:type="chapter">\n(.*)\n</section>', 1)).alias("digest"))
    links = F.regexp_extract_all(text, F.lit(r'(?s)<a href="(text/chapter\d+\.xhtml#h\d+">.*?)</a>'), 1)
    marks = entries("OEBPS/nav.xhtml").select(_number(), F.explode(links).alias("mark"))
    part = lambda k: F.regexp_extract("mark", r'(?s)^text/chapter(\d+)\.xhtml#h(\d+)">(.*)$', k)
    marks = marks.select("doc_id", part(1).try_cast("long").alias("chapter"), part(2).try_cast("int").alias("para"), F.concat(part(2), F.lit(":"), part(3)).alias("mark"))
    listed = marks.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para", "mark"))), lambda x: x["mark"]), "|").alias("marks"))
    return chapters.join(by_task(listed), ["doc_id", "chapter"], "left").select("doc_id", "chapter", "title", "digest", F.md5(F.coalesce("marks", F.lit(""))).alias("marks"))
