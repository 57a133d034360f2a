"""Book packages: what an OPF document, a container and an encryption list say, and the entries of a new package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import escape
from folio.operators.rounds import by_task
from folio.operators.structure import nested_levels

# Font obfuscation, which leaves a book readable; the root file's place.
READABLE = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
MIMETYPE = "application/epub+zip"
CONTAINER = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


def _all(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def _first(values: Column) -> Column:
    return F.get(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), 0)


def _node(name: str) -> str:
    return f"//*[local-name()='{name}']"


def opf_path(container: Column) -> Column:
    return _first(_all(container, f"{_node('rootfile')}/@full-path"))


def title(opf: Column, stem: Column) -> Column:
    return F.coalesce(_first(_all(opf, f"{_node('title')}/text()")), stem)


def language(opf: Column) -> Column:
    return _first(_all(opf, f"{_node('language')}/text()"))


def is_fixed_layout(opf: Column) -> Column:
    return F.exists(_all(opf, f"{_node('meta')}[@property='rendition:layout']/text()"), lambda x: F.trim(x) == "pre-paginated")


def page_direction(opf: Column) -> Column:
    return F.get(F.filter(_all(opf, f"{_node('spine')}/@page-progression-direction"), lambda x: x.isin("rtl", "ltr")), 0)


def spine_ids(opf: Column) -> Column:
    """The first spine's idrefs in order."""
    return _all(opf, f"({_node('spine')})[1]/*[local-name()='itemref']/@idref")


def spine(packages: DataFrame) -> DataFrame:
    """(doc_id, pos, idref) of the first spine."""
    return packages.select("doc_id", F.posexplode(spine_ids(F.col("opf_xml"))).alias("pos", "idref"))


def cover_href(opf: Column) -> Column:
    """The item with the property cover-image; else the one that meta[name=cover] names; else an image whose id or link says cover."""
    by_property = _all(opf, f"{_node('item')}[contains(concat(' ', normalize-space(@properties), ' '), ' cover-image ') and @href != '']/@href")
    named = _all(opf, f"{_node('item')}[@id = ({_node('meta')}[@name='cover'])[1]/@content and @href != '']/@href")
    low = "translate(concat(@id, @href), 'COVER', 'cover')"
    hinted = _all(opf, f"{_node('item')}[starts-with(@media-type, 'image/') and contains({low}, 'cover')]/@href")
    return F.coalesce(F.get(by_property, 0), F.get(named, 0), F.get(hinted, 0))


def is_protected(encryption: Column) -> Column:
    """Whether any algorithm but font obfuscation is named; null (no list) is readable."""
    used = _all(encryption, f"{_node('EncryptionMethod')}/@Algorithm")
    return F.coalesce(F.size(F.array_except(used, F.array(*[F.lit(x) for x in READABLE]))) > 0, F.lit(False))


def package_verdict(head: Column, mimetype: Column, container: Column, encryption: Column) -> Column:
    """ok, or why a file is no readable book."""
    return (
        F.when(F.substring(head, 1, 4) != F.expr("X'504B0304'"), "not a zip archive")
        .when(F.coalesce(F.trim(mimetype), F.lit("")).isin("", MIMETYPE) == F.lit(False), "wrong mimetype")
        .when(container.isNull(), "missing container")
        .when(is_protected(encryption), "protected by drm")
        .otherwise("ok")
    )


def pdf_verdict(head: Column, needs_password: Column, pages: Column) -> Column:
    """ok, or why a file can't be converted; the header may stand anywhere in the first 1024 bytes."""
    return (
        F.when(F.instr(F.decode(F.substring(head, 1, 1024), "ISO-8859-1"), "%PDF") == 0, "not a valid PDF")
        .when(needs_password, "password-protected")
        .when(pages == 0, "no pages")
        .otherwise("ok")
    )


def thumbnail_size(width: Column, height: Column, most: int = 200) -> tuple[Column, Column]:
    wide = width > most
    return F.when(wide, most).otherwise(width).cast("int"), F.when(wide, F.greatest(F.lit(1), F.floor(height * (F.lit(float(most)) / width)).cast("int"))).otherwise(height).cast("int")


def thumbnail_format(extension: Column, mode: Column) -> Column:
    return F.when(F.lower(extension) == ".svg", "as is").when(mode.isin("RGBA", "P", "LA"), ".png").otherwise(".jpg")


def is_cover(page: Column, chars: Column, share: Column, width: Column) -> Column:
    """Whether a page's image is the cover: page one, little text, 70 % of the page, 200 pixels wide."""
    return (page == 1) & (chars < 50) & (share >= 0.7) & (width >= 200)


def stylesheet(vertical: Column, lang: Column, all_indent: Column) -> Column:
    """The rules in their order; {p} and {indent} stand for what depends on the book."""
    indent = F.when(lang.startswith("zh"), "2em").otherwise("1em")
    flat = F.when(all_indent, F.concat(F.lit("p { margin: 0; text-indent: "), indent, F.lit("; }"))).otherwise("p { margin: 0 0 0.8em 0; text-indent: 0; }")
    plain = F.replace(F.replace(F.lit("\n".join(_RULES)), F.lit("{p}"), flat), F.lit("{indent}"), indent)
    upright = F.when(vertical, F.concat(F.lit("\n"), F.lit("\n".join(_VERTICAL)))).otherwise("")
    return F.concat(plain, upright, F.lit("\n" + "\n".join(_COVER) + "\n"))


# The rules of the stylesheet, those of vertical books, and the cover's.
_RULES = (
    "html, body { margin: 0; padding: 0; }",
    "body { line-height: 1.75; }",
    "h1, h2, h3, h4 { font-weight: bold; line-height: 1.3; }",
    "h1 { font-size: 1.6em; } h2 { font-size: 1.35em; } h3 { font-size: 1.15em; } h4 { font-size: 1em; }",
    "{p}",
    "p.indent { text-indent: {indent}; }",
    "p.noindent { text-indent: 0; }",
    "p.center, h1.center, h2.center, h3.center { text-align: center; text-indent: 0; }",
    "p.right { text-align: right; text-indent: 0; }",
    "p.small { font-size: 0.85em; }",
    ".figure { text-align: center; text-indent: 0; margin: 1em 0; }",
    ".figure img { max-width: 100%; height: auto; }",
    ".tablewrap { margin: 1em 0; }",
    "table { border-collapse: collapse; font-size: 0.9em; }",
    "td, th { border: 1px solid #999; padding: 0.2em 0.5em; vertical-align: top; }",
    "ruby { ruby-align: center; -webkit-ruby-position: over; ruby-position: over; }",
    "rt { font-size: 0.5em; line-height: 1; }",
    "sup { font-size: 0.7em; vertical-align: super; line-height: 0; }",
    "a { text-decoration: underline; }",
)
_VERTICAL = (
    "html { writing-mode: vertical-rl; -webkit-writing-mode: vertical-rl; -epub-writing-mode: vertical-rl; text-orientation: mixed; -webkit-text-orientation: mixed; -epub-text-orientation: mixed; }",
    "h1, h2, h3, h4 { margin: 0 0.5em 0 1em; }",
    "p { margin: 0; }",
    ".figure { margin: 0 1em; text-align: center; }",
    ".figure img { max-height: 100%; max-width: 100%; width: auto; height: auto; }",
    ".tablewrap { margin: 0 1em; }",
    "rt { -webkit-ruby-position: over; ruby-position: over; }",
    "section.cover { writing-mode: horizontal-tb; -webkit-writing-mode: horizontal-tb; -epub-writing-mode: horizontal-tb; }",
)
_COVER = ("section.cover { text-align: center; margin: 0; padding: 0; }", "section.cover img { max-width: 100%; max-height: 100%; }")


def chunk_entries(entries: DataFrame, spine_rows: DataFrame, chunk: int, size: int) -> DataFrame:
    """Entries of one chunk's package: all files but the spine's, and of the spine the chunk's; the mimetype stands first."""
    others = spine_rows.where(F.floor(F.col("pos") / size) != chunk).select("doc_id", F.col("idref").alias("id"))
    kept = entries.join(others, ["doc_id", "id"], "left_anti")
    return kept.withColumn("ord", F.when(F.col("name") == "mimetype", 0).otherwise(F.col("ord") + 1))


_LINK = r'(href="(?:[^"#]*/)?chapter)(-?[0-9]{4,})(\.xhtml)'


def _moved_links(xhtml: Column, offset: Column) -> Column:
    """Links to chapters, their numbers moved by offset."""
    cuts = F.split(F.regexp_replace(xhtml, _LINK, "$1\u0001$2\u0001$3"), "\u0001", -1)  # at odd places the numbers; no text in XML has that sign
    number = lambda n: F.concat(F.when(n < 0, "-").otherwise(""), F.format_string("%04d", F.abs(n)))
    return F.array_join(F.transform(cuts, lambda x, i: F.when(i % 2 == 1, number(x.try_cast("long") + offset)).otherwise(x)), "")


def split_chapters(chapters: DataFrame, size: int) -> DataFrame:
    """(doc_id, chunk, chapter, id, href, xhtml): chapters (doc_id, chapter from 0, xhtml) in chunks of `size`, each of which is a package of
    its own: it counts from 0, so ids and files of different chunks are alike, and its links have its own numbers (those to other
    chunks' chapters numbers outside it, which may be below 0)."""
    whole = chapters.select("doc_id", F.floor(F.col("chapter") / size).alias("chunk"), F.col("chapter").alias("whole"), "xhtml")  # in a lambda the new `chapter` would hide the old
    return _numbered_chapters(whole.select("doc_id", "chunk", (F.col("whole") - F.col("chunk") * size).alias("chapter"), _moved_links(F.col("xhtml"), -F.col("chunk") * size).alias("xhtml")), "chunk")


def merge_chapters(chunks: DataFrame) -> DataFrame:
    """(doc_id, chapter, chunk, id, href, xhtml) of whole books from chunks of any sizes (doc_id, chunk, chapter from 0, xhtml): what the
    chunks before hold is added to each number, in files, manifest ids and links. Only the chunks' sizes are put in order; the
    texts stay where they are."""
    sizes = chunks.groupBy("doc_id", "chunk").agg((F.max("chapter") + 1).alias("size"))
    before = F.sum("size").over(Window.partitionBy("doc_id").orderBy("chunk")) - F.col("size")
    moved = chunks.join(sizes.select("doc_id", "chunk", before.alias("before")), ["doc_id", "chunk"])
    return _numbered_chapters(moved.select("doc_id", (F.col("chapter") + F.col("before")).alias("chapter"), "chunk", _moved_links(F.col("xhtml"), F.col("before")).alias("xhtml")), "chunk")


def _numbered_chapters(chapters: DataFrame, *more: str) -> DataFrame:
    return chapters.select("doc_id", *more, "chapter", F.concat(F.lit("c"), F.col("chapter").cast("string")).alias("id"), F.format_string("text/chapter%04d.xhtml", "chapter").alias("href"), "xhtml")


def _times(text: str, n: Column) -> Column:
    return F.repeat(F.lit(text), F.greatest(n, F.lit(0)))


def _walk(entries: Column, levels: Column, before, opened) -> Column:
    """before(level, level of the one before, 0 at first) and opened(entry, number from 1) of each entry, put together."""
    place = F.sequence(F.lit(0), F.size(entries) - 1)
    return F.array_join(F.transform(place, lambda i: F.concat(before(F.get(levels, i), F.when(i == 0, 0).otherwise(F.get(levels, i - 1))), opened(F.get(entries, i), i + 1))), "")


def _shown(title: Column) -> Column:
    return F.when(F.coalesce(F.trim(title), F.lit("")) == "", "—").otherwise(escape(title))


def navigation_list(entries: Column) -> Column:
    """Entries (array of nested, title, href; as of ``nested_levels``) as nested lists."""
    levels = F.transform(entries, lambda e: e["nested"])
    before = lambda now, last: F.when(now > last, "<ol>").when(now == last, "</li>").otherwise(F.concat(_times("</li></ol>", last - now), F.lit("</li>")))
    opened = lambda e, k: F.concat(F.lit('<li><a href="'), escape(e["href"], True), F.lit('">'), _shown(e["title"]), F.lit("</a>"))
    return F.when(F.size(entries) == 0, "<ol></ol>").otherwise(F.concat(_walk(entries, levels, before, opened), F.lit("</li>"), _times("</ol></li>", F.element_at(levels, -1) - 1), F.lit("</ol>")))


def navigation_points(entries: Column) -> Column:
    """The same as nested points in play order, for readers of the older kind."""
    levels = F.transform(entries, lambda e: e["nested"])
    before = lambda now, last: _times("</navPoint>", F.when(last == 0, 0).otherwise(last - now + 1))
    number = lambda k: k.cast("string")
    opened = lambda e, k: F.concat(F.lit('<navPoint id="np'), number(k), F.lit('" playOrder="'), number(k), F.lit('"><navLabel><text>'), _shown(e["title"]), F.lit('</text></navLabel><content src="'), escape(e["href"], True), F.lit('"/>'))
    return F.when(F.size(entries) == 0, "").otherwise(F.concat(_walk(entries, levels, before, opened), _times("</navPoint>", F.element_at(levels, -1))))


def image_type(name: Column) -> Column:
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(kind.isin("png", "gif", "webp"), F.concat(F.lit("image/"), kind)).when(kind == "svg", "image/svg+xml").otherwise("image/jpeg")


def _document(title: Column, lang: Column, css: str, body: Column) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="'), escape(lang, True),
        F.lit('"><head><title>'), escape(title), F.lit(f'</title><link rel="stylesheet" type="text/css" href="{css}"/></head><body>\n'), body, F.lit("\n</body></html>\n"),
    )


def package_entries(books: DataFrame, chapters: DataFrame, images: DataFrame, covers: DataFrame | None = None, navigation: DataFrame | None = None) -> DataFrame:
    """Ordered entries (doc_id, ord, name, body, compress) of a package: mimetype (stored), container, styles, cover image and page,
    images, chapters, navigation in both kinds, package document.

    books: doc_id, title, lang, vertical, all_indent, uid, modified, and author if there is any; chapters: doc_id, chapter, title, html;
    images: doc_id, k, name, bytes; covers: doc_id, name, bytes; navigation: doc_id, idx, level, title, href. A book without chapters has
    one empty chapter; a chapter without a title has the book's if it's the first, else its number; a book without navigation has an entry a chapter.
    """
    spark = books.sparkSession
    text = lambda c: F.encode(c, "UTF-8")
    entry = lambda ord_, name, body, compress=True: [F.lit(ord_).alias("ord") if isinstance(ord_, int) else ord_.alias("ord"), (F.lit(name) if isinstance(name, str) else name).alias("name"), body.alias("body"), F.lit(compress).alias("compress")]
    covers = covers if covers is not None else spark.createDataFrame([], "doc_id long, name string, bytes binary")
    navigation = navigation if navigation is not None else spark.createDataFrame([], "doc_id long, idx long, level int, title string, href string")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    author = F.col("author") if "author" in books.columns else F.lit(None).cast("string")
    books = books.select("doc_id", F.coalesce("title", F.lit("")).alias("book"), F.when(blank(F.col("lang")), "en").otherwise(F.col("lang")).alias("lang"), "vertical", "all_indent", "uid", "modified", author.alias("author"))
    empty = books.join(by_task(chapters.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("chapter"), F.lit(None).cast("string").alias("title"), F.lit("").alias("html"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter"))
    parts = chapters.select("doc_id", "chapter", "title", "html").unionByName(empty).join(by_task(books.select("doc_id", "book", "lang")), "doc_id").withColumn("place", place)
    parts = parts.withColumn("title", F.when(~blank(F.col("title")), F.col("title")).when(F.col("place") == 1, F.col("book")).otherwise(F.concat(F.lit("Section "), F.col("place").cast("string"))))
    parts = parts.withColumn("file", F.format_string("text/chapter%04d.xhtml", "chapter"))
    section = F.concat(F.lit('<section epub:type="chapter">\n'), F.coalesce("html", F.lit("")), F.lit("\n</section>"))
    listed = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "file", "title"))).alias("cs"))
    seen = images.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("shown"))
    named = ("level", "nested", "title", "href")
    marks = nested_levels(navigation).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", *named))), lambda e: F.struct(*[e[n].alias(n) for n in named])).alias("marks"))
    top = books.join(by_task(listed), "doc_id").join(by_task(seen), "doc_id", "left").join(by_task(marks), "doc_id", "left").join(covers.select("doc_id", F.col("name").alias("cover")), "doc_id", "left")
    plain = F.transform("cs", lambda c: F.struct(F.lit(1).alias("level"), F.lit(1).alias("nested"), c["title"].alias("title"), c["file"].alias("href")))
    top = top.withColumn("nav", F.coalesce("marks", plain))
    heading = F.concat(F.lit('<nav epub:type="toc" id="toc"><h1>'), escape(F.col("book")), F.lit("</h1>\n"), navigation_list(F.col("nav")), F.lit("\n</nav>"))
    ncx = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head><meta name="dtb:uid" content="'), escape(F.col("uid"), True),
        F.lit('"/><meta name="dtb:depth" content="'), F.array_max(F.transform("nav", lambda e: e["level"])).cast("string"),
        F.lit('"/><meta name="dtb:totalPageCount" content="0"/><meta name="dtb:maxPageNumber" content="0"/></head>\n<docTitle><text>'), escape(F.col("book")),
        F.lit("</text></docTitle>\n<navMap>"), navigation_points(F.col("nav")), F.lit("</navMap>\n</ncx>\n"),
    )
    has_cover = F.col("cover").isNotNull()
    cover_items = F.when(has_cover, F.concat(F.lit('<item id="cover-image" href="images/'), escape(F.col("cover"), True), F.lit('" media-type="'), image_type(F.col("cover")), F.lit('" properties="cover-image"/><item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>'))).otherwise("")
    item = F.array_join(F.transform("cs", lambda c: F.concat(F.lit('<item id="c'), c["chapter"].cast("string"), F.lit('" href="'), c["file"], F.lit('" media-type="application/xhtml+xml"/>'))), "")
    shown = F.coalesce(F.array_join(F.transform("shown", lambda i: F.concat(F.lit('<item id="i'), i["k"].cast("string"), F.lit('" href="images/'), escape(i["name"], True), F.lit('" media-type="'), image_type(i["name"]), F.lit('"/>'))), ""), F.lit(""))
    ref = F.concat(F.when(has_cover, '<itemref idref="cover" linear="yes"/>').otherwise(""), F.array_join(F.transform("cs", lambda c: F.concat(F.lit('<itemref idref="c'), c["chapter"].cast("string"), F.lit('"/>'))), ""))
    opf = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid" xml:lang="'), escape(F.col("lang"), True),
        F.lit('"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">'), escape(F.col("uid")),
        F.lit("</dc:identifier><dc:title>"), escape(F.col("book")), F.lit("</dc:title><dc:language>"), escape(F.col("lang")), F.lit('</dc:language><meta property="dcterms:modified">'), escape(F.col("modified")), F.lit("</meta>"),
        F.when(blank(F.col("author")), "").otherwise(F.concat(F.lit("<dc:creator>"), escape(F.col("author")), F.lit("</dc:creator>"))),
        F.when(has_cover, '<meta name="cover" content="cover-image"/>').otherwise(""), F.when(F.col("vertical"), '<meta name="primary-writing-mode" content="vertical-rl"/>').otherwise(""),
        F.lit('</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="css/book.css" media-type="text/css"/>'),
        cover_items, shown, item, F.lit('</manifest><spine toc="ncx"'), F.when(F.col("vertical"), ' page-progression-direction="rtl"').otherwise(""), F.lit(">"), ref, F.lit("</spine></package>\n"),
    )
    bound = covers.join(books.select("doc_id", "book", "lang"), "doc_id")
    picture = F.concat(F.lit('<section class="cover" epub:type="cover"><img src="images/'), escape(F.col("name"), True), F.lit('" alt="'), escape(F.col("book"), True), F.lit('"/></section>'))
    out = [
        books.select("doc_id", *entry(0, "mimetype", text(F.lit(MIMETYPE)), False)),
        books.select("doc_id", *entry(1, "META-INF/container.xml", text(F.lit(CONTAINER)))),
        books.select("doc_id", *entry(2, "OEBPS/css/book.css", text(stylesheet(F.col("vertical"), F.col("lang"), F.col("all_indent"))))),
        bound.select("doc_id", *entry(3, F.concat(F.lit("OEBPS/images/"), "name"), F.col("bytes"), False)),
        bound.select("doc_id", *entry(4, "OEBPS/cover.xhtml", text(_document(F.col("book"), F.col("lang"), "css/book.css", picture)))),
        images.select("doc_id", *entry(F.col("k") + 10, F.concat(F.lit("OEBPS/images/"), "name"), F.col("bytes"), False)),
        parts.select("doc_id", *entry(F.col("chapter") + 1_000_000, F.concat(F.lit("OEBPS/"), "file"), text(_document(F.col("title"), F.col("lang"), "../css/book.css", section)))),
        top.select("doc_id", *entry(9_000_000, "OEBPS/nav.xhtml", text(_document(F.col("book"), F.col("lang"), "css/book.css", heading)))),
        top.select("doc_id", *entry(9_000_001, "OEBPS/toc.ncx", text(ncx))),
        top.select("doc_id", *entry(9_000_002, "OEBPS/content.opf", text(opf))),
    ]
    return reduce(DataFrame.unionByName, out)
