"""The conversion of books, from the pieces of their pages to packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import escape
from folio.operators.package import package_entries
from folio.operators.rounds import by_task, written
from folio.operators.structure import CHAPTER_BYTES, dealt, indent_vote, ordered, paragraph_html, scanned_paragraphs


def ordered_units(units: DataFrame, parts: int | None = None) -> DataFrame:
    """Units (doc_id, page, tag, box, vertical, body, ...) with `ord`, their place on the page in reading order, and `gap`, how far they lie
    behind the one before them, but without the box; ``dealt``. Places and units meet by a window where they are dealt to, so that texts move once."""
    box = ("x0", "y0", "x1", "y1")
    order = ordered(units.select("doc_id", "page", "tag", *box, "vertical", "body"), parts)
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    gap = F.when(F.col("vertical"), F.lag("x0").over(w) - F.col("x1")).otherwise(F.col("y0") - F.lag("y1").over(w))
    places = order.select("doc_id", "page", "tag", F.struct("ord", F.coalesce(gap, F.lit(0.0)).alias("gap")).alias("place"))
    both = dealt(units.drop(*box).withColumn("own", F.lit(True)).unionByName(places, allowMissingColumns=True), parts)
    met = both.withColumn("place", F.max("place").over(Window.partitionBy("doc_id", "stretch", "page", "tag"))).where("own")
    return met.select("*", "place.ord", "place.gap").drop("own", "place")


def chapter_markup(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of paragraphs as ``scanned_paragraphs`` gives them: chapters (doc_id, chapter, title, html), titled by their first heading, and the
    navigation (doc_id, idx, level, title, href) of the headings of the first two levels."""
    votes = indent_vote(paragraphs).select("doc_id", "all_indent")
    heading = F.when(F.col("kind") == "h", F.col("text"))  # of its own, so that what wants titles alone moves no texts
    # dealt as the package's own windows and joins need it: texts move once
    p = paragraphs.select("doc_id", "chapter", "para", "kind", "level", "classes", "text", heading.alias("heading")).repartition("doc_id").join(by_task(votes), "doc_id", "left")
    none = F.array().cast("array<string>")
    name = F.concat(F.lit("h"), F.col("para").cast("string"))
    html = paragraph_html(
        F.col("kind"), F.col("level"), F.when(F.col("kind") == "h", F.array(name)).otherwise(none), F.when(F.col("classes") == "", none).otherwise(F.split("classes", " ")), escape(F.col("text")),
        F.lit(""), F.lit(0), F.coalesce("all_indent", F.lit(False)))
    parts = F.sort_array(F.collect_list(F.struct("para", html.alias("html"))))
    chapters = p.groupBy("doc_id", "chapter").agg(
        F.min_by("heading", F.when(F.col("kind") == "h", F.col("para"))).alias("title"), F.array_join(F.transform(parts, lambda x: x["html"]), "\n").alias("html"))
    href = F.concat(F.format_string("text/chapter%04d.xhtml#", "chapter"), name)
    navigation = paragraphs.where("kind = 'h' AND level <= 2").select("doc_id", F.col("para").cast("long").alias("idx"), "level", F.col("text").alias("title"), href.alias("href"))
    return chapters, navigation


def converted_books(books: DataFrame, units: DataFrame, chapter_bytes: int = CHAPTER_BYTES, parts: int | None = None) -> DataFrame:
    """Entries (doc_id, ord, name, body, compress) of a package for each book: its units in reading order, put together to paragraphs and
    chapters, as markup with a navigation.

    books: as ``package_entries`` takes them, but for all_indent, which the paragraphs decide; units: doc_id, page, tag, box,
    vertical, body, and what ``scanned_paragraphs`` takes but for ord and gap, in any order. parts: tasks that the units are dealt to.
    """
    paragraphs = written(scanned_paragraphs(ordered_units(units, parts), chapter_bytes, parts), "book-paragraphs")
    chapters, navigation = chapter_markup(paragraphs)
    votes = indent_vote(paragraphs).select("doc_id", "all_indent")
    books = books.join(by_task(votes), "doc_id", "left").withColumn("all_indent", F.coalesce("all_indent", F.lit(False)))
    images = books.sparkSession.createDataFrame([], "doc_id long, k int, name string, bytes binary")
    return package_entries(books, chapters, images, navigation=navigation)
