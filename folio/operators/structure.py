"""Reading order, paragraphs, chapters, inline markup and navigation."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.scripts import CJK
from folio.functions.text import CJK_OPENERS, CJK_TERMINAL, escape, strip
from folio.operators.folds import sorted_fold
from folio.operators.layout import is_ink
from folio.operators.ranges import Ranges, either
from folio.operators.rounds import bucketed, by_task, parts_for, spread, written

CHAPTER_BYTES = 250_000
STRETCH = 16  # pages
_CJK = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), CJK))


def reading_order(units: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, page, tag, ord) from units (doc_id, page, tag, box, vertical, body): a page is cut along its widest gap, and its pieces
    are, until none can be; what can't be cut is read by position.

    A gap counts along the lines' succession from 0.3 of the body's size on, across it from 1.0. All pages' pieces are cut in one
    pass of windows a round. A piece whose units have a point in common on one axis can only ever be cut on the other, so it is cut
    at all its gaps at once: rounds grow with how deep columns and bands nest, not with lines.
    """
    return ordered(units, parts).select("doc_id", "page", "tag", "ord")


def ordered(units: DataFrame, parts: int | None = None) -> DataFrame:
    """The units with `ord`, as ``reading_order`` says, dealt by page."""
    piece = ["doc_id", "page", "path"]
    w = Window.partitionBy(*piece)
    low = {a: F.least(a + "0", a + "1") for a in "xy"}
    high = {a: F.greatest(a + "0", a + "1") for a in "xy"}
    in_order = {a: w.orderBy(low[a], high[a], "tag") for a in "xy"}
    reach = {a: low[a] - F.max(high[a]).over(in_order[a].rowsBetween(Window.unboundedPreceding, -1)) for a in "xy"}
    least = {a: F.when(F.col("vertical") == F.lit(a == "x"), 0.3).otherwise(1.0) * F.col("body") for a in "xy"}
    todo, done = units.withColumn("path", F.lit("")), []
    while True:
        u = spread(todo, "doc_id", "page", parts=None if done else parts).withColumns({f"gap_{a}": F.when((reach[a] > 0.5) & (reach[a] >= least[a]), reach[a]) for a in "xy"})
        # the widest gap, the first of equals, and whether all units of the piece have a point of the axis in common
        widest = {f"widest_{a}": F.max(F.when(F.col(f"gap_{a}").isNotNull(), F.struct(F.col(f"gap_{a}").alias("gap"), (-low[a]).alias("at")))).over(w) for a in "xy"}
        common = {f"common_{a}": F.max(low[a]).over(w) <= F.min(high[a]).over(w) + 0.5 for a in "xy"}
        u = u.withColumns(widest | common)
        wide = {a: F.coalesce(F.col(f"widest_{a}.gap"), F.lit(0.0)) for a in "xy"}
        axis = F.when((wide["x"] == 0) & (wide["y"] == 0), None).when(wide["x"] > wide["y"], "x").otherwise("y")
        u = u.withColumn("axis", axis)
        cuts = {}
        for a, other in ("xy", "yx"):
            one = (F.col(f"gap_{a}") == wide[a]) & (-low[a] == F.col(f"widest_{a}.at"))
            cut = F.when(F.col(f"common_{other}"), F.col(f"gap_{a}").isNotNull()).otherwise(one)
            # of units that begin at one place only the first has the gap before it
            cuts[a] = F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(in_order[a])
        k = F.when(F.col("axis") == "x", cuts["x"]).otherwise(cuts["y"])
        k = F.when((F.col("axis") == "x") & F.col("vertical"), 999_999 - k).otherwise(k)  # columns of vertical lines are read from the right
        u = u.withColumn("next", F.when(F.col("axis").isNotNull(), F.concat("path", F.lpad(k.cast("string"), 6, "0"))))
        whole = F.when(F.col("axis") == "x", F.col("common_y")).otherwise(F.col("common_x"))
        u = written(u.select(*units.columns, F.coalesce("next", "path").alias("path"), (F.col("axis").isNotNull() & ~whole).alias("on")), "order")
        done.append(u.where("NOT on").drop("on"))
        if u.where("on").limit(1).count() == 0:
            break
        todo = u.where("on").drop("on")
    out = spread(reduce(DataFrame.unionByName, done), "doc_id", "page", parts=parts)
    by = [F.col("path"), F.when(F.col("vertical"), -F.col("x1")).otherwise(F.col("y0")), F.when(F.col("vertical"), F.col("y0")).otherwise(F.col("x0")), F.col("tag")]
    return out.select(*units.columns, (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*by)) - 1).alias("ord"))


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, unit, line, text, indented) with the number of their paragraph in the unit: a new one begins at an indent
    after none, or where a CJK opener follows a CJK terminal."""
    w = Window.partitionBy("doc_id", "unit").orderBy("line")
    before, text = strip(F.lag("text").over(w)), strip(F.col("text"))
    quote = F.right(before, F.lit(1)).rlike(f"[{CJK_TERMINAL}]") & F.left(text, F.lit(1)).rlike(f"[{CJK_OPENERS}]")
    fresh = F.lag("text").over(w).isNotNull() & ((F.col("indented") & ~F.lag("indented").over(w)) | quote)
    return lines.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn("para", F.sum("fresh").over(w)).drop("fresh")


def is_indented(edge: Column, margin: Column, size: Column) -> Column:
    """Half a size to four sizes inside the modal edge; not without one."""
    return F.coalesce((edge - margin > size * 0.5) & (edge - margin < size * 4), F.lit(False))


def is_full(edge: Column, margin: Column, size: Column) -> Column:
    """Less than a size short of the modal edge, or there is none."""
    return F.coalesce(margin - edge < size, F.lit(True))


def alignment(gap_before: Column, gap_after: Column, size: Column, width: Column) -> Column:
    """center, right or null for a one-run unit, by its distances from the margins."""
    centred = (gap_before > size) & (gap_after > size) & (F.abs(gap_before - gap_after) < F.greatest(size, width * 0.12))
    return F.when(centred, "center").when((gap_after < size * 0.5) & (gap_before > size * 3), "right")


@dataclass
class _Flow:
    """What building paragraphs remembers of a document: where it is, and of the paragraph that may go on its end."""

    chapter: int = 0
    para: int = -1
    size: int = 0  # of the chapter so far, about, in bytes
    started: bool = False
    page: int | None = None
    on: Any = None  # the last unit of the open paragraph; None if none is open
    like: Any = None  # its first unit
    solid: str = ""  # its last character that isn't blank


def _goes_on(s: _Flow, u: Any) -> bool:
    """Whether a text unit continues the open paragraph. Across pages no gap counts, which heals page breaks."""
    if s.on is None or u.toc_level is not None or (getattr(u, "n_ids", None) or 0) > 1 or u.align or s.like.align or u.indented or not s.on.full:
        return False
    alike = abs(u.size - s.like.size) <= 0.15 * max(u.size, s.like.size) and u.vertical == s.like.vertical
    speech = s.solid != "" and s.solid in CJK_TERMINAL and u.text.lstrip()[:1] in tuple(CJK_OPENERS)
    near = s.on.page != u.page or u.gap <= (1.4 if u.vertical else 1.2) * u.size
    return alike and near and not speech


def _place(s: _Flow, u: Any, chapter_bytes: int) -> tuple:
    """The paragraph of a unit, and the piece of text that it adds to it."""
    turned, s.page = s.page != u.page, u.page
    is_text, marked = u.kind == "text", u.toc_level is not None
    heading = is_text and (bool(u.heading) or (marked and u.nchars <= 160 and u.n_runs <= 4))
    level = max(1, min(4, int(u.toc_level) if marked else int(u.ladder_level))) if heading else 0
    top = u.toc_level == 1 or (heading and level == 1 and (marked or not u.has_toc))
    if is_text and s.started and (top or (turned and s.size > chapter_bytes)):
        s.chapter, s.size, s.started, s.on = s.chapter + 1, 0, False, None
    text, classes = u.text or "", u.align or ""
    if is_text and not heading and _goes_on(s, u):
        piece = ("" if _CJK.match(s.on.text[-1:]) or _CJK.match(text[:1]) else " ") + text
        s.size += 3 * u.nchars
    else:
        piece, s.para, s.started = text, s.para + 1, True
        s.size += 3 * len(text) + 40
        s.like, s.solid = (u, "") if is_text and not heading else (None, "")
        if s.like is not None:
            classes = " ".join([u.align or ("indent" if u.indented else "noindent"), *(["small"] if u.size <= 0.85 * u.body else [])])
    s.on = u if s.like is not None else None
    s.solid = text.rstrip()[-1:] or s.solid
    return u.doc_id, s.para, u.page, u.ord, s.chapter, "h" if heading else "p" if is_text else u.kind, level, classes, piece


def build_paragraphs(units: DataFrame, chapter_bytes: int = CHAPTER_BYTES) -> DataFrame:
    """Paragraphs and chapters of a document: a fold over its units in order of page and ord says where each goes, and their pieces of
    text are put together. A document may be of any length.

    units: doc_id, page, ord, kind (text, image, table), text, nchars, size, body, n_runs, heading (bool), ladder_level, toc_level (or
    null), has_toc, indented, full, align (or null), vertical, gap, and n_ids (of anchors) if there are any. Result: doc_id, chapter, para, kind, level, page, classes, text.
    """
    placed = sorted_fold(units, ["doc_id"], ["page", "ord"], _Flow, lambda s, u: _place(s, u, chapter_bytes), "doc_id long, para int, page int, ord int, chapter int, kind string, level int, classes string, piece string")
    first = F.min_by(F.struct("chapter", "kind", "level", "page", "classes"), F.struct("page", "ord")).alias("f")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "ord", "piece"))), lambda x: x["piece"]), "").alias("text")
    return placed.groupBy("doc_id", "para").agg(first, text).select("doc_id", "f.chapter", "para", "f.kind", "f.level", "f.page", "f.classes", "text")


def _gap_limit() -> Column:
    return F.when(F.col("vertical"), 1.4).otherwise(1.2) * F.col("size")


def dealt(units: DataFrame, parts: int | None = None) -> DataFrame:
    """Units dealt by stretches of a document's pages (`stretch`), each in one task: windows within a stretch need no other exchange."""
    return units.withColumn("stretch", F.expr(f"page div {STRETCH}")).repartition(parts or parts_for(units.sparkSession, 0), "doc_id", "stretch")


def scanned_paragraphs(units: DataFrame, chapter_bytes: int = CHAPTER_BYTES, parts: int | None = None) -> DataFrame:
    """What ``build_paragraphs`` gives, with a document in many tasks. Units may be ``dealt`` already, to as many parts.

    The texts move once, to stretches of pages, and are kept in buckets of these, which later passes read where they lie. What goes
    between stretches is a row or two of each. Nearly all that decides whether a unit goes on is said by it and the one before; runs
    that go on thereby are paragraphs, and so are their stretches of one size, but where sizes drift each unit has to be held against
    its paragraph's first: only such runs are folded. Chapters that are full end at the first page after: a fold over the pages' first
    units and the bytes before them. A chapter that begins within a folded run changes what follows in it, so that document is
    folded whole.
    """
    n_ids = F.coalesce("n_ids", F.lit(0)) if "n_ids" in units.columns else F.lit(0)
    text, mark, here, key = F.coalesce("text", F.lit("")), F.col("toc_level"), ["doc_id", "stretch"], ["doc_id", "page", "ord"]
    is_text = F.col("kind") == "text"
    head = is_text & either(F.col("heading"), mark.isNotNull() & (F.col("nchars") <= 160) & (F.col("n_runs") <= 4))
    level = F.when(F.col("head"), F.least(F.lit(4), F.greatest(F.lit(1), F.coalesce(mark, "ladder_level")))).otherwise(0)
    top = is_text & either(mark == 1, F.col("head") & (level == 1) & (mark.isNotNull() | ~F.col("has_toc")))
    aligned = F.coalesce(F.col("align"), F.lit("")) != ""
    small = F.when(F.col("size") <= 0.85 * F.col("body"), " small").otherwise("")
    classes = F.when(is_text & ~F.col("head"), F.concat(F.when(aligned, F.col("align")).when(either(F.col("indented")), "indent").otherwise("noindent"), small)).otherwise(F.coalesce("align", F.lit("")))
    rows = (units if "stretch" in units.columns else dealt(units, parts)).withColumns({"head": head, "stripped": strip(text)})
    rows = rows.select(
        *key, "stretch", "size", F.when(F.col("head"), "h").when(is_text, "p").otherwise(F.col("kind")).alias("kind"), level.cast("int").alias("level"), classes.alias("classes"), text.alias("text"),
        top.alias("top"), is_text.alias("is_text"), (is_text & ~F.col("head")).alias("plain"), either(F.col("full")).alias("full"), aligned.alias("aligned"), "vertical",
        either(mark.isNotNull(), n_ids > 1, F.col("indented")).alias("own_start"), either(F.col("gap") <= _gap_limit()).alias("near"), F.length(text).alias("length"), F.coalesce("nchars", F.lit(0)).alias("nchars"),
        F.when(F.col("stripped") != "", F.right("stripped", F.lit(1))).alias("solid"), F.left("stripped", F.lit(1)).rlike(f"^[{CJK_OPENERS}]").alias("opens"), F.right(text, F.lit(1)).alias("end"))
    facts = ("size", "plain", "page", "full", "aligned", "vertical", "solid", "end")
    order, said = Window.partitionBy(*here).orderBy("page", "ord"), ("forced", "turned", "unsure", "jump", "drift", "b_end")

    def held(df: DataFrame, w) -> DataFrame:
        """With what each unit and the one before, if the window has any, say."""
        df = df.withColumn("b", F.lag(F.struct(*facts)).over(w))
        b = lambda c: F.col(f"b.{c}")
        speech = b("solid").rlike(f"^[{CJK_TERMINAL}]") & F.col("opens")
        forced = either(F.col("b").isNull(), ~F.col("plain"), ~b("plain"), F.col("top"), F.col("own_start"), F.col("aligned"), b("aligned"), ~b("full"), F.col("vertical") != b("vertical"), (b("page") == F.col("page")) & ~F.col("near"), speech)
        df = df.withColumns({"forced": forced, "turned": either(F.col("b").isNull(), b("page") != F.col("page")), "b_end": b("end")})
        jump = ~F.col("forced") & either(F.abs(F.col("size") - b("size")) > 0.15 * F.greatest("size", b("size")))
        df = df.withColumns({"jump": jump, "unsure": ~F.col("forced") & either(F.col("opens") & b("solid").isNull())})
        return df.withColumn("drift", ~F.col("forced") & ~F.col("jump") & either(F.col("size") != b("size")))

    rows = held(rows, order).withColumns({"opening": F.col("b").isNull(), "closing": F.lead("page").over(order).isNull()})
    rows = bucketed(rows.drop("b"), parts or parts_for(units.sparkSession, 0), "paragraphs", here)

    # a stretch's first unit, held against the last of the stretch before
    ends = rows.where("opening OR closing").select(*key, "stretch", "opening", *[c for c in facts if c != "page"], "top", "own_start", "near", "opens")
    ends = held(ends, Window.partitionBy("doc_id").orderBy("page", "ord")).where("opening")
    firsts = written(ends.select(*here, *[F.col(c).alias(f"f_{c}") for c in said], F.col("b").isNull().alias("first")), "paragraphs")
    whole_row = rows.join(by_task(firsts), here).withColumns({c: F.when(F.col("opening"), F.col(f"f_{c}")).otherwise(F.col(c)) for c in said}).withColumn("first", F.col("opening") & F.col("first")).drop(*[f"f_{c}" for c in said])

    # runs in which sizes drift, or that may part after a blank unit
    doubted = rows.where("NOT opening AND (drift OR unsure)").select("doc_id").union(firsts.where("f_drift OR f_unsure").select("doc_id")).distinct()
    runs = whole_row.join(doubted, "doc_id", "left_semi").select(*key, "stretch", "size", "solid", "forced", "jump", "drift", "unsure")
    runs = runs.withColumn("run", F.last(F.when(F.col("forced"), F.struct("page", "ord")), True).over(order))
    carried = runs.groupBy(*here).agg(F.max("run").alias("run")).select(*here, F.last("run", True).over(Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    runs = runs.join(by_task(carried), here).withColumn("run", F.coalesce("run", "carried")).select(*key, "stretch", F.col("run.page").alias("run_page"), F.col("run.ord").alias("run_ord"), "size", "solid", "jump", "drift", "unsure")
    run = ["doc_id", "run_page", "run_ord"]
    over = Window.partitionBy(*run)
    mixed = runs.withColumn("mixed", F.max("unsure").over(over) | (F.max("drift").over(over) & (F.max("size").over(over) - F.min("size").over(over) > 0.15 * F.max("size").over(over) - 1e-9))).where("mixed").drop("mixed")

    def within(state: list, row) -> tuple:
        """state: size of the paragraph's first unit, and its last character that isn't blank."""
        start = not state or abs(row.size - state[0]) > 0.15 * max(row.size, state[0]) or (bool(row.unsure) and state[1] != "" and state[1] in CJK_TERMINAL)
        state[:] = [row.size if start else state[0], row.solid or ("" if start else state[1])]
        return row.doc_id, row.stretch, row.page, row.ord, start, bool(row.jump)

    folded = written(sorted_fold(mixed, run, ["page", "ord"], list, within, "doc_id long, stretch long, page int, ord int, split boolean, jump boolean"), "mixed")
    place = F.struct("page", "ord")
    of = lambda df, name: df.groupBy(*here).agg(F.collect_list(place).alias(name))
    has = lambda name: either(F.array_contains(name, place))
    folds = folded.groupBy(*here).agg(F.collect_list(F.when(F.col("split") != F.col("jump"), place)).alias("other"), F.collect_list(place).alias("folded"))
    started = lambda df: df.join(by_task(folds), here, "left").withColumn("start", F.col("forced") | (F.col("jump") != has("other")))

    # bytes and starts so far in each stretch, where pages turn or a heading stands, and at its end
    u = started(whole_row.select(*key, "stretch", "forced", "jump", "turned", "top", "is_text", "first", "closing", "length", "nchars"))
    u = u.withColumn("bytes", F.when(F.col("start"), 3 * F.col("length") + 40).otherwise(3 * F.col("nchars")).cast("long"))
    u = u.withColumns({"so_far": F.sum("bytes").over(order), "starts": F.sum(F.col("start").cast("long")).over(order), "turn": F.col("is_text") & ~F.col("first") & (F.col("turned") | F.col("top"))}).where("turn OR closing")
    u = written(u.select(*key, "stretch", "closing", "turn", "top", "start", "so_far", "starts", (F.col("so_far") - F.col("bytes")).alias("at"), (3 * F.col("length") + 40 - F.col("bytes")).alias("more"), has("folded").alias("mixed")), "paragraphs")
    earlier = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = u.where("closing").select(*here, "starts", F.coalesce(F.sum("so_far").over(earlier), F.lit(0)).alias("bytes_before"))
    turns = u.where("turn").join(by_task(sums.select(*here, "bytes_before")), here).select(*key, "stretch", (F.col("at") + F.col("bytes_before")).alias("at"), "more", "top", "start", "mixed")

    def chapter(state: list, row) -> tuple | None:
        """state: bytes before the chapter, less what its first unit has more by beginning it."""
        begin = state[0] if state else 0
        if not (row.top or row.at - begin > chapter_bytes):
            return None
        state[:] = [row.at - row.more]
        return row.doc_id, row.stretch, row.page, row.ord, bool(row.start), bool(row.mixed and not row.start)

    begins = written(sorted_fold(turns, ["doc_id"], ["page", "ord"], list, chapter, "doc_id long, stretch long, page int, ord int, start boolean, within boolean"), "chapters")
    whole = begins.where("within").select("doc_id").distinct()
    begun = begins.groupBy(*here).agg(F.collect_list(place).alias("begins"), F.count_if(~F.col("start")).alias("more"))
    sums = sums.join(by_task(begun), here, "left").withColumns({"n": F.col("starts") + F.coalesce("more", F.lit(0)), "c": F.coalesce(F.size("begins"), F.lit(0))})
    before = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0)).cast("int")
    at = sums.select(*here, "begins", before("n").alias("para_before"), before("c").alias("chapter_before"), F.last(F.when(F.col("n") > 0, F.col("stretch")), True).over(earlier).alias("home"), F.col("n").cast("int").alias("n"))
    at = written(at.join(by_task(firsts.select(*here, (F.col("f_forced")).alias("sure"))), here), "paragraphs")

    def placed(at: DataFrame) -> DataFrame:
        """The units of these stretches with their paragraphs' numbers, and the piece that each adds to its paragraph's text."""
        u = started(whole_row.select(*key, "stretch", "forced", "jump", "b_end", "kind", "level", "classes", "text").join(by_task(at), here))
        u = u.withColumn("begin", has("begins")).withColumn("start", F.col("start") | F.col("begin"))
        joined = F.when(F.col("start"), "").when(F.col("b_end").rlike(CJK) | F.left("text", F.lit(1)).rlike(CJK), "").otherwise(" ")
        u = u.select(*key, "stretch", "home", "start", "kind", "level", "classes", F.concat(joined, "text").alias("piece"), "para_before", "n", *[(F.sum(F.col(c).cast("int")).over(order) + F.col(f"{k}_before")).cast("int").alias(k) for c, k in (("start", "para"), ("begin", "chapter"))])
        return u.withColumn("para", F.col("para") - 1)

    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "ord", "piece"))), lambda x: x["piece"]), "")
    # what goes on from the stretches before is sent to where its paragraph began
    on = placed(at.where("NOT sure")).where(F.col("para") < F.col("para_before"))
    on = on.groupBy(*here, "home").agg(pieces.alias("piece")).groupBy("doc_id", F.col("home").alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("stretch").alias("s"), "piece"))), lambda x: x["piece"]), "").alias("on"))
    first = F.struct("chapter", "kind", "level", "page", "classes")
    out = placed(at).where(F.col("para") >= F.col("para_before")).groupBy(*here, "para").agg(F.min_by(first, place).alias("f"), pieces.alias("text"), F.max(F.col("para_before") + F.col("n") - 1).alias("last")).join(by_task(on), here, "left")
    out = out.withColumn("text", F.concat("text", F.when(F.col("para") == F.col("last"), F.coalesce("on", F.lit(""))).otherwise(""))).select("doc_id", "f.chapter", "para", "f.kind", "f.level", "f.page", "f.classes", "text")
    if whole.limit(1).count() == 0:
        return out
    return out.join(whole, "doc_id", "left_anti").unionByName(build_paragraphs(units.join(whole, "doc_id", "left_semi"), chapter_bytes))


def indent_vote(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, all_indent): whether indented paragraphs outnumber the others; aligned ones have no vote."""
    p = F.col("kind") == "p"
    votes = paragraphs.where(p).groupBy("doc_id").agg(F.count_if(F.col("classes").rlike(r"\bindent\b")).alias("indent"), F.count_if(F.col("classes").rlike(r"\bnoindent\b")).alias("noindent"))
    return votes.withColumn("all_indent", F.col("indent") > F.col("noindent"))


def inline_html(glyphs: DataFrame, in_heading: bool = False) -> DataFrame:
    """(doc_id, para, html) from glyphs (doc_id, para, pos, c, link, bold, italic, sup, mono, ruby): islands of one style, tags around each.

    Bold throughout says nothing and is dropped; in a heading, italic throughout, too, and any bold. ruby is the reading of a
    glyph's group or null; consecutive glyphs with one ruby_id share it.
    """
    p = Window.partitionBy("doc_id", "para")
    w = p.orderBy("pos")
    solid = is_ink(F.col("c"))
    every = lambda c: F.bool_and(F.when(solid, F.col(c)).otherwise(True)).over(p)
    g = glyphs.withColumn("b", F.col("bold") & ~(F.lit(in_heading) | every("bold"))).withColumn("i", F.col("italic") & ~(F.lit(in_heading) & every("italic")))
    style = F.struct(F.coalesce("link", F.lit("")).alias("link"), "b", "i", "sup", "mono")
    g = g.withColumn("style", style).withColumn("rid", F.coalesce("ruby_id", F.lit(-1)))
    g = g.withColumn("s", F.sum(F.when(F.lag("style").over(w) == F.col("style"), 0).otherwise(1)).over(w)).withColumn("r", F.sum(F.when((F.col("rid") >= 0) & (F.lag("rid").over(w) == F.col("rid")), 0).otherwise(1)).over(w))
    pieces = g.groupBy("doc_id", "para", "r").agg(F.min("pos").alias("pos"), F.min("s").alias("s"), F.min_by("style", "pos").alias("style"), F.max("ruby").alias("ruby"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: escape(x["c"])), "").alias("t"))
    pieces = pieces.withColumn("t", F.when(F.col("ruby").isNotNull(), F.concat(F.lit("<ruby>"), "t", F.lit("<rt>"), escape(F.col("ruby")), F.lit("</rt></ruby>"))).otherwise(F.col("t")))
    runs = pieces.groupBy("doc_id", "para", "s").agg(F.min_by("style", "pos").alias("style"), F.min("pos").alias("pos"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("t"))
    opened, closed = F.lit(""), F.lit("")
    for name, tag in (("b", "strong"), ("i", "em"), ("sup", "sup"), ("mono", "code")):
        opened = F.concat(opened, F.when(F.col(f"style.{name}"), f"<{tag}>").otherwise(""))
        closed = F.concat(F.when(F.col(f"style.{name}"), f"</{tag}>").otherwise(""), closed)
    link = F.col("style.link")
    opened = F.concat(F.when(link != "", F.concat(F.lit('<a href="'), escape(link, True), F.lit('">'))).otherwise(""), opened)
    closed = F.concat(closed, F.when(link != "", "</a>").otherwise(""))
    runs = runs.withColumn("t", F.concat(opened, "t", closed))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "")
    return runs.groupBy("doc_id", "para").agg(F.regexp_replace(joined, r"[ \t]{2,}", " ").alias("html"))


def paragraph_html(kind: Column, level: Column, ids: Column, classes: Column, body: Column, image: Column, width: Column, all_indent: Column) -> Column:
    """A paragraph as markup; ids beyond the first become empty spans."""
    first = F.when(F.size(ids) > 0, F.concat(F.lit(' id="'), F.get(ids, 0), F.lit('"'))).otherwise("")
    spans = F.array_join(F.transform(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), lambda i: F.concat(F.lit('<span id="'), i, F.lit('"></span>'))), "")
    shown = F.filter(classes, lambda c: ~((all_indent & (c == "indent")) | (~all_indent & (c == "noindent"))))
    cls = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(' class="'), F.array_join(c, " "), F.lit('"'))).otherwise("")
    tag = F.concat(F.lit("h"), level.cast("string"))
    sized = F.when((width > 0) & (width < 300), F.concat(F.lit(' width="'), width.cast("string"), F.lit('"'))).otherwise("")
    return (
        F.when(kind == "image", F.concat(F.lit('<div class="figure"'), first, F.lit(">"), spans, F.lit('<img src="../images/'), image, F.lit('" alt=""'), sized, F.lit("/></div>")))
        .when(kind == "table", F.concat(F.lit('<div class="tablewrap"'), first, F.lit(">"), spans, body, F.lit("</div>")))
        .when(kind == "h", F.concat(F.lit("<"), tag, first, cls(classes), F.lit(">"), spans, body, F.lit("</"), tag, F.lit(">")))
        .when((F.trim(body) == "") & (spans == ""), "")
        .when(F.trim(body) == "", F.concat(F.lit("<p"), first, F.lit(">"), spans, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p"), first, cls(shown), F.lit(">"), spans, body, F.lit("</p>")))
    )


def clamped_levels(levels: Column) -> Column:
    """Nesting of a list of entries: the first is at 1, and none is more than one below the one before."""
    return F.aggregate(levels, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, F.lit(1)).otherwise(F.least(x, F.element_at(acc, -1) + 1)))))


def nested_levels(entries: DataFrame, by: str = "doc_id", order: str = "idx", level: str = "level") -> DataFrame:
    """entries with `nested`: the first of each list is at 1, and none is more than one below the one before. As level_i = min(level_i,
    level_(i-1) + 1) is i + the least level_j - j so far, a window says it."""
    w = Window.partitionBy(by).orderBy(order)
    rows = entries.withColumn("at__", F.row_number().over(w) - 1)
    least = F.min(F.when(F.col("at__") == 0, F.lit(1)).otherwise(F.col(level)) - F.col("at__")).over(w)
    return rows.withColumn("nested", (F.col("at__") + least).cast("int")).drop("at__")


def chapters(starts: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para, starts) with the running number of their chapter."""
    return starts.withColumn("chapter", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("doc_id").orderBy("para")))


def page_anchors(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, anchor, ord): each page's anchor and the unit that carries it: its first, or that of the next page that has one. A
    document's pages may lie in many tasks."""
    firsts = units.groupBy("doc_id", "page").agg(F.min("ord").alias("ord"))
    r = Ranges(pages.select("doc_id", "page").join(firsts, ["doc_id", "page"], "left"), ["doc_id"], ["page"])
    rows = r.scan(r.rows, carrier=("next", F.col("ord")))
    return rows.select("doc_id", "page", F.concat(F.lit("pg"), F.col("page").cast("string")).alias("anchor"), F.col("carrier").alias("ord"))


def navigation_targets(toc: DataFrame, anchors: DataFrame, page_chapters: DataFrame) -> DataFrame:
    """(doc_id, idx, href): the bookmark's own anchor, else the chapter of its page or of the next, else the first chapter."""
    own = anchors.select("doc_id", "idx", F.col("href").alias("own"))
    c = page_chapters.select("doc_id", F.col("page").alias("c_page"), F.col("href").alias("later"))
    w = Window.partitionBy("doc_id").orderBy("page", "side").rowsBetween(0, Window.unboundedFollowing)
    both = toc.select("doc_id", "idx", F.col("page1").alias("page"), F.lit(None).cast("string").alias("later"), F.lit(0).alias("side")).unionByName(c.select("doc_id", F.lit(None).cast("long").alias("idx"), F.col("c_page").alias("page"), "later", F.lit(1).alias("side")))
    ahead = both.withColumn("next", F.first("later", True).over(w)).where("side = 0").select("doc_id", "idx", "next")
    first = c.groupBy("doc_id").agg(F.min_by("later", "c_page").alias("first"))
    return ahead.join(own, ["doc_id", "idx"], "left").join(first, "doc_id", "left").select("doc_id", "idx", F.coalesce("own", "next", "first").alias("href"))


def navigation_entries(paragraphs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, idx, level) of a book's navigation in its order: its bookmarks (doc_id, idx, level), else its headings of the first two
    levels, else an entry at 1 for each chapter."""
    marks = (toc if toc is not None else paragraphs.sparkSession.createDataFrame([], "doc_id long, idx long, level int")).select("doc_id", F.col("idx").cast("long").alias("idx"), "level")
    unmarked = paragraphs.join(marks.select("doc_id").distinct(), "doc_id", "left_anti")
    heads = unmarked.where("kind = 'h' AND level <= 2").select("doc_id", F.col("para").cast("long").alias("idx"), "level")
    plain = unmarked.join(heads.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("chapter").cast("long").alias("idx")).distinct().withColumn("level", F.lit(1))
    return marks.unionByName(heads).unionByName(plain)


def result_counts(paragraphs: DataFrame, toc: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chapters, n_images, depth, tree_depth): non-empty chapters, images, the deepest level that the navigation names, and
    how deep it nests, as no entry is more than one below the one before."""
    sums = paragraphs.groupBy("doc_id").agg(F.countDistinct("chapter").alias("n_chapters"), F.count_if(F.col("kind") == "image").alias("n_images"))
    levels = nested_levels(navigation_entries(paragraphs, toc)).groupBy("doc_id").agg(F.max("level").alias("depth"), F.max("nested").alias("tree_depth"))
    return sums.join(levels, "doc_id").select("doc_id", "n_chapters", "n_images", "depth", "tree_depth")
