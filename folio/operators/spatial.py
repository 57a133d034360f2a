"""Spatial joins inside a page: links, tables, images, ruby and runs. Every join has the page as an equality, so it hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.scripts import BLANK
from folio.functions.text import overlap, strip
from folio.operators.folds import sorted_fold

PAGE = ["doc_id", "page"]
BOX = ("x0", "y0", "x1", "y1")
# Kana, bopomofo and the marks that readings have.
READING = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3100}-\x{312F}\x{31A0}-\x{31BF}ー゛゜ˊˇˋ˙・]"
STRIP = 24.0  # points; both sides of a point-in-box join meet by strips of y


def _named(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(n).alias(prefix + n) for n in names])


def _strips(y0: Column, y1: Column) -> Column:
    return F.explode(F.sequence(F.floor(y0 / STRIP), F.floor(y1 / STRIP)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, margin: float, *names: str) -> DataFrame:
    """Points (doc_id, page, cx, cy, ...) with each box that holds them, widened by margin; boxes' columns get the prefix b_."""
    b = _named(boxes, "b_", *BOX, *names).withColumn("strip", _strips(F.col("b_y0") - margin, F.col("b_y1") + margin))
    p = points.withColumn("strip", F.floor(F.col("cy") / STRIP))
    inside = F.col("cx").between(F.col("b_x0") - margin, F.col("b_x1") + margin) & F.col("cy").between(F.col("b_y0") - margin, F.col("b_y1") + margin)
    return p.join(b, [*PAGE, "strip"]).where(inside).drop("strip")


def link_hits(glyphs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, g, k, href): the first link, by k, whose rectangle (1 point wider) holds the glyph's centre."""
    met = points_in_boxes(glyphs.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2), links, 1.0, "k", "href")
    return met.groupBy(*PAGE, "g").agg(F.min("b_k").alias("k"), F.min_by("b_href", "b_k").alias("href"))


def link_columns(runs: DataFrame, links: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, page, k, href, run, y0, y1) for links whose rectangle hit no glyph: the vertical run with the nearest middle, at most 3 sizes
    off, that they overlap by 60 %, and the stretch of it that they link."""
    missed = links.join(hits.select(*PAGE, "k").distinct(), [*PAGE, "k"], "left_anti")
    middle = (F.col("x0") + F.col("x1")) / 2
    # they meet by strips of x: that of the link's middle, and those within three sizes of the run's
    r = _named(runs.where("vertical").withColumn("cx", middle), "r_", "run", "size", "cx", *BOX).withColumn("strip", _strips(F.col("r_cx") - 3 * F.col("r_size"), F.col("r_cx") + 3 * F.col("r_size")))
    near = missed.withColumn("strip", F.floor(middle / STRIP)).join(r, [*PAGE, "strip"]).withColumn("dx", F.abs(F.col("r_cx") - middle)).where((overlap(F.col("y0"), F.col("y1"), F.col("r_y0"), F.col("r_y1")) >= 0.6 * (F.col("y1") - F.col("y0"))) & (F.col("dx") <= 3 * F.col("r_size")))
    return near.groupBy(*PAGE, "k", "href").agg(F.min_by("r_run", F.struct("dx", "r_run")).alias("run"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def linked_glyphs(glyphs: DataFrame, runs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, page, g, k, href) of all links' glyphs (with their run): those under a rectangle, and for rectangles that hit none the
    glyphs of the nearest column in their stretch, of which the first link, by k, has those that have no link yet."""
    hits = link_hits(glyphs, links)
    stretch = link_columns(runs, links, hits).withColumnsRenamed({"y0": "l_y0", "y1": "l_y1"})
    cy = (F.col("y0") + F.col("y1")) / 2
    more = glyphs.join(stretch, [*PAGE, "run"]).where(cy.between(F.col("l_y0") - 1, F.col("l_y1") + 1)).groupBy(*PAGE, "g").agg(F.min("k").alias("k"), F.min_by("href", "k").alias("href"))
    return hits.unionByName(more.join(hits, [*PAGE, "g"], "left_anti"))


def strip_boxes(glyphs: DataFrame, boxes: DataFrame, margin: float = 1.0) -> DataFrame:
    """Glyphs whose centres lie in none of the boxes (tables, or drawings with margin 0)."""
    centred = glyphs.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    gone = points_in_boxes(centred.select(*PAGE, "g", "cx", "cy"), boxes, margin).select(*PAGE, "g").distinct()
    return glyphs.join(gone, [*PAGE, "g"], "left_anti")


def image_references(placements: DataFrame, images: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, page, p, xref): the first image each placement lies on, all four edges within the tolerance."""
    i = _named(images, "i_", "k", "xref", *BOX).withColumns({f"strip{n}": F.explode(F.sequence(F.floor((F.col(f"i_{c}") - tolerance) / STRIP), F.floor((F.col(f"i_{c}") + tolerance) / STRIP))) for n, c in enumerate(("x0", "y0"))})
    p = placements.withColumns({f"strip{n}": F.floor(F.col(c) / STRIP) for n, c in enumerate(("x0", "y0"))})
    near = F.lit(True)
    for c in BOX:
        near &= F.abs(F.col(c) - F.col(f"i_{c}")) <= tolerance
    return p.join(i, [*PAGE, "strip0", "strip1"]).where(near).groupBy(*PAGE, "p").agg(F.min_by("i_xref", "i_k").alias("xref"))


def bookmark_units(toc: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, idx, ord): a bookmark's unit: the box its point lies in (2 points wider), else the first unit that ends past the
    point (in a vertical book: begins left of it), else the page's first; null where the page has no unit (the bookmark waits for the next)."""
    marks = toc.withColumns({"cx": F.col("x"), "cy": F.col("y")})
    hit = points_in_boxes(marks.select(*PAGE, "idx", "cx", "cy"), units, 2.0, "ord").groupBy("doc_id", "idx").agg(F.min("b_ord").alias("hit"))
    # the first unit past the point: marks and units in one order, and the least unit so far
    upright = ~F.col("vertical")
    limit = F.when(upright, F.col("y") - F.col("tolerance")).otherwise(-(F.col("x") + F.col("tolerance")))
    asked = toc.select(*PAGE, upright.alias("up"), limit.alias("at"), F.lit(1).alias("side"), "idx", F.lit(None).cast("int").alias("ord"))
    ends = units.select(*PAGE, F.explode(F.array(F.struct(F.lit(True).alias("up"), F.col("y1").alias("at")), F.struct(F.lit(False).alias("up"), (-F.col("x0")).alias("at")))).alias("e"), F.col("ord").cast("int").alias("ord"))
    ends = ends.select(*PAGE, "e.up", "e.at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("idx"), "ord")
    w = Window.partitionBy(*PAGE, "up")
    past = asked.unionByName(ends).select("*", F.min("ord").over(w.orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)).alias("past"), F.min("ord").over(w).alias("first")).where("side = 1")
    return past.join(hit, ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("hit", "past", "first").alias("ord"))


def clusters(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, page, block, run, cluster): runs of a block that stand close, transitively; a cluster is named by its first run.

    Two runs are close if they have one direction, overlap across it by 0.3 of the smaller extent, and lie within 2.5 of the
    larger size or overlap along it.

    The blocks of a task are swept together, a batch of whole blocks at a time, in order of where their runs begin: each run meets those
    of its block that begin before it ends, widened by 2.5 of the block's largest size, a bounded number of pairs at a time; what is
    close is united at once, so nothing but the runs is kept.
    """
    by = [*PAGE, "block"]

    def group(t: pa.Table) -> pa.Table:
        run, v, size = (t.column(c).to_numpy() for c in ("run", "vertical", "size"))
        box = np.stack([t.column(c).to_numpy() for c in BOX], 1)
        new = np.zeros(len(run), bool)  # rows come in order of block and run
        for k in by:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        block = np.cumsum(new)
        root = np.arange(len(run))
        for vertical in (False, True):
            own = np.flatnonzero(v == vertical)
            f, c = (0, 1) if vertical else (1, 0)  # the axis along the lines' succession, and across it
            own = own[np.lexsort((box[own, f], block[own]))]
            if len(own) > 1:
                largest = np.zeros(block[-1] + 1)
                np.maximum.at(largest, block[own], size[own])
                for i, j in swept(box[own, f], box[own, f + 2] + 2.5 * largest[block[own]], group=block[own]):
                    i, j = own[i], own[j]
                    lap = lambda a: np.minimum(box[i, a + 2], box[j, a + 2]) - np.maximum(box[i, a], box[j, a])  # noqa: E731, B023
                    cross, along = lap(c), lap(f)
                    least = np.minimum(box[i, c + 2] - box[i, c], box[j, c + 2] - box[j, c])
                    ok = (np.maximum(cross, 0) >= 0.3 * least) & ((along > 0) | (-along <= 2.5 * np.maximum(size[i], size[j])))
                    root = united(root, i[ok], j[ok])
        keys = [t.column(k) for k in (*by, "run")]
        return pa.table([*keys, pa.array(run[root], pa.int32())], names=[*by, "run", "cluster"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by):
            yield from group(t.combine_chunks()).to_batches()

    rows = runs.select(*by, "run", "vertical", "size", *BOX)
    rows = (rows.repartition(parts, *PAGE) if parts else rows.repartition(*PAGE)).sortWithinPartitions(*by, "run")
    return rows.mapInArrow(task, "doc_id long, page int, block int, run int, cluster int")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of batches in order of these columns, in tables that hold each group whole: what may go on in the next batch waits for it."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        last = np.ones(t.num_rows, bool)
        for k in by:
            x = t.column(k).to_numpy()
            last &= x == x[-1]
        begin = int(np.argmax(last))  # of the batch's last group
        goes_on = bool(held) and all(held[-1].column(k)[-1] == t.column(k)[0] for k in by)
        if begin or not goes_on:
            if held or begin:
                yield pa.concat_tables([*held, t.slice(0, begin)])
            held = []
        held.append(t.slice(begin))
    if held:
        yield pa.concat_tables(held)


def swept(begin: np.ndarray, end: np.ndarray, pairs: int = 1 << 20, group: np.ndarray | None = None):
    """Pairs (i < j) of intervals (of one group, if there are any), sorted by group and begin, where j begins before i ends: places i, j, about so many at a time."""
    last = np.arange(len(begin)) + 1
    at = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if group is not None else [0]
    if len(at) > 1:  # all groups by halving at once: the first place of the group, from the next on, that begins behind the end
        stops = np.append(at[1:], len(begin))
        low, high = last.copy(), np.repeat(stops, stops - at)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            behind = begin[np.minimum(mid, len(begin) - 1)] > end
            low, high = np.where(open_ & ~behind, mid + 1, low), np.where(open_ & behind, mid, high)
        last = low
    else:
        last = np.maximum(np.searchsorted(begin, end, side="right"), last)
    count = last - np.arange(len(begin)) - 1
    total = np.cumsum(count)
    first = 0
    while first < len(begin):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + pairs, side="right")))
        n = count[first:stop]
        i = np.repeat(np.arange(first, stop), n)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        first = stop


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each place's least place so far) after the links i, j, too."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further
    return root


def readings(runs: DataFrame, body_size: float) -> DataFrame:
    """The small runs that may be readings, cut at their blanks if that gives several parts: doc_id, page, run, part, text, size, vertical and box,
    of which a part has its share. A reading is letters, kana and reading marks throughout; an ideographic space is no blank."""
    found = F.regexp_extract_all("text", F.lit(f"(?:(?!{BLANK}).)+"), F.lit(0))
    gaps = F.split("text", f"(?:(?!{BLANK}).)+", -1)
    small = runs.where((F.col("size") > 0) & (F.col("size") <= 0.65 * body_size)).withColumns({"found": found, "gaps": gaps, "n": F.greatest(F.length("text"), F.lit(1))})
    several = small.where(F.size("found") > 1).select("*", F.posexplode("found").alias("part", "piece"))
    before = F.aggregate(F.slice("gaps", 1, F.col("part") + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("found", 1, F.col("part")), F.lit(0), lambda a, g: a + F.length(g))
    several = several.withColumn("at", before)
    whole = small.where(F.size("found") == 1).select("*", F.lit(0).alias("part"), strip(F.col("text")).alias("piece"), F.lit(0).alias("at"))
    flow = lambda lo, hi, at: F.col(lo) + at * (F.col(hi) - F.col(lo)) / F.col("n")
    a, z = F.col("at"), F.when(F.size("found") > 1, F.col("at") + F.length("piece")).otherwise(F.col("n"))
    box = [F.when(F.col("vertical"), F.col(c)).otherwise(flow("x0", "x1", at)).alias(c) for c, at in (("x0", a), ("x1", z))]
    box += [F.when(F.col("vertical"), flow("y0", "y1", at)).otherwise(F.col(c)).alias(c) for c, at in (("y0", a), ("y1", z))]
    word = strip(F.col("piece"))
    return several.unionByName(whole).where(word.rlike(f"^(?:{READING}|\\p{{L}})+$")).select(*PAGE, "run", "part", word.alias("text"), "size", "vertical", *box)


def ruby_bases(runs: DataFrame, small: DataFrame, body_size: float) -> DataFrame:
    """(doc_id, page, run, part, base): the nearest base run of each reading: of its direction, 1.4 times its size or more, to the left of a vertical
    reading or below a horizontal one, and overlapping half of it; the first of equals. Both sides meet by page and direction."""
    b = runs.where(F.col("size") >= 0.8 * body_size).select(*PAGE, "vertical", F.col("run").alias("base"), *[F.col(c).alias(f"b_{c}") for c in ("size", *BOX)])
    met = small.join(b, [*PAGE, "vertical"]).where((F.col("base") != F.col("run")) & (F.col("b_size") >= 1.4 * F.col("size")))
    across = F.col("x0").between(F.col("b_x1") - 1.5, F.col("b_x1") + 0.6 * F.col("b_size")) & (overlap(F.col("y0"), F.col("y1"), F.col("b_y0"), F.col("b_y1")) >= (F.col("y1") - F.col("y0")) / 2)
    above = F.col("y1").between(F.col("b_y0") - 0.8 * F.col("b_size"), F.col("b_y0") + 0.35 * F.col("b_size")) & (overlap(F.col("x0"), F.col("x1"), F.col("b_x0"), F.col("b_x1")) >= (F.col("x1") - F.col("x0")) / 2)
    near = met.where(F.when(F.col("vertical"), across).otherwise(above)).withColumn("far", F.when(F.col("vertical"), F.col("x0") - F.col("b_x1")).otherwise(F.col("b_y0") - F.col("y1")))
    return near.groupBy(*PAGE, "run", "part").agg(F.min_by("base", F.struct("far", "base")).alias("base"))


def attach_ruby(runs: DataFrame, body_size: float) -> DataFrame:
    """(doc_id, page, ruby_run, base_run, lo, hi): which glyphs of which base run each small reading run annotates.

    runs: doc_id, page, run, text, size, vertical, box. Glyphs share a run's extent evenly. Each reading's base and the glyphs
    beside it are joins; that a glyph which has a reading takes no other is a fold over each base's readings in order.
    """
    small = readings(runs, body_size)
    lo, hi = F.when(F.col("vertical"), F.col("y0")).otherwise(F.col("x0")), F.when(F.col("vertical"), F.col("y1")).otherwise(F.col("x1"))
    r = small.select(*PAGE, "run", "part", lo.alias("a"), hi.alias("z")).join(ruby_bases(runs, small, body_size), [*PAGE, "run", "part"])
    b = runs.select(*PAGE, F.col("run").alias("base"), F.col("text").alias("b_text"), F.col("size").alias("b_size"), lo.alias("b0"), hi.alias("b1"))
    n = F.greatest(F.length("b_text"), F.lit(1))
    step, slack = (F.col("b1") - F.col("b0")) / n, 0.3 * F.col("b_size")

    def beside(i: Column) -> Column:
        p, q = F.col("b0") + i * step, F.col("b0") + (i + 1) * step
        return (F.least(q, F.col("z")) - F.greatest(p, F.col("a")) > 0.25 * (q - p)) | ((p >= F.col("a") - slack) & (q <= F.col("z") + slack))

    spots = F.sequence(F.lit(0), n - 1)
    some = F.filter(spots, lambda i: beside(i) & ~F.substring("b_text", i + 1, F.lit(1)).rlike(f"^{BLANK}$"))
    middle = F.array_min(F.transform(spots, lambda i: F.struct(F.abs(F.col("b0") + (i + 0.5) * step - (F.col("a") + F.col("z")) / 2).alias("far"), i.alias("i"))))["i"]
    rows = r.join(b, [*PAGE, "base"]).select(*PAGE, "base", "run", "part", some.alias("some"), middle.alias("middle"))

    def turn(taken: set, r) -> tuple:
        free = [i for i in r.some if i not in taken] or [r.middle]
        taken.update(range(min(free), max(free) + 1))
        return r.doc_id, r.page, r.run, r.base, min(free), max(free)

    return sorted_fold(rows, [*PAGE, "base"], ["run", "part"], set, turn, "doc_id long, page int, ruby_run int, base_run int, lo int, hi int")


def merge_baselines(runs: DataFrame) -> DataFrame:
    """(doc_id, page, part, text, box): neighbouring runs on one baseline as one, with a blank between: they overlap by 60 % of the
    smaller height and stand at most four of the later one's sizes apart; the merged box grows as runs join it."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("run").to_dict("records"):
            if out:
                p = out[-1]
                lap, low = min(p[6], r["y1"]) - max(p[4], r["y0"]), min(p[6] - p[4], r["y1"] - r["y0"])
                if low > 0 and lap >= 0.6 * low and 0 <= r["x0"] - p[5] <= 4 * r["size"]:
                    p[2] += " " + r["text"]
                    p[4], p[5], p[6] = min(p[4], r["y0"]), max(p[5], r["x1"]), max(p[6], r["y1"])
                    continue
            out.append([r["doc_id"], r["page"], r["text"], r["x0"], r["y0"], r["x1"], r["y1"]])
        rows = [(d, g, i, t, a, b, c, e) for i, (d, g, t, a, b, c, e) in enumerate(out)]
        return pd.DataFrame(rows, columns=["doc_id", "page", "part", "text", *BOX])

    return runs.groupBy(*PAGE).applyInPandas(page, "doc_id long, page int, part int, text string, x0 double, y0 double, x1 double, y1 double")


def page_link_targets(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, link, href): a page link's anchor: that page's, else the next page's that has one, else '#'.

    A forward as-of join as one window over both tables in order of page, so a document's rows are sorted, not multiplied.
    """
    both = links.select("doc_id", "page", "link", F.lit(None).cast("string").alias("anchor"), F.lit(0).alias("side")).unionByName(anchors.select("doc_id", "page", F.lit(None).cast("long").alias("link"), "anchor", F.lit(1).alias("side")))
    ahead = Window.partitionBy("doc_id").orderBy(F.col("page"), F.col("side"), F.col("anchor")).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("to", F.first("anchor", True).over(ahead)).where("side = 0")
    return met.select("doc_id", "link", F.concat(F.lit("#"), F.coalesce("to", F.lit(""))).alias("href"))
