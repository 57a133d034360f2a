"""Scalar text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions.scripts import CJK, SPACE

# Punctuation sets.
TERMINAL = ".!?:;\"')]」』】〉》）］…。！？」』"
CJK_OPENERS = "「『（【〈《"
CJK_TERMINAL = "。！？」』…"
HYPHENS = "-‐­"
# Fixed value: a line that is a page number.
PAGE_NUMBER = r"(?iU)^[\s\-–—・·|]*(?:page|p\.|頁|ページ|第)?[\s\-–—・]*[0-9〇一二三四五六七八九十百千]+[\s\-–—・|]*(?:頁|ページ|ページ目|/\s*[0-9]+)?[\s\-–—・|]*$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x and unicodedata.normalize("NFKC", x))


def nfkc(s: Column) -> Column:
    """Compatibility normalisation, which Spark lacks. Only texts with a character that it could change, from U+00A0 on, travel to Python."""
    return F.coalesce(_nfkc(F.when(s.rlike(r"[\x{A0}-\x{10FFFF}]"), s)), s)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def signature_of(normal: Column) -> Column:
    """A head or foot line with numbers and roman numerals as #, so that page numbers fall together; takes normalised text."""
    t = F.lower(strip(normal))
    t = F.regexp_replace(t, "[0-9〇一二三四五六七八九十百千]+", "#")
    t = F.regexp_replace(t, r"(?U)\b[ivxlcdm]+\b", "#")
    return F.regexp_replace(t, f"{SPACE}+", " ")


def band_signature(s: Column) -> Column:
    return signature_of(nfkc(s))


def is_page_number(s: Column) -> Column:
    return s.rlike(PAGE_NUMBER)


def joiner(before: Column, after: Column) -> Column:
    """What stands between two joined lines: nothing next to CJK or an empty side, else a blank."""
    a, b = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    return F.when((before == "") | (after == "") | a.rlike(CJK) | b.rlike(CJK), "").otherwise(" ")


def is_terminal(s: Column) -> Column:
    t = F.regexp_replace(s, f"{SPACE}+$", "")
    return (t != "") & (F.instr(F.lit(TERMINAL), F.right(t, F.lit(1))) > 0)


def font_style(flags: Column, font: Column) -> list[Column]:
    f = F.lower(font)
    return [
        (flags.bitwiseAND(16).cast("boolean") | f.rlike("bold|black|heavy|semibold|demibold")).alias("bold"),
        (flags.bitwiseAND(2).cast("boolean") | f.rlike("italic|oblique")).alias("italic"),
        flags.bitwiseAND(8).cast("boolean").alias("mono"),
        flags.bitwiseAND(1).cast("boolean").alias("sup"),
    ]


def is_vertical(wmode: Column, dx: Column, dy: Column) -> Column:
    return (wmode == 1) | (F.abs(dy) > F.abs(dx))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def position_key(y: Column) -> Column:
    """y in thirds of a point, halves to even."""
    return F.bround(y / 3.0, 0).cast("int")


def half_points(size: Column) -> Column:
    return F.bround(size * 2, 0) / 2


def heading_level(ladder: Column, size: Column) -> Column:
    """1 for the largest heading size; the first that is no larger than size + 0.01, 4 at most."""
    at = F.array_position(F.transform(ladder, lambda s: s <= size + 0.01), True)
    return F.when(at > 0, F.least(at, F.lit(4))).otherwise(F.lit(4)).cast("int")


def safe_filename(name: Column) -> Column:
    t = strip(F.translate(name, "/\\", "__"))
    t = F.regexp_replace(t, r"(?U)[^\w.\- ]", "")
    t = F.regexp_replace(t, r"^[ .]+|[ .]+$", "")
    return F.left(F.when(t == "", "untitled").otherwise(t), F.lit(180))


def human_size(n: Column) -> Column:
    k = F.lit(1024.0)
    d = n.cast("double")
    one = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit(f" {unit}"))
    return (
        F.when(d < k, F.concat(n.cast("long").cast("string"), F.lit(" B")))
        .when(d < k * k, one(d / k, "KB"))
        .when(d < k * k * k, one(d / (k * k), "MB"))
        .otherwise(one(d / (k * k * k), "GB"))
    )


def is_safe_member(name: Column) -> Column:
    """Whether a library file's name is a bare name: no folder, no step up."""
    return (name != "") & ~name.contains("/") & ~name.isin(".", "..")


def escape(s: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("'", "&#x27;")) if attribute else ()):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def csv_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def is_allowed(email: Column, allowed: Column) -> Column:
    """An empty list allows nobody."""
    return F.coalesce(F.array_contains(csv_list(allowed), F.lower(F.trim(email))), F.lit(False))


def clean_title(title: Column, fallback: Column) -> Column:
    """A title that its producer left blank or took from a file's name falls back."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.when((t == "") | t.rlike(r"(?i)^(untitled|microsoft word - .*|.*\.(docx?|html?|pdf|indd|tex|odt))\z"), fallback).otherwise(t)


def direction_for(name: Column) -> Column:
    return F.when(F.lower(name).endswith(".pdf"), "pdf-to-epub").otherwise("epub-to-pdf")


def media_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".pdf"), "application/pdf").when(n.endswith(".epub"), "application/epub+zip").otherwise("application/octet-stream")


def chunk_timeout(items: Column, base: int = 60, per_item: int = 10) -> Column:
    return F.lit(base) + items * per_item


def render_command(source: Column, target: Column, timeout: Column, browser: Column, size: Column, fixed: Column, direction: Column) -> Column:
    """The renderer's argument list."""
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.lit("vivliostyle"), F.lit("build"), source, F.lit("-o"), target, F.lit("--timeout"), timeout.cast("string")),
        F.when(F.coalesce(browser, F.lit("")) != "", F.array(F.lit("--executable-browser"), browser)).otherwise(none),
        F.when(~fixed & (F.coalesce(size, F.lit("")) != ""), F.array(F.lit("-s"), size)).otherwise(none),
        F.when(direction.isin("rtl", "ltr"), F.array(F.lit("--reading-progression"), direction)).otherwise(none),
    )


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once; named several times, it would be worked out anew each time."""
    return F.get(F.transform(F.array(value), f), 0)


def _solid_lines(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def fold_joined(parts: Column) -> Column:
    """An ordered array of lines as one text: blank lines go, and each boundary has its joiner. A boundary depends on its two lines
    alone, so the text is put together once."""

    def joined(lines: Column) -> Column:
        after = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        ends = F.zip_with(F.slice(lines, 1, F.size(after)), after, lambda a, b: F.concat(a, joiner(a, b)))
        return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(ends, ""), F.element_at(lines, -1)))

    return _with(_solid_lines(parts), joined)


def dehyphenate(parts: Column, vertical: Column | None = None) -> Column:
    """An ordered array of lines as one text, where a word broken at a line's end is healed: a hyphen between letters goes
    before a lower-case letter and stays, without a blank, before another. A boundary depends on its two lines, and on the last
    character before them where the first is a hyphen alone, so the text is put together once."""

    def joined(lines: Column) -> Column:
        def end(i: Column) -> Column:
            line, before = F.get(lines, i), F.coalesce(F.get(lines, i - 1), F.lit(""))
            return F.when((F.length(line) == 1) & (joiner(before, line) == ""), F.concat(F.right(before, F.lit(1)), line)).otherwise(F.right(line, F.lit(2)))

        def piece(i: Column) -> Column:
            line, after = F.get(lines, i), F.get(lines, i + 1)
            broken = end(i).rlike(rf"\p{{L}}[{HYPHENS}]$") & after.rlike(r"^\p{L}")
            if vertical is not None:
                broken &= ~vertical
            whole = F.when(broken & after.rlike(r"^\p{Ll}"), F.left(line, F.length(line) - 1)).when(broken, line)
            return whole.otherwise(F.concat(line, joiner(line, after)))

        pieces = F.transform(F.sequence(F.lit(0), F.size(lines) - 2), piece)
        return F.when(F.size(lines) == 0, "").when(F.size(lines) == 1, F.get(lines, 0)).otherwise(F.concat(F.array_join(pieces, ""), F.element_at(lines, -1)))

    return _with(_solid_lines(parts), joined)


def wrapped(text: Column, width: int) -> Column:
    """A text's lines cut to pieces of `width` characters, with a hyphen where a cut falls between two letters."""

    def pieces(line: Column) -> Column:
        def piece(i: Column) -> Column:
            at = F.substring(line, i * width + 1, F.lit(width + 1))
            cut = F.substring(at, F.lit(width), F.lit(2)).rlike(r"^\p{L}\p{L}$")
            return F.concat(F.left(at, F.lit(width)), F.when(cut, "-").otherwise(""))

        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(line), F.lit(1)) - 1) / width).cast("int")), piece)

    return F.flatten(F.transform(F.split(text, "\n", -1), pieces))
