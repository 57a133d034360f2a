"""Character classes, script counters and language decisions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges of the scripts.
SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BLANK = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]"  # without U+3000, which is content
CJK = r"[\x{2E80}-\x{2FDF}\x{3000}-\x{30FF}\x{3100}-\x{312F}\x{3130}-\x{318F}\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{2FA1F}]"
KANA = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]"
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"
HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2FA1F}\x{F900}-\x{FAFF}]"
BOPOMOFO = r"[\x{3100}-\x{312F}\x{31A0}-\x{31BF}]"
PUA = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}]"
CLASSED = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{10FFFD}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2FA1F}\x{F900}-\x{FAFF}]"
# Characters of one Chinese script only.
SIMPLIFIED = "[们这个说国时会对发经来学为么后与东车长门问间见开关电书业还产从动无]"
TRADITIONAL = "[們這個說國時會對發經來學為麼後與東車長門問間見開關電書業還產從動無]"

COUNTERS = ("han", "kana", "hangul", "latin", "simplified", "traditional", "pua", "total")


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a class a text has: what it loses when they are deleted, so no match becomes a string of its own."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))).cast("long")


def script_counts(text: Column) -> list[Column]:
    """The eight counters of a text. A letter of no other class counts as latin, so those classes are deleted first. All of these
    begin at U+1100; a text without such characters takes one look and two passes."""
    solid = F.regexp_replace(text, f"{SPACE}+", "")
    beyond = text.rlike(r"[\x{1100}-\x{10FFFF}]")
    some = lambda pattern: F.when(beyond, count_of(text, pattern)).otherwise(F.when(text.isNotNull(), F.lit(0).cast("long")))
    letters = F.when(beyond, F.regexp_replace(solid, f"{CLASSED}+", "")).otherwise(solid)
    return [
        some(HAN).alias("han"),
        some(KANA).alias("kana"),
        some(HANGUL).alias("hangul"),
        count_of(letters, r"\p{L}").alias("latin"),
        some(SIMPLIFIED).alias("simplified"),
        some(TRADITIONAL).alias("traditional"),
        some(PUA).alias("pua"),
        F.length(solid).cast("long").alias("total"),
    ]


def guess_language() -> Column:
    """The language tag that the counters of a row suggest."""
    cjk = F.col("han") + F.col("kana") + F.col("hangul")
    return (
        F.when((cjk == 0) | (F.col("latin") > 3 * cjk), "en")
        .when(F.col("kana") > F.greatest(cjk * 0.03, F.lit(5.0)), "ja")
        .when(F.col("hangul") > cjk * 0.3, "ko")
        .when(F.col("simplified") > F.col("traditional"), "zh-CN")
        .when(F.col("traditional") > F.col("simplified"), "zh-TW")
        .otherwise("zh")
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def cjk_fraction() -> Column:
    return ratio(F.col("han") + F.col("kana") + F.col("hangul"), F.col("total"))


def pua_fraction() -> Column:
    return ratio(F.col("pua"), F.col("total") - F.col("latin"))


def resolve_language(declared: Column, guessed: Column) -> Column:
    """A declared tag, unless it is missing, malformed, a bare zh that the script refines, or plainly wrong English."""
    tag = F.replace(declared, F.lit("_"), F.lit("-"))
    low = F.lower(tag)
    return (
        F.when(F.coalesce(declared, F.lit("")) == "", guessed)
        .when(~tag.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*\z"), guessed)
        .when((low == "zh") & guessed.startswith("zh-"), guessed)
        .when(low.startswith("en") & (guessed != "en"), guessed)
        .otherwise(tag)
    )


def recognition_models(tag: Column) -> Column:
    """Models for a language tag: the first rule that fits, null for none. Regions match anywhere, languages at the start."""
    t = F.lower(F.trim(tag))
    has = lambda *parts: F.array_contains(F.array(*[t.contains(p) for p in parts]), True)
    models = lambda *m: F.array(*[F.lit(x) for x in m])
    return (
        F.when(has("zh-tw", "zh-hk", "zh-mo", "zh-hant"), models("chi_tra"))
        .when(has("zh-cn", "zh-sg", "zh-hans"), models("chi_sim"))
        .when(t.startswith("zh"), models("chi_tra", "chi_sim"))
        .when(t.startswith("ja"), models("jpn"))
        .when(t.startswith("ko"), models("kor"))
        .when(t.startswith("en"), models("eng"))
    )


def recognition_languages(tag: Column, configured: Column) -> Column:
    """The models joined with +; the configured ones for a missing or unknown tag."""
    return F.when(F.coalesce(tag, F.lit("")) == "", configured).otherwise(F.coalesce(F.array_join(recognition_models(tag), "+"), configured))


def usable_languages(requested: Column, installed: Column) -> tuple[Column, Column]:
    """(usable, dropped): the requested models in order, by whether they are installed; all usable where nothing is known."""
    asked = F.filter(F.split(requested, r"\+"), lambda c: c != "")
    known = F.size(F.coalesce(installed, F.array().cast("array<string>"))) > 0
    usable = F.when(known, F.array_join(F.filter(asked, lambda c: F.array_contains(installed, c)), "+")).otherwise(requested)
    dropped = F.when(known, F.array_join(F.filter(asked, lambda c: ~F.array_contains(installed, c)), "+")).otherwise(F.lit(""))
    return usable, dropped


def ocr_action(mode: Column, fraction: Column, threshold: Column) -> Column:
    """What to do with one unit's text layer: off, clean, or rebuild because of private-use characters or always."""
    return F.when(mode == "off", "off").when((mode == "auto") & (fraction < threshold), "clean").when(mode == "auto", "pua").otherwise("always")


def prepare_action(mode: Column, pages: Column, coverage: Column, fraction: Column, threshold: Column) -> Column:
    """What to do before a conversion: a scan is recognised first, obfuscated text else."""
    return F.when((mode == "off") | (pages == 0), "off").when(coverage < 0.2, "scan").when(fraction >= threshold, "rebuild").otherwise("keep")


# The catalog's notes of recognition.
SCAN_KEPT, SCAN_READ, SCAN_POOR = "scanned PDF; OCR unavailable, pages kept as images", "text recovered via OCR (scanned PDF)", "OCR ran but recovered little text; pages kept as images"
LAYER_REBUILT, LAYER_GARBLED = "text layer rebuilt via OCR (PUA-obfuscated PDF)", "text layer is PUA-obfuscated and OCR failed; text may be garbled"


def prepare_note(action: Column, done: Column, coverage_after: Column) -> Column:
    """What the catalog says of it; null where nothing was to do."""
    return (
        F.when((action == "scan") & ~done, SCAN_KEPT)
        .when((action == "scan") & (coverage_after >= 0.2), SCAN_READ)
        .when(action == "scan", SCAN_POOR)
        .when((action == "rebuild") & done, LAYER_REBUILT)
        .when(action == "rebuild", LAYER_GARBLED)
    )
