"""Operator 3, personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Spans of four fixed formats (e-mail, IP address, payment card, phone) and long hexadecimal keys are the seeds. Of every seed and
every identifier-like token the one to three words or signs on its left and on its right are its lexical patterns; patterns and
values are a bipartite graph. Both are scored in turns: a pattern by how many of all its occurrences in the corpus stand at
a value, each counted by the value's score; a value by the chance that one of its patterns is right. What a confident
pattern stands at is an identifier, too, whether or not it has a seed's format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage, quoted, spread, table

#: The four base formats in the order of the result. Each finds what the plain pattern in the comment finds from left to
#: right without overlap; look-behinds and possessive repeats keep long runs linear and leave out runs of wrong lengths.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "secret", "number"]
#: A character that every match of a format has; a text without it isn't searched.
NEEDED = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "token": "[0-9]"}
#: Identifier-like tokens: eight or more letters, digits and joining signs, with a digit among them, to the last letter or digit.
TOKEN = r"(?<![0-9A-Za-z_./+-])(?=[A-Za-z_./+-]*+[0-9])[0-9A-Za-z_./+-]{7,}[0-9A-Za-z]"
HEX_KEY = r"^[0-9a-f]{32,}$"
#: What contexts are made of: words, numbers and single signs.
SIGN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
REACH = 3  # words or signs of a context, at most
GRAMS_BROADCAST = 100_000  # contexts (some 50 bytes each) that are broadcast at most; beyond, a shuffle join of counts
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_FOUND = "array<struct<s:bigint,e:bigint,value:string,patterns:array<string>>>"
_STEP = 256  # terms that are summed by one fold


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _sums(numbers: Column) -> Column:
    """Sums of all numbers up to each: folds over short stretches, so a long array takes time in proportion."""

    def fold(part: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))

    def joined(parts: Column) -> Column:
        before = fold(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, total: F.transform(p["out"], lambda x: x + total - p["at"])))

    return _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _STEP).cast("int")), lambda i: fold(F.slice(numbers, i * _STEP + 1, _STEP))), joined)


def _signs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(SIGN), F.lit(0)), lambda x: F.when(x.rlike(r"^\p{N}"), "0").otherwise(x))


def _patterns(left: Column, right: Column) -> Column:
    """L and R patterns of the signs on both sides; one without a letter says nothing."""
    n = F.sequence(F.lit(1), F.lit(REACH))
    last = F.transform(n, lambda k: F.when(F.size(left) >= k, F.concat(F.lit("L "), F.array_join(F.slice(left, -k, k), " "))))
    next_ = F.transform(n, lambda k: F.when(F.size(right) >= k, F.concat(F.lit("R "), F.array_join(F.slice(right, F.lit(1), k), " "))))
    return F.filter(F.concat(last, next_), lambda p: p.isNotNull() & F.substring(p, 2, 1 << 30).rlike(r"\p{L}"))


def located(text: str, pattern: str, needed: str) -> Column:
    """Matches with their code-point positions and their patterns: the gaps between matches give places and contexts."""
    none = F.array().cast(_FOUND)

    def spans(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        n = F.size(found)
        ends = _let(F.zip_with(F.slice(gaps, 1, n), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")), _sums)
        sides = _let(F.transform(gaps, _signs), lambda a: F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), _patterns))
        one = lambda m, y: F.struct((y["e"] - F.length(m)).alias("s"), y["e"].alias("e"), m.alias("value"), y["p"].alias("patterns"))
        return F.when(n > 0, F.zip_with(found, F.zip_with(ends, sides, lambda e, p: F.struct(e.alias("e"), p.alias("p"))), one)).otherwise(none)

    both = F.struct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("found"), F.split(F.col(text), pattern, -1).alias("gaps"))
    return F.when(F.col(text).rlike(needed), _let(both, spans)).otherwise(none)


def _sound(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)
    if kind == "card":
        d = F.regexp_replace(v, "[ -]", "")
        twice = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
        return F.aggregate(twice, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0
    return F.lit(True)


def _whole(kind: str) -> Column:
    return F.filter(kind, lambda x: _sound(kind, x["value"]))


def _spans(i: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def extract(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans of the fixed formats), seeds (their values and patterns), tokens (identifier-like)."""
    docs = spread(df.select(F.col(quoted([key])[0]).alias("doc_id"), F.coalesce(F.col(quoted([text])[0]), F.lit("")).alias("text")))
    docs = docs.select("doc_id", *[located("text", p, NEEDED[k]).alias(k) for k, p in {**BASE, "token": TOKEN}.items()])
    docs = docs.select("doc_id", *[_whole(k).alias(k) for k in BASE], "token")
    spans = [_spans(i, k) for i, k in enumerate(BASE)]
    seeds = F.transform(F.concat(*BASE), lambda x: F.struct(F.lower(x["value"]).alias("value"), x["patterns"].alias("patterns")))
    docs = docs.select("doc_id", F.concat(*spans).alias("base"), seeds.alias("seeds"), "token")

    def seen(x: Column) -> Column:
        v = F.regexp_replace(x["value"], r"^[_./+-]+", "")
        kind = F.when(v.rlike("^[0-9_./+-]+$"), KINDS.index("number")).otherwise(KINDS.index("secret"))
        return F.struct(kind.alias("k"), (x["e"] - F.length(v)).alias("s"), x["e"].alias("e"), F.lower(v).alias("value"), x["patterns"].alias("patterns"), v.rlike(HEX_KEY).alias("seed"))

    return docs.select("doc_id", "base", "seeds", F.transform("token", seen).alias("tokens"))


def outside(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens (row, s, e, ...) that overlap no base span (row, s, e) of their row: one sorted pass, whatever a text has of both."""
    w = Window.partitionBy("row").orderBy("s", "turn")
    both = tokens.withColumn("turn", F.lit(1)).unionByName(base.select("row", "s", "e", F.lit(0).alias("turn")), allowMissingColumns=True)
    ends = F.max(F.when(F.col("turn") == 0, F.col("e"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("turn") == 0, F.col("s"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    marked = both.withColumns({"ends": ends, "begins": begins}).where("turn = 1")
    return marked.where("(ends IS NULL OR ends <= s) AND (begins IS NULL OR begins >= e)").drop("turn", "ends", "begins")


def occurrences(df: DataFrame, grams: DataFrame, text: str = "text") -> DataFrame:
    """(gram, total): how often each of the grams (column gram) of up to three words or signs stands in the whole texts."""
    a = F.col("signs")
    at = lambda i: F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0)))
    two = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), at(1), lambda x, y: F.concat(x, F.lit(" "), y))
    b = F.col("two")
    three = F.zip_with(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), at(2), lambda x, y: F.concat(x, F.lit(" "), y))
    signs = spread(df.select(F.col(quoted([text])[0]).alias("text")).where("text IS NOT NULL")).select(_signs(F.col("text")).alias("signs"))
    every = signs.withColumn("two", two).select(F.explode(F.concat("signs", "two", three)).alias("gram"))
    grams = cut_lineage(grams)
    if grams.limit(GRAMS_BROADCAST + 1).count() <= GRAMS_BROADCAST:
        return every.join(F.broadcast(grams), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("total"))
    return every.groupBy("gram").agg(F.count(F.lit(1)).alias("total")).join(grams, "gram", "left_semi")


def confident_patterns(edges: DataFrame, totals: DataFrame, rounds: int = 3, confidence: float = 0.7) -> DataFrame:
    """(pattern, weight) from edges (pattern, value, n, seed) and the patterns' occurrences (pattern, total)."""
    own = edges.groupBy("pattern").agg(F.sum("n").alias("n_own"))
    edges = cut_lineage(edges.join(own, "pattern").join(totals, "pattern", "left").select("pattern", "value", "seed", (F.col("n") / F.greatest("n_own", F.coalesce("total", F.lit(0)))).alias("part")))
    values = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    weigh = lambda values: edges.join(values, "value").groupBy("pattern").agg(F.sum(F.col("part") * F.col("score")).alias("weight"))
    for _ in range(rounds):
        # a value's chance that not all its patterns are wrong; seeds stay certain
        turn = edges.join(weigh(values), "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.lit(1.0000001) - F.least("weight", F.lit(1.0)))).alias("wrong"))
        values = cut_lineage(turn.select("value", F.greatest(F.col("seed").cast("double"), F.least(F.lit(1.0), 1 - F.exp("wrong"))).alias("score")))
    return weigh(values).where(F.col("weight") >= confidence)


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", least_seeds: int = 3, **how) -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end) in code points, by kind as in KINDS, then start.

    A pattern counts from `least_seeds` distinct seeds on. A null text is empty; a null key and repeated rows each stay a row of
    their own; no token in a table, or no confident pattern, leaves the base spans; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = cut_lineage(extract(df, key, text).withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.k", "t.s", "t.e", "t.value", "t.seed", "t.patterns")
    tokens = cut_lineage(outside(tokens, rows.select("row", F.explode("base").alias("b")).select("row", "b.s", "b.e")))
    seeds = rows.select(F.explode("seeds").alias("t")).selectExpr("t.value", "true AS seed", "t.patterns")
    sides = tokens.select("value", "seed", "patterns").union(seeds).select("value", "seed", F.explode("patterns").alias("pattern"))
    edges = cut_lineage(sides.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("int")).alias("seed")))
    rich = edges.groupBy("pattern").agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= least_seeds).select("pattern")
    edges = cut_lineage(edges.join(rich, "pattern"))
    gram = F.substring(F.col("pattern"), 3, 1 << 30)
    totals = occurrences(df, edges.select(gram.alias("gram")).distinct(), text)
    totals = cut_lineage(edges.select("pattern").distinct().join(totals, F.col("gram") == gram).select("pattern", "total"))
    good = confident_patterns(edges, totals, **how).select("pattern")
    more = tokens.select("row", "k", "s", "e", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
    added = more.groupBy("row").agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))
    named = F.transform(F.col("all"), lambda x: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    out = rows.join(added, "row", "left").withColumn("all", F.sort_array(F.concat("base", F.coalesce("added", F.expr("cast(array() AS array<struct<k:int,s:bigint,e:bigint>>)")))))
    return out.select("doc_id", F.slice(named, 1, F.size("base")).alias("base"), named.alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
