"""Operator 7, mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic) before any shuffle of rows; the small table of cells is raked to
the three target marginals in turns, with no cell's weight beyond its tokens, and a document stays with its cell's calibrated
probability. Chance is a hash of the document's id, so a rerun or a lost executor draws alike.

What is drawn is sized so that the targets can be met: a value can't give more than all its tokens, so the draw is at most the
least of share over target, and a tenth less leaves room for the cells. In each round three scalings meet a marginal each and
the bound is applied, so a cell that is drawn whole is fixed and the others make up for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage, fresh, quoted, table

ROUNDS, TEMPER, LIFT, FILL = 8, 0.7, 1.5, 0.9
CELLS_BROADCAST, SALTS = 20_000, 64  # cells (some 50 bytes each) that are broadcast at most; beyond, a shuffle join of salted cells
_KEYS = ("mix_key_0__", "mix_key_1__", "mix_key_2__")


def n_words(text: str = "text") -> Column:
    return F.size(F.filter(F.split(F.coalesce(F.col(quoted([text])[0]), F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def topic(text: str = "text") -> Column:
    """A stand-in for a topic, as the tables name none: what kind of text it is, by three marks. Give `dims` of your own where a table has topics."""
    t = F.coalesce(F.col(quoted([text])[0]), F.lit(""))
    return F.when(t.contains(" | "), "listing").when(F.lower(t).contains("licen"), "legal").when(F.length(t) >= 4000, "long").otherwise("prose")


def marginal(cells: DataFrame, key: str, total: int, temper: float = TEMPER, lift: float = LIFT, given: DataFrame | None = None) -> DataFrame:
    """(the key, own, goal): each value's share of the tokens and its target share.

    A given target is a table (the key, share), of which only values in the cells count; a value that it doesn't name gets
    nothing. Without one, the target is the own share to the power `temper`, which lifts what is small, but at most `lift` times.
    """
    own = cells.groupBy(key).agg((F.sum("tokens") / F.lit(float(total))).alias("own"))
    if given is not None:
        own = cut_lineage(own.join(given.select(key, F.col("share").cast("double").alias("goal")), key, "left").fillna(0.0, ["goal"]))
    else:
        own = cut_lineage(own.select(key, "own", F.pow("own", F.lit(temper)).alias("goal")))
        own = cut_lineage(own.withColumn("goal", F.least(F.col("goal") / F.lit(own.agg(F.sum("goal")).first()[0]), F.col("own") * lift)))
    every = own.agg(F.sum("goal")).first()[0] or 0.0
    return own.withColumn("goal", F.col("goal") / F.lit(every) if every else F.lit(0.0))


def raked(cells: DataFrame, rounds: int = ROUNDS, fill: float = FILL, targets: Sequence[DataFrame | None] = (None, None, None), **how) -> DataFrame:
    """Cells (the three keys, tokens) with `p`, the share of each cell's tokens to draw, 1 at most; cells without tokens have 1."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("p", F.lit(1.0))
    w, room = cells.withColumn("most", F.col("tokens") / F.lit(float(total))), 1.0
    for key, given in zip(_KEYS, targets, strict=True):
        shares = marginal(cells, key, total, given=given, **how)
        room = min(room, shares.where("goal > 0").agg(F.min(F.col("own") / F.col("goal"))).first()[0] or 0.0)
        w = w.join(shares.select(key, F.col("goal").alias(f"{key}to")), key)
    w = cut_lineage(w.withColumn("w", F.col("most")))
    for _ in range(rounds):
        for key in _KEYS:
            own = F.sum("w").over(Window.partitionBy(key))
            w = w.withColumn("own", own).withColumn("w", F.when(F.col("own") > 0, F.col("w") * F.col(f"{key}to") * F.lit(room * fill) / F.col("own")).otherwise(0.0)).drop("own")
        w = w.withColumn("w", F.least("w", "most"))
    return w.select(*_KEYS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("most")).otherwise(1.0).alias("p"))


def mixed(df: DataFrame, dims: Sequence[Column] | None = None, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with n_tokens__, probability__ and kept__ (whether the draw keeps the row) behind its columns.

    The expected shares of what is kept are the targets, of each marginal, unless given targets contradict one another. Null
    dimensions are a value of their own; a text without words is in a cell by its columns and draws by the cell's probability,
    which is 1 if the cell has no tokens at all; a null key draws as the empty string; rows of one key draw alike; an empty
    table gives an empty result. A new name that df has already gets underscores.
    """
    dims = dims or (F.col("source"), F.col("lang"), topic(text))
    own = [f"c{i}" for i in range(len(df.columns))]
    keyed = df.select("*", n_words(text), *[F.coalesce(d.cast("string"), F.lit("\0")) for d in dims]).toDF(*own, "n", *_KEYS)
    cells = cut_lineage(keyed.groupBy(*_KEYS).agg(F.sum("n").alias("tokens")))
    shares = cut_lineage(raked(cells, **how)).drop("tokens")
    name = F.coalesce(F.col(own[df.columns.index(key)]).cast("string"), F.lit("")).cast("binary")
    if shares.limit(CELLS_BROADCAST + 1).count() <= CELLS_BROADCAST:
        out = keyed.join(F.broadcast(shares), list(_KEYS))
    else:  # a cell may hold a third of all rows
        shares = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = keyed.withColumn("salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(shares, [*_KEYS, "salt"])
    draw = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = out.withColumn("p", F.round("p", 9)).select(*own, "n", "p", (draw < F.col("p")).alias("kept"))
    return out.toDF(*df.columns, *[fresh(df, c) for c in ("n_tokens__", "probability__", "kept__")])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("n_tokens__").alias("n_tokens"), F.round("probability__", 6).alias("probability"), F.col("kept__").cast("int").alias("kept"))


def _sql() -> str:
    """The same in DuckDB, with the turns unrolled."""
    ctes = [
        r"""d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, coalesce(source, chr(0)) AS k0, coalesce(lang, chr(0)) AS k1,
 CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' WHEN contains(lower(coalesce(text, '')), 'licen') THEN 'legal' WHEN length(coalesce(text, '')) >= 4000 THEN 'long' ELSE 'prose' END AS k2 FROM documents)""",
        "cells AS (SELECT k0, k1, k2, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE / sum(sum(n)) OVER () AS most FROM d GROUP BY ALL)",
    ]
    for k in "012":
        ctes.append(f"""m{k} AS (SELECT k{k}, own, g / sum(g) OVER () AS t{k} FROM (SELECT k{k}, own, least(s / sum(s) OVER (), own * {LIFT}) AS g
 FROM (SELECT k{k}, sum(most) AS own, pow(sum(most), {TEMPER}) AS s FROM cells GROUP BY k{k})))""")
    ctes.append(f"room AS (SELECT {FILL} * min(own / t) AS room FROM ({' UNION ALL '.join(f'SELECT own, t{k} AS t FROM m{k}' for k in '012')}) WHERE t > 0)")
    ctes.append("w0 AS (SELECT cells.*, t0, t1, t2, room, most AS w FROM cells JOIN m0 USING (k0) JOIN m1 USING (k1) JOIN m2 USING (k2), room)")
    for i in range(3 * ROUNDS):
        k, one = i % 3, "least(most, {})" if i % 3 == 2 else "{}"
        w = one.format(f"CASE WHEN own > 0 THEN w * t{k} * room / own ELSE 0 END")
        ctes.append(f"w{i + 1} AS (SELECT k0, k1, k2, tokens, most, t0, t1, t2, room, {w} AS w FROM (SELECT *, sum(w) OVER (PARTITION BY k{k}) AS own FROM w{i}))")
    ctes.append(f"r AS (SELECT k0, k1, k2, CASE WHEN tokens > 0 THEN w / most ELSE 1 END AS p FROM w{3 * ROUNDS})")
    ctes.append("p AS (SELECT doc_id, n, round(p, 9) AS p, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS u FROM d JOIN r USING (k0, k1, k2))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n::BIGINT AS n_tokens, round(p, 6) AS probability, (u < p)::INT AS kept FROM p"


SQL = _sql()
