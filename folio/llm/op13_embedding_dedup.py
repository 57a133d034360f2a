"""Operator 13, near-dedup of embeddings by int8 tile products with error bounds.

Equal vectors of a label are one node. The nodes of a label are dealt to tiles; each pair of tiles is a task, whatever the
label's size. There a vector of length one becomes int8 codes with a scale and the exact norm of what the codes miss, so the
product of two code vectors is a whole number and their cosine lies within a bound of it that is each pair's own. Only pairs
that the bound can't rule out are computed again in double precision. A task answers with one row a node, its links counted and
the root of its tree of links, so a dense group costs a row a node and not a row a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage, quoted, table
from folio.llm.components import components

TILE, FEW = 2048, 128  # nodes of a tile, about; labels of fewer nodes than FEW share tasks
_SIDE, _PAIRS = 1024, 1 << 16  # rows of a product at a time, and pairs computed again at a time
_EXACT = 1 << 10  # dimensions up to which a product of int8 codes is exact in single precision (127^2 * 1024 < 2^24)
_SLACK = 1e-5  # more than what the bounds' own arithmetic in single precision can miss
SIZES_BROADCAST = 100_000


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales and errors: each vector divided by its length is scale * codes + rest, and the rest's length is at most error."""
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(unit).max(1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    return codes.astype(np.int8), scale[:, 0], np.sqrt(((unit - scale * codes) ** 2).sum(1)) * (1 + 1e-12)


def possible(codes: np.ndarray, scale: np.ndarray, error: np.ndarray, a: slice, b: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and of b whose cosine may reach the threshold.

    With u = s p + e and w = t q + f of length one, u w - s t p q = e w + (u - e) f, so the product of the codes misses the cosine
    by |e| + (1 + |e|) |f| at most.
    """
    kind = np.float32 if codes.shape[1] <= _EXACT else np.float64
    got = codes[a].astype(kind) @ codes[b].astype(kind).T
    got *= scale[a, None].astype(kind)
    got *= scale[b].astype(kind)
    got += (error[a, None] * (1 + error[b].max(initial=0))).astype(kind)
    got += error[b].astype(kind)
    i, j = np.nonzero(got >= threshold - _SLACK)
    return i + a.start, j + b.start


def cosines(x: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + _PAIRS]], x[j[k : k + _PAIRS]]) / (norm[i[k : k + _PAIRS]] * norm[j[k : k + _PAIRS]]) for k in range(0, len(i), _PAIRS)] or [np.zeros(0)])


def roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root (each row's least row so far) after the links i, j, too."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return root


def tile_links(x: np.ndarray, count: np.ndarray, cut: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row how many vectors it links with (a row stands for `count` of them) and the least row of its tree. Only the pairs
    across `cut` are looked at; without it all pairs."""
    codes, scale, error = quantised(x)
    norm, links, root = np.sqrt((x * x).sum(1)), np.zeros(len(x), np.int64), np.arange(len(x))
    for a in range(0, cut if cut is not None else len(x), _SIDE):
        own = slice(a, min(a + _SIDE, cut if cut is not None else len(x)))
        for b in range(a if cut is None else cut, len(x), _SIDE):
            i, j = possible(codes, scale, error, own, slice(b, min(b + _SIDE, len(x))), threshold)
            if cut is None and a == b:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 20):
                u, v = i[k : k + (1 << 20)], j[k : k + (1 << 20)]
                near = cosines(x, norm, u, v) >= threshold
                u, v = u[near], v[near]
                links += np.bincount(u, count[v], len(x)).astype(np.int64) + np.bincount(v, count[u], len(x)).astype(np.int64)
                root = roots(root, u, v)
    return links, root


def linked_vectors(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of df.

    Two vectors link if their labels are equal and their cosine, in double precision, is at least the threshold. n_links: how many
    other rows a row links with; component_id: the smallest id reachable; kept: whether that is the own id. A row whose label or
    id is null, or whose vector is null, empty, zero or holds null or non-finite components, links with nothing (component_id its
    own id); vectors of different lengths don't link. Equal rows link with each other, and rows of one id are rows of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    k, v, c = (F.col(n) for n in quoted([key, vector, label]))
    v = v.cast("array<double>")
    fine = k.isNotNull() & c.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(k.cast("long").alias("vec_id"), F.when(fine, c.cast("string")).alias("label"), F.when(fine, v).alias("v"))
    sound, rest = rows.where("v IS NOT NULL"), rows.where("v IS NULL")
    nodes = sound.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("node"), "label", "v", F.size("v").alias("dims"), "n", "least_id"))
    sizes = nodes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("m"))
    total = sizes.agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("k")).first()
    sizes = sizes.select("label", "dims", "m", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    if total["k"] <= SIZES_BROADCAST:
        sizes = F.broadcast(sizes)
    # small labels share tasks; each pair of another label's tiles is a task
    tasks = max(1, -(-(total["m"] or 0) // TILE))
    own = nodes.join(sizes, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("low"), F.greatest(o, F.col("tile")).alias("high")))
    pair = own.select(F.explode(each).alias("pair"), "label", "dims", "m", "tile", "node", "n", "v")
    task = F.when(F.col("m") < FEW, F.pmod(F.xxhash64("label", "dims"), F.lit(tasks))).otherwise(F.xxhash64("label", "dims", "pair"))
    dealt = pair.select(task.alias("task"), "label", "dims", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "tile", "node", "n", "v")

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([(n, "ascending") for n in ("label", "dims", "low", "high", "tile", "node")])
        names = np.asarray(t.column("label").combine_chunks().dictionary_encode().indices)
        by = np.stack([names, *(t.column(n).to_numpy() for n in ("dims", "low", "high"))], 1)
        cuts = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]).any(1), True])
        node, count, tile, out = t.column("node").to_numpy(), t.column("n").to_numpy(), t.column("tile").to_numpy(), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x = t.column("v").slice(a, b - a).combine_chunks()
            x = np.asarray(x.flatten()).astype(np.float64).reshape(b - a, -1)
            one = by[a, 2] == by[a, 3]
            links, root = tile_links(x, count[a:b], None if one else int(np.searchsorted(tile[a:b], by[a, 3])), threshold)
            some = np.flatnonzero(links)
            out.append((node[a:b][some], links[some], node[a:b][root[some]]))
        return pa.table([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["node", "links", "root"])

    met = cut_lineage(dealt.groupBy("task").applyInArrow(block, "node long, links long, root long"))
    of = components(met.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "label", "v", "n", "least_id").join(links, "node", "left").join(of, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = sound.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    done = done.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM f AS a JOIN f AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT u, v FROM p UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u),
c AS (SELECT u, min(v) AS least FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(least, vec_id), vec_id) AS component_id, coalesce(least, vec_id) >= vec_id AS kept FROM e LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""
