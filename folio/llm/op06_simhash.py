"""Operator 6, SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints at 2 or fewer differing bits agree in one
segment up to one bit, so a table of each segment's values is probed with the ball of radius one around the other's;
a bit is only flipped from 0 to 1, as one of two values that differ in a bit has the 0. Matches are verified by the
complete distance. Equal fingerprints are one node throughout, so groups of copies cost one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import grams as G
from folio.llm.common import cut_lineage, quoted, spread, table, text_bytes
from folio.llm.components import components

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: For each byte a 64-bit word of eight lanes that hold its bits, least significant first.
_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def bit_counts(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the 64-bit names in each [bounds[i], bounds[i + 1]) have each bit; (documents, 64)."""
    out = np.zeros((len(bounds) - 1, 64), np.int64)
    if not len(names):
        return out
    some = np.flatnonzero(np.diff(bounds))
    size = np.diff(bounds)[some]
    blocks = -(-size // 255)  # a lane holds up to 255
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(bounds[some], blocks) + 255 * (np.arange(blocks.sum()) - first)
    lanes = np.add.reduceat(_LANES[names.view(np.uint8).reshape(-1, 8)], at, axis=0)
    out[some] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    return out


def shingle_names(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the lower-cased texts, and each text's bounds among them."""
    import xxhash

    joined = [b" ".join(t.translate(_LOWER).split()) for t in texts]
    whole = b"".join(joined)
    bounds = np.r_[0, np.cumsum([len(j) for j in joined], dtype=np.int64)].astype(np.int64)
    starts, ends = G.cut(np.frombuffer(whole, np.uint8), bounds, G._SPACE)
    at = np.searchsorted(starts, bounds)
    size = np.diff(at)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    cuts = np.r_[0, np.cumsum(count)]
    first = np.repeat(at[:-1], count) + np.arange(cuts[-1]) - np.repeat(cuts[:-1], count)
    last = first + np.repeat(np.minimum(size, words), count) - 1
    name = xxhash.xxh64_intdigest
    return np.fromiter((name(whole[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, int(cuts[-1])), cuts


def fingerprints(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) of whole texts. A null text has no words: fingerprint 0."""

    def batch(batches):
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                data, bounds = text_bytes(part.column(1))
                data = data.tobytes()
                names, cuts = shingle_names([data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], words)
                bits = 2 * bit_counts(names, cuts) > np.diff(cuts)[:, None]
                value = np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(value)], ["doc_id", "fp"])

    return spread(df.select(*quoted([key, text]))).mapInArrow(batch, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs u < v of distinct fingerprints at 2 or fewer differing bits; nodes: a column fp without repeats."""
    segments = ("shiftrightunsigned(fp, 32)", "(fp & 4294967295)")
    name = "{0} + {1} * 4294967296L"  # a segment's value and number
    flips = "transform(filter(sequence(0, 31), i -> ({0} & shiftleft(1L, i)) = 0), i -> shiftleft(1L, i))"
    ball = [f"transform(concat(array(0L), {flips.format(x)}), flip -> {name.format(x, k)} + flip)" for k, x in enumerate(segments)]
    held = nodes.selectExpr(f"explode(array({', '.join(name.format(x, k) for k, x in enumerate(segments))})) AS seg", "fp AS a")
    probes = nodes.selectExpr(f"explode(concat({', '.join(ball)})) AS seg", "fp AS b")
    met = held.join(probes, "seg").where("a <> b AND bit_count(a ^ b) <= 2")
    return met.selectExpr("least(a, b) AS u", "greatest(a, b) AS v").distinct()


#: Salts that mix the shingles' names anew for each further word of a long fingerprint.
_SALT = tuple(int(G.mix(np.array([k * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))[0]) for k in range(24))
DIFFERS = np.arccos(2 * 0.8 / 1.8) / np.pi  # chance that a bit differs between documents at a similarity of 0.8
OCCUPIED, IDS_BROADCAST = 1024, 500_000  # rows that a bucket of a segment's table may have on average; ids that are broadcast at most
CHUNK, SHINGLES = 512, 1 << 19  # documents of one loose group in half a block, and shingles of a block


@dataclass(frozen=True)
class Segments:
    """How long fingerprints are cut to find pairs: `count` segments of `bits` each, so many that two documents at a similarity of 0.8
    meet in one with the chance asked for, each long enough for a table of the corpus."""

    bits: int
    count: int

    @staticmethod
    def of(documents: int, recall: float = 0.99) -> Segments:
        bits = 16
        while documents * (bits / 2 + 1) > OCCUPIED * 2.0**bits and bits < 26:
            bits += 1
        p, q = DIFFERS, 1 - DIFFERS
        # a segment meets if none or one of its bits differs, or two, of which one side has one each
        meets = q**bits + bits * p * q ** (bits - 1) + bits * (bits - 1) / 4 * p**2 * q ** (bits - 2)
        return Segments(bits, int(np.ceil(np.log(1 - recall) / np.log(1 - meets))))

    @property
    def words(self) -> int:
        return -(-self.count // (64 // self.bits))

    def values(self) -> list[str]:
        """SQL of each segment's value, from the words f0, f1 and so on."""
        per = 64 // self.bits
        return [f"cast(shiftrightunsigned(f{k // per}, {self.bits * (k % per)}) & {(1 << self.bits) - 1} AS int)" for k in range(self.count)]


CHECKED = 3  # words of a fingerprint that travel with a segment's value, for the distance


def distinct_shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of each text's shingles, ascending and once each, and each text's bounds among them."""
    names, cuts = shingle_names(texts, words)
    doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
    names = names[np.lexsort((names, doc))]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    return names[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(texts)))]


def _set_names(names: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One name for each text's set of shingles: 64 bits of BLAKE2b over the sorted set."""
    data = names.tobytes()
    return np.frombuffer(b"".join(hashlib.blake2b(data[8 * a : 8 * b], digest_size=8).digest() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)), np.int64)


def _in_parts(batches, words: int):
    """(keys, names of distinct shingles, bounds) of a thousand rows (key, text) at a time."""
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            part = b.slice(k, 1000)
            data, bounds = text_bytes(part.column(1))
            data = data.tobytes()
            yield part.column(0).cast(pa.int64()), *distinct_shingles([data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)], words)


def long_fingerprints(df: DataFrame, most_words: int, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, n, f0, f1 and so on): the name and size of the set of shingles, and words of 64 bits, each from the names mixed anew."""

    def batch(batches):
        for ids, names, cuts in _in_parts(batches, words):
            cols = [ids, pa.array(_set_names(names, cuts)), pa.array(np.diff(cuts), pa.int64())]
            for salt in _SALT[:most_words]:
                bits = 2 * bit_counts(G.mix(names ^ np.uint64(salt)), cuts) > np.diff(cuts)[:, None]
                cols.append(pa.array(np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", *(f"f{i}" for i in range(most_words))])

    return spread(df.select(*quoted([key, text]))).mapInArrow(batch, "doc_id long, node long, n long, " + ", ".join(f"f{i} long" for i in range(most_words)))


def most_bits(similarity: float, bits: int = 64 * CHECKED) -> int:
    """Differing bits that two documents of this shingle similarity (Jaccard) have on average, and three standard deviations more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


def _contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u < v of the same components, about one for each node: a node keeps its least neighbour, and its others go to that."""
    for _ in range(3):
        if not len(u):
            break
        order = np.lexsort((u, v))
        u, v = u[order], v[order]
        new = np.r_[True, v[1:] != v[:-1]]
        least = u[np.maximum.accumulate(np.where(new, np.arange(len(u)), 0))]
        a, b = np.concatenate([least[new], least[u > least]]), np.concatenate([v[new], u[u > least]])
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        u, v = pairs[:, 0], pairs[:, 1]
    return u, v


def _met(f: np.ndarray, cuts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (u < v) of links that connect what the pairs at `bits` or fewer differing bits connect within each bucket (rows between cuts)."""
    u, v = [], []
    size = np.diff(cuts)
    near = lambda x, y: np.bitwise_count(f[x] ^ f[y]).sum(-1, dtype=np.int64) <= bits
    small = np.flatnonzero((size > 1) & (size <= 64))
    for step in range(1, int(size[small].max()) if len(small) else 0):  # many buckets at a time
        own = small[size[small] > step]
        count = size[own] - step
        at = np.repeat(cuts[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        ok = near(at, at + step)
        u.append(at[ok])
        v.append(at[ok] + step)
    for k in np.flatnonzero(size > 64).tolist():  # one row against all before it
        label = np.arange(size[k])
        for i in range(1, int(size[k])):
            met = np.flatnonzero(near(slice(cuts[k], cuts[k] + i), cuts[k] + i))
            if len(met):
                groups, first = np.unique(label[met], return_index=True)
                if len(groups) > 1:
                    label[:i][np.isin(label[:i], groups)] = groups[0]
                label[i] = groups[0]
                u.append(cuts[k] + met[first])
                v.append(np.full(len(first), cuts[k] + i))
    if not u:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _contracted(np.concatenate(u), np.concatenate(v))


def long_links(nodes: DataFrame, segments: Segments, bits: int) -> DataFrame:
    """(u, v): links between nodes (node, f0, f1 and so on) that connect all pairs at `bits` or fewer differing bits of the words that
    are checked, which meet in a segment. A bucket says enough to connect them, so a dense group costs a link or so a node.

    Every node stands in the table of each segment under the segment's value and under those with one more bit set, so two
    nodes meet if a segment agrees up to a bit (or two, one on each side). A bucket is a run of sorted rows; nothing but the
    run is held, some 40 bytes a row.
    """
    checked = [f"f{i}" for i in range(min(CHECKED, segments.words))]
    flips = f"concat(array(0), transform(filter(sequence(0, {segments.bits - 1}), i -> ({{0}} & shiftleft(1, i)) = 0), i -> shiftleft(1, i)))"
    keys = ", ".join(f"transform({flips.format(x)}, flip -> {x} + flip + {k} * {1 << segments.bits})" for k, x in enumerate(segments.values()))
    rows = nodes.selectExpr(f"explode(concat({keys})) AS seg", "node", *checked).repartition("seg").sortWithinPartitions("seg", "node")

    def find(batches):
        held, last = [], None  # the rows of a bucket that may go on
        for b in batches:
            if not b.num_rows:
                continue
            t = np.stack([np.asarray(c).astype(np.int64) for c in b.columns], 1)
            begins = np.flatnonzero(np.r_[t[0, 0] != last, t[1:, 0] != t[:-1, 0]])
            if len(begins):
                yield from links_of(held, t[: begins[-1]])
                held, last, t = [], t[-1, 0], t[begins[-1] :]
            held.append(t)
        yield from links_of(held, np.zeros((0, 2 + len(checked)), np.int64))

    def links_of(held: list[np.ndarray], more: np.ndarray):
        t = np.concatenate([*held, more])
        if not len(t):
            return
        cuts = np.flatnonzero(np.r_[True, t[1:, 0] != t[:-1, 0], True])
        u, v = _met(np.ascontiguousarray(t[:, 2:]).view(np.uint64), cuts, bits)
        if len(u):
            pairs = np.unique(np.stack([t[u, 1], t[v, 1]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)], ["u", "v"])

    return rows.mapInArrow(find, "u long, v long").distinct()


def _verified(node: np.ndarray, f: np.ndarray, sets: list[np.ndarray], bits: int, similarity: float) -> list[tuple[int, int]]:
    """Links among the members of a group that connect all of its pairs of this similarity; a pair whose ends are connected isn't looked at."""
    n = np.array([len(s) for s in sets])
    root = list(range(len(node)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in np.argsort(-n, kind="stable").tolist():
        others = np.flatnonzero((np.bitwise_count(f ^ f[i]).sum(-1, dtype=np.int64) <= bits) & (np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i])))
        gap = np.bitwise_count(f[others] ^ f[i]).sum(-1, dtype=np.int64)
        for j in others[np.argsort(gap, kind="stable")].tolist():
            a, b = find(i), find(j)
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (n[i] + n[j] - both):
                root[max(a, b)] = min(a, b)
                out.append((int(node[i]), int(node[j])))
    return out


def verified(loose: DataFrame, nodes: DataFrame, df: DataFrame, words: int, bits: int, similarity: float, key: str, text: str) -> DataFrame:
    """(u, v): links that connect all pairs of this similarity (exact Jaccard of the sets of shingles) within each loose group (node,
    component) of the nodes. Only the groups' documents are cut to shingles again, and a set travels once, unless its group is
    larger than a block: then to the blocks that hold each pair of the group's chunks."""

    def batch(batches):
        for _, names, cuts in _in_parts(batches, words):
            sets = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(names.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_set_names(names, cuts)), sets], ["node", "has"])

    f = [c for c in nodes.columns if c[0] == "f" and c[1:].isdigit()][:CHECKED]
    own = cut_lineage(nodes.join(loose, "node").select("node", "least_id", "n", F.col("component").alias("loose"), *f))
    sizes = own.groupBy("loose").agg((F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(2 * CHUNK), F.sum("n") / F.lit(SHINGLES)))).cast("int").alias("blocks"))
    chunks = F.when(F.col("blocks") == 1, 1).otherwise(2 * F.col("blocks"))
    own = own.join(sizes, "loose").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    ids = cut_lineage(own.select(F.col("least_id").alias("id__")).distinct())
    if ids.limit(IDS_BROADCAST + 1).count() <= IDS_BROADCAST:
        ids = F.broadcast(ids)
    key, text = quoted([key, text])
    texts = df.select(F.col(key).cast("long").alias("key__"), F.col(text).alias("text__"))
    sets = texts.join(ids, F.col("key__") == F.col("id__"), "left_semi").mapInArrow(batch, "node long, has array<long>")
    # small groups share tasks; each pair of a large group's chunks is a task
    total = own.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-total // SHINGLES))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("loose", F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk"))))
    spread_to = F.when(F.col("chunks") == 1, F.array(F.pmod(F.xxhash64("loose"), F.lit(tasks)))).otherwise(pairs)
    rows = own.join(sets, "node").select(F.explode(spread_to).alias("task"), "loose", "node", "has", *f)

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("loose", "ascending"), ("node", "ascending")])
        group, node = t.column("loose").to_numpy(), t.column("node").to_numpy()
        prints = np.ascontiguousarray(np.stack([t.column(c).to_numpy() for c in f], 1)).view(np.uint64)
        has = t.column("has").combine_chunks()
        has = pa.concat_arrays(has.chunks) if isinstance(has, pa.ChunkedArray) else has
        bounds, every = np.asarray(has.offsets), np.asarray(has.values)
        keep = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])])  # documents of one set of shingles, and chunks that meet themselves
        links = []
        for own in np.split(keep, np.flatnonzero(np.diff(group[keep])) + 1):
            if len(own) > 1:
                links += _verified(node[own], prints[own], [every[bounds[i] : bounds[i + 1]] for i in own.tolist()], bits, similarity)
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["u", "v"])

    return rows.groupBy("task").applyInArrow(block, "u long, v long")


def similar_documents(df: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, component_id: groups of documents whose sets of shingles of `words` words are similar (Jaccard), by chains.

    Long fingerprints only name loose groups; within each, all pairs that the fingerprints don't rule out are verified by the
    sets themselves, until they are connected. The smallest id names a group, and each of its rows has it, rows of one id,
    too. Null and empty texts are one group; null keys are none's (component_id null); an empty table gives an empty result;
    other columns are ignored.
    """
    segments = Segments.of(df.count())
    docs = cut_lineage(long_fingerprints(df, segments.words, words, key, text))
    prints = [f"f{i}" for i in range(segments.words)]
    nodes = cut_lineage(docs.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n", *prints)]).where("least_id IS NOT NULL"))
    bits = most_bits(similarity, 64 * min(CHECKED, segments.words))
    loose = cut_lineage(components(long_links(nodes, segments, bits)))
    linked = components(cut_lineage(verified(loose, nodes, df, words, bits, similarity, key, text)))
    named = nodes.join(linked, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "component").select("node", "component_id")
    return docs.join(of, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(df: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id reachable over links, itself included).

    Words are runs without ASCII white space, A-Z lower-cased. A null or empty text has fingerprint zero and links like
    any other; a null key stays a row, and counts in a component only if no other key is there; an empty table gives an
    empty result; other columns are ignored.
    """
    docs = cut_lineage(fingerprints(df, words, key, text))
    nodes = cut_lineage(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = components(links(nodes.select("fp")))
    named = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
