"""Operator 12, the trie of conversations' prefixes by partition refinement.

All conversations start as one class, the root. A turn splits each active class by what its members say there; a class of one
distinct sequence is retired, and its tail comes out as a chain of nodes that have one child each. Equal conversations are one
sequence with its number of members from the start, so groups of copies retire like singletons. A class whose tails are few
rows is refined to its end within a task (all turns in memory, by the same passes); a larger one is split by Spark, one
aggregation a turn. Then what lies below each node is folded back: chains and small classes within their task, the rest a
depth at a time. Turns are told by the SHA-256 of role and text; the texts move once, to be ordered.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut_lineage, quoted, shared_folder, table

SMALL = 1 << 16  # turns that a class may have left to be refined within a task
IDS = 1 << 14  # ids of a piece of text
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: executors that are lost don't cost it, and filters on it reach the files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0, by turn, nulls first; ties by role, then text), name (SHA-256 of role and text), bytes (of the text).

    Ordered by ranges of the whole key, so a conversation may lie in many parts: a part numbers its own rows, and the few
    conversations that go over a part's end get what the parts before hold added.
    """
    k, t, r, x = (F.col(n) for n in quoted([key, turn, role, text]))
    r, x = F.coalesce(r.cast("string"), F.lit("")), F.coalesce(x.cast("string"), F.lit(""))
    rows = df.where(k.isNotNull()).select(k.cast("long").alias("conv"), t.alias("turn"), r.alias("role"), x.alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(n).asc_nulls_first() for n in ("conv", "turn", "role", "text")]
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.select("conv", name.alias("name"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"))

    def number(batches):
        last, have = None, 0
        for b in batches:
            if b.num_rows:
                c = b.column(0).to_numpy()
                new = np.r_[c[0] != last, c[1:] != c[:-1]]
                at = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
                first = np.flatnonzero(new)
                at[: first[0] if len(first) else len(c)] += have
                last, have = c[-1], int(at[-1]) + 1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], [*b.schema.names, "at"])

    rows = kept(rows.mapInArrow(number, "conv long, name binary, bytes long, part int, at long"), "turns")
    held = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("held"))
    # at most two conversations of a part go on beyond it
    ends = held.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))
    over = held.join(F.broadcast(ends), ["part", "conv"]).groupBy("conv").agg(F.collect_list(F.struct("part", "held")).alias("all")).where(F.size("all") > 1)
    before = F.transform("all", lambda p: F.struct(p["part"].alias("part"), F.aggregate(F.filter("all", lambda q: q["part"] < p["part"]), F.lit(0).cast("long"), lambda s, q: s + q["held"]).alias("before")))
    over = over.select("conv", F.explode(before).alias("b")).select("conv", "b.part", "b.before")
    return rows.join(F.broadcast(over), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "name", "bytes")


def branched(turns: DataFrame, base: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns as in `turns`, and (conv, n), which has those without turns, too. Conversation c begins with the first
    h turns of conversation c - c % base, h = crc32(c) % heads, and goes on with its own turns after its first h."""

    def head(c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary")) % heads

    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    root = F.col("conv") - F.col("conv") % base
    bases = own.select(F.col("conv").alias("root"), F.col("own").alias("has")).where(F.col("root") % base == 0)
    all_ = own.withColumn("root", root).join(bases, "root", "left").select("conv", "root", "own", F.least(head(F.col("conv")), F.coalesce("has", F.lit(0))).alias("from_root"))
    all_ = cut_lineage(all_.withColumn("n", F.col("from_root") + F.greatest(F.col("own") - head(F.col("conv")), F.lit(0))))
    tails = turns.where(F.col("pos") >= head(F.col("conv")))
    moved = all_.where("from_root < " + f"crc32(cast(cast(conv AS string) AS binary)) % {heads}").select("conv", "from_root")
    tails = tails.join(moved, "conv", "left").select("conv", (F.col("pos") - F.when(F.col("from_root").isNotNull(), head(F.col("conv")) - F.col("from_root")).otherwise(0)).alias("pos"), "name", "bytes")
    first = turns.where((F.col("conv") % base == 0) & (F.col("pos") < heads - 1)).select(F.col("conv").alias("root"), "pos", "name", "bytes")
    given = first.join(all_.where("from_root > 0").select("conv", "root", "from_root"), "root").where("pos < from_root").select("conv", "pos", "name", "bytes")
    return given.unionByName(tails), all_.select("conv", "n")


def sequences(turns: DataFrame, every: DataFrame) -> DataFrame:
    """(conv, n, seq, m): each conversation with the least of those that say the same, and how many they are.

    Told by their numbers of turns and 192 bits of their turns' names and places, which add up in any order, so that no
    conversation is gathered."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "pos", "name")).alias(f"x{i}") for i in range(3)]
    of = every.join(turns.groupBy("conv").agg(*marks), "conv", "left")
    marks = [F.coalesce(f"x{i}", F.lit(0)).alias(f"x{i}") for i in range(3)]
    of = cut_lineage(of.select("conv", "n", *marks))
    same = of.groupBy("n", "x0", "x1", "x2").agg(F.min("conv").alias("seq"), F.count(F.lit(1)).alias("m"))
    return cut_lineage(of.join(same, ["n", "x0", "x1", "x2"]).select("conv", "n", "seq", "m"))


def refined(seq: np.ndarray, m: np.ndarray, top: np.ndarray, row: np.ndarray, name: np.ndarray, size: np.ndarray, depth: int) -> dict[str, pa.Array]:
    """All nodes below classes of one depth: seq, m and top (the class) of each sequence, its rows [row[i], row[i + 1]) of names (numbers)
    and bytes from that depth on. `ends` is the sequence that ends at a node, or null.

    A pass splits each active class by its members' next names. A class of one sequence leaves at once; its tail is a chain. The fold
    goes back over the passes."""
    left, n = np.diff(row), len(seq)
    suffix = np.r_[0, np.cumsum(size)]
    levels, active, cls, chains = [], np.arange(n), np.unique(top, return_inverse=True)[1].astype(np.int64), []
    parent_conv = top
    step = 0
    while len(active):
        going = left[active] > step
        active, cls, parent_conv = active[going], cls[going], parent_conv[going]
        if not len(active):
            break
        at = row[active] + step
        _, new = np.unique(cls * (int(name.max()) + 1) + name[at], return_inverse=True)
        order = np.lexsort((seq[active], new))
        first = order[np.flatnonzero(np.r_[True, new[order][1:] != new[order][:-1]])]
        count = np.bincount(new)
        level = {"conv": seq[active[first]], "depth": np.full(len(first), depth + step + 1), "parent": parent_conv[first], "up": cls[first], "convs": np.bincount(new, m[active]).astype(np.int64), "bytes": size[at[first]]}
        level |= {"children": np.zeros(len(first), np.int64), "leaves": np.zeros(len(first), np.int64), "saved": (level["convs"] - 1) * level["bytes"], "ends": np.zeros(len(first), np.int64), "end": np.zeros(len(first), bool)}
        over = np.flatnonzero(left[active] == step + 1)  # at most one in a class, as the sequences are distinct
        level["ends"][new[over]], level["end"][new[over]] = seq[active[over]], True
        alone = count[new] == 1
        one = active[alone]  # retired: what is left of it is a chain below the node
        tail = left[one] - step - 1
        level["children"][new[alone]] += (tail > 0).astype(np.int64)
        level["leaves"][new[alone]] += 1
        level["saved"][new[alone]] += (m[one] - 1) * (suffix[row[one + 1]] - suffix[row[one] + step + 1])
        chains.append((one, step + 1))
        levels.append(level)
        parent_conv = level["conv"][new]
        active, cls, parent_conv = active[~alone], new[~alone], parent_conv[~alone]
        step += 1
    for k in range(len(levels) - 1, -1, -1):
        below = levels[k]
        below["leaves"] = np.where(below["children"] == 0, 1, below["leaves"])
        if k:
            up = levels[k - 1]
            np.add.at(up["children"], below["up"], 1)
            np.add.at(up["leaves"], below["up"], below["leaves"])
            np.add.at(up["saved"], below["up"], below["saved"])
    columns = ("conv", "depth", "parent", "convs", "children", "leaves", "saved", "ends", "end")
    out = [{x: lv[x] for x in columns} for lv in levels]
    for one, begin in chains:
        tail = left[one] - begin
        at = np.repeat(row[one] + begin - (np.cumsum(tail) - tail), tail) + np.arange(tail.sum())
        of = np.repeat(one, tail)
        end = row[of + 1]
        conv, last = seq[of], at + 1 == end
        out.append({"conv": conv, "depth": depth + 1 + at - row[of], "parent": conv, "convs": m[of], "children": (~last).astype(np.int64), "leaves": np.ones(len(at), np.int64), "saved": (m[of] - 1) * (suffix[end] - suffix[at]), "ends": conv, "end": last})
    got = {x: np.concatenate([o[x] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for x in columns}
    end = got.pop("end").astype(bool)
    return {x: pa.array(v, mask=~end if x == "ends" else None) for x, v in got.items()}


def _small(classes: DataFrame, turns: DataFrame, depth: int, rows: int) -> DataFrame:
    """The nodes below classes (seq, n, m, cls) of few rows, whole classes dealt to tasks of about as many rows as a small class may have."""
    tasks = max(1, -(-rows // SMALL))
    tail = turns.where(F.col("pos") >= depth)
    dealt = classes.join(tail, classes["seq"] == tail["conv"]).select(F.pmod(F.xxhash64("cls"), F.lit(tasks)).alias("task"), "cls", "seq", "m", "pos", "name", "bytes")

    def refine(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("cls", "ascending"), ("seq", "ascending"), ("pos", "ascending")])
        seq = t.column("seq").to_numpy()
        row = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1], True])
        name = np.asarray(t.column("name").combine_chunks().dictionary_encode().indices).astype(np.int64)
        got = refined(seq[row[:-1]], t.column("m").to_numpy()[row[:-1]], t.column("cls").to_numpy()[row[:-1]], row, name, t.column("bytes").to_numpy(), depth)
        return pa.table(list(got.values()), names=[c.split()[0] for c in _NODE.split(", ")])

    return dealt.groupBy("task").applyInArrow(refine, _NODE)


def _chain(alone: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """The nodes below classes of one sequence, row by row: nothing is gathered. What a chain saves is summed only where there are copies."""
    rows = turns.where(F.col("pos") >= depth).join(alone, turns["conv"] == alone["seq"])
    node = rows.select("seq", (F.col("pos") + 1).alias("depth"), "m", "n", "bytes")
    single = node.where("m = 1").select("seq", "depth", "m", "n", F.lit(0).cast("long").alias("saved"))
    copies = node.where("m > 1")
    # sums from the end, in blocks, so that a long conversation isn't one task
    block = (F.col("depth") / SMALL).cast("long")
    blocks = copies.groupBy("seq", block.alias("block")).agg(F.sum("bytes").alias("all"))
    after = F.sum("all").over(Window.partitionBy("seq").orderBy(F.desc("block"))) - F.col("all")
    own = F.sum("bytes").over(Window.partitionBy("seq", "block").orderBy(F.desc("depth")))
    copies = copies.withColumn("block", block).withColumn("own", own).join(blocks.select("seq", "block", after.alias("after")), ["seq", "block"])
    copies = copies.select("seq", "depth", "m", "n", ((F.col("m") - 1) * (F.col("own") + F.col("after"))).alias("saved"))
    return single.unionByName(copies).select(
        F.col("seq").alias("conv_id"), "depth", F.col("seq").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(F.col("depth") == F.col("n"), F.col("seq")).alias("ends"))


def trie(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends (the sequence that ends there) of every node;
    seqs: distinct sequences (seq, n, m)."""
    spark = turns.sparkSession
    top = seqs.agg(F.min("seq"), F.sum("m"), F.max(F.when(F.col("n") == 0, F.col("seq")))).first()
    if top[0] is None:
        return spark.createDataFrame([], _NODE)
    large = [spark.createDataFrame([(top[0], top[1], None, 0, top[2])], "cls long, convs long, parent long, bytes long, ends long")]  # the nodes that Spark has split, a depth each
    active, done, depth = cut_lineage(seqs.select("seq", "n", "m", F.lit(top[0]).cast("long").alias("cls"))), [], 0  # a literal would make the joins by class products
    while True:
        size = active.groupBy("cls").agg(F.count(F.lit(1)).alias("seqs"), F.sum(F.col("n") - depth).alias("rows"))
        kind = F.when(F.col("seqs") == 1, 0).when(F.col("rows") <= SMALL, 1).otherwise(2)
        size = cut_lineage(size.select("cls", "rows", kind.alias("kind")))
        left = {r["kind"]: r["rows"] for r in size.groupBy("kind").agg(F.sum("rows").alias("rows")).collect()}
        sorted_ = active.join(size.select("cls", "kind"), "cls")
        if 0 in left:
            done.append(_chain(sorted_.where("kind = 0").select("seq", "n", "m"), turns, depth).withColumn("top", F.lit(depth)))
        if left.get(1):
            done.append(_small(sorted_.where("kind = 1").select("seq", "n", "m", "cls"), turns, depth, left[1]).withColumn("top", F.lit(depth)))
        if 2 not in left:
            break
        here = turns.where(F.col("pos") == depth).select("conv", "name", "bytes")
        own = sorted_.where(f"kind = 2 AND n > {depth}").select("seq", "n", "m", F.col("cls").alias("parent"))
        own = cut_lineage(own.join(here, own["seq"] == here["conv"]).drop("conv"))
        new = own.groupBy("parent", "name").agg(F.min("seq").alias("cls"), F.sum("m").alias("convs"), F.first("bytes").alias("bytes"), F.max(F.when(F.col("n") == depth + 1, F.col("seq"))).alias("ends"))
        new = cut_lineage(new)
        active = cut_lineage(own.join(new.select("parent", "name", "cls"), ["parent", "name"]).select("seq", "n", "m", "cls"))
        large.append(new.select("cls", "convs", "parent", "bytes", "ends"))
        depth += 1
    below = kept(_union(spark, done), "below") if done else spark.createDataFrame([], _NODE + ", top int")
    # fold back: each depth that Spark split takes what its chains, small classes and split children sum to
    out, up = [below.drop("top")], None
    for d in range(len(large) - 1, -1, -1):
        given = below.where((F.col("top") == d) & (F.col("depth") == d + 1)).select(F.col("parent_conv_id").alias("cls"), "n_leaves", "saved_tokens")
        if up is not None:
            given = given.unionByName(up)
        sums = given.groupBy("cls").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        node = large[d].join(sums, "cls", "left").select(
            F.col("cls").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0)) + (F.col("convs") - 1) * F.col("bytes")).alias("saved_tokens"), "ends")
        node = cut_lineage(node)
        up = node.select(F.col("parent_conv_id").alias("cls"), "n_leaves", "saved_tokens")
        out.append(node)
    return _union(spark, out)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ids_hashed(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of each group's ids (seq, conv), ascending and comma-joined. Single ids are hashed by Spark; others become
    pieces of text in ranges of (seq, conv), and a group's pieces are hashed as they stream by, so none is held whole."""
    alone = members.where("m = 1").select("seq", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
    many = members.where("m > 1").select("seq", "conv").repartitionByRange("seq", "conv").sortWithinPartitions("seq", "conv")

    def pieces(batches):
        for b in batches:
            for k in range(0, b.num_rows, IDS):
                seq, conv = (b.column(i).slice(k, IDS).to_numpy() for i in range(2))
                cuts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1], True])
                texts = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seq[cuts[:-1]]), pa.array(conv[cuts[:-1]]), pa.array(texts, pa.string())], ["seq", "first", "ids"])

    def digest(batches):
        seq, h = None, None
        for b in batches:
            out = []
            for s, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if s != seq:
                    if h is not None:
                        out.append((seq, h.hexdigest()))
                    seq, h = s, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["seq", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([h.hexdigest()])], ["seq", "ends_sha256"])

    texts = many.mapInArrow(pieces, "seq long, first long, ids string").repartition("seq").sortWithinPartitions("seq", "first")
    return alone.unionByName(texts.mapInArrow(digest, "seq long, ends_sha256 string"))


def prefix_trie(df: DataFrame, rebuild: bool = False, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    A node is a distinct sequence of first turns (role, text), named by its smallest conversation and its depth; the root has depth 0
    and no parent. n_convs: conversations that begin so; saved_tokens: bytes of text that the subtree holds once instead of once
    a conversation; ends_sha256: of the ids of those that end there. Turns are ordered by `turn`, nulls first, ties by role, then
    text; repeated rows are turns of their own. A null role or text counts as empty; rows with a null conversation belong to none and
    are left out; an empty table gives an empty result; other columns are ignored. With `rebuild` the conversations are those of
    ``branched``, in which one may have no turn.
    """
    turns = numbered_turns(df, key, turn, role, text)
    if rebuild:
        turns, every = branched(turns)
    else:
        every = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    turns = kept(turns, "turns")
    members = sequences(turns, every)
    seqs = cut_lineage(members.where("conv = seq").select("seq", "n", "m"))
    nodes = trie(turns.join(seqs.select("seq"), turns["conv"] == F.col("seq"), "left_semi"), seqs)
    ended = nodes.where("ends IS NOT NULL").join(ids_hashed(members).select(F.col("seq").alias("ends"), "ends_sha256"), "ends")
    none = nodes.where("ends IS NULL").withColumn("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return ended.unionByName(none).drop("ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


#: CRC-32 by its rule (polynomial 0xEDB88320, reflected): a table of 256 steps of 8 bits each, then a step for each digit.
SQL = r"""
WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t FROM range(0, 256) AS r(i)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS say FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda s, b: xor(t[xor(s, b) % 256 + 1], s // 256), 4294967295::BIGINT)) % 9 AS h FROM (SELECT DISTINCT c FROM t), crc),
u AS (SELECT h.c, 0 AS own, t.p, say FROM h JOIN t ON t.c = h.c - h.c % 5 AND t.p < h UNION ALL SELECT h.c, 1, t.p, say FROM h JOIN t ON t.c = h.c AND t.p >= h),
s AS (SELECT h.c, coalesce(s, []) AS s FROM h LEFT JOIN (SELECT c, list(say ORDER BY own, p) AS s FROM u GROUP BY c) USING (c)),
m AS (SELECT c, s[1:d] AS path, d, len(s) = d AS ends FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(path[d].x) END AS saved FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
b AS (SELECT path[1:e] AS path, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM (SELECT n.path, saved, k.path IS NULL AS leaf, unnest(range(0, d + 1)) AS e FROM n LEFT JOIN k ON k.path = n.path) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN b ON b.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n AS up ON n.d > 0 AND up.path = n.path[1:n.d - 1]"""
