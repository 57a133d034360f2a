"""What the training-data operators share: tables, sizes and document groups."""

from __future__ import annotations

import contextlib
import ctypes
import math
import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.grams import mix


LEAST = -(2**63)  # what a null key counts as
RANGES = 1 << 18  # ranges of keys that the driver tells apart


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of df has it (as Spark compares names)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(names: list[str]) -> list[str]:
    return ["`" + n.replace("`", "``") + "`" for n in names]


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1 and so on, so that no name of theirs (a dot in it, or a name twice) is in the way; and what the named ones are called now."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(quoted(df.columns), df.schema.fields, strict=True))


def text_size(df: DataFrame, *columns: str) -> int:
    """Bytes of the columns' texts as they are worked on, not as they are stored: files may be compressed fifty-fold."""
    wide = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns]
    return df.select(F.sum(sum(wide, F.lit(64))).alias("n")).first()["n"] or 0


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table in fewer splits than there are cores is dealt out before heavy work; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def power_of_two(x: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << math.ceil(math.log2(max(x, 1)))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session names it. Where it names none, a local session has its own
    folder, as in tests; a cluster's executors would not see each other's files there, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder


def with_shared_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    with_shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def text_hash(texts: pa.Array) -> np.ndarray:
    """XXH64 of each text, as Spark's xxhash64; a null counts as empty."""
    import xxhash

    data, bounds = text_bytes(texts)
    data = data.tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)), np.uint64, len(bounds) - 1)


def order_keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(LEAST))


@dataclass(frozen=True)
class Deal:
    """Groups of about one number of bytes, ascending by key.

    Ranges of keys are cut where the bytes are, so clusters of keys and long texts don't pile up. A key that holds more than a
    group's share is a range of its own, cut by the hash of its rows' texts, and a text that holds more than that under one key
    is dealt out row by row; so neither nulls, nor a repeated key, nor identical rows make one task.
    """

    lows: np.ndarray  # where each range of keys begins
    highs: np.ndarray  # its last key
    parts: np.ndarray  # groups that it is cut to
    first: np.ndarray  # the first of them
    hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]  # of a range: hashes of texts that have groups of their own, the first of these, how many, and groups of the other texts

    @staticmethod
    def of(df: DataFrame, key: str, text: str, group_bytes: int, ranges: int = RANGES) -> tuple[Deal, int]:
        """And the bytes of all texts, with 64 a row. The driver holds some five numbers a group, up to `ranges` of them (half a terabyte
        of text in groups of 2 MB); where more groups are wanted, these ranges are cut evenly by key."""
        k = F.coalesce(F.col(quoted([key])[0]).cast("long"), F.lit(LEAST))
        width = F.coalesce(F.octet_length(F.col(quoted([text])[0])), F.lit(0)).cast("long") + 64
        sizes = cut_lineage(df.select(k.alias("k"), width.alias("w")))
        r = sizes.agg(F.sum("w").alias("size"), F.min("k").alias("low"), F.max("k").alias("high")).first()
        if not r["size"]:
            one = np.zeros(1, np.int64)
            return Deal(one + LEAST, one - 1, one + 1, one, {}), 0
        share = max(group_bytes, r["size"] / ranges)
        low, high, held = _leaves(sizes, r["low"], r["high"], r["size"], share)
        # neighbours are put together while they stay within the share
        begins, sums, filled = [], [], math.inf
        for i, w in enumerate(held.tolist()):
            if filled + w > share:
                begins.append(i)
                sums.append(0)
                filled = 0
            sums[-1] += w
            filled += w
        begins, sums = np.array(begins), np.array(sums, float)
        lows, highs = low[begins], high[np.r_[begins[1:], len(low)] - 1]
        parts = np.maximum(1, np.ceil(sums / group_bytes - 1e-9)).astype(np.int64)
        single = lows == highs
        hot = Deal._hot(df, k, width, text, lows[single & (parts > 1)], lows, sums, group_bytes)
        for at, (_, _, own, rest) in hot.items():
            parts[at] = own.sum() + rest
        return Deal(lows, highs, parts, np.cumsum(parts) - parts, hot), r["size"]

    @staticmethod
    def _hot(df: DataFrame, k: Column, width: Column, text: str, keys: np.ndarray, lows: np.ndarray, sums: np.ndarray, group_bytes: int) -> dict[int, tuple]:
        """For each key that is cut: its texts that hold more than half a group; together no more than two a group."""
        if not len(keys):
            return {}
        spark = df.sparkSession
        own = df.select(k.alias("k"), width.alias("w"), F.xxhash64(F.coalesce(F.col(quoted([text])[0]), F.lit(""))).alias("h"))
        cut = F.broadcast(spark.createDataFrame([(i,) for i in keys.tolist()], "k long"))  # a group each at least
        texts = own.join(cut, "k").groupBy("k", "h").agg(F.sum("w").alias("w")).where(F.col("w") > group_bytes / 2).orderBy("k", "h").toArrow()
        tk, th, tw = (texts.column(c).to_numpy() for c in ("k", "h", "w"))
        hot = {}
        for key in keys.tolist():
            at = int(np.searchsorted(lows, key))
            mine = slice(np.searchsorted(tk, key), np.searchsorted(tk, key, side="right"))
            parts = np.ceil(tw[mine] / group_bytes).astype(np.int64)
            rest = max(1, math.ceil((sums[at] - tw[mine].sum()) / group_bytes))
            hot[at] = th[mine].copy(), rest + np.cumsum(parts) - parts, parts, rest
        return hot

    def __call__(self, keys: np.ndarray, texts: pa.Array) -> np.ndarray:
        r = np.maximum(np.searchsorted(self.lows, keys, side="right") - 1, 0)
        sub, single = np.zeros(len(keys), np.int64), self.lows == self.highs
        wide = np.flatnonzero((self.parts[r] > 1) & ~single[r])
        low, high, n = (x[r[wide]] for x in (self.lows, self.highs, self.parts))
        sub[wide] = np.minimum((keys[wide].astype(float) - low) / (high.astype(float) - low + 1) * n, n - 1).astype(np.int64)
        cut = np.flatnonzero((self.parts[r] > 1) & single[r])
        if len(cut):
            h = text_hash(texts.take(pa.array(cut)))
            again, salt = ordinals(h), mix(keys.astype(np.uint64).sum(keepdims=True) + np.uint64(partition_id()))  # other tasks and batches begin elsewhere
            for at in np.unique(r[cut]).tolist():
                of, first, own, rest = self.hot[at]
                mine = np.flatnonzero(r[cut] == at)
                sub[cut[mine]] = np.minimum(h[mine] / 2.0**64 * rest, rest - 1).astype(np.int64)
                if len(of):
                    place = np.minimum(np.searchsorted(of, h[mine].view(np.int64)), len(of) - 1)
                    hit = of[place] == h[mine].view(np.int64)
                    place, mine = place[hit], mine[hit]
                    sub[cut[mine]] = first[place] + (mix(again[mine].astype(np.uint64) + salt) % own[place].astype(np.uint64)).astype(np.int64)
        return self.first[r] + np.clip(sub, 0, None)

    def rank(self, groups: np.ndarray) -> np.ndarray:
        """Groups of one key have one rank; else a smaller rank has smaller keys."""
        r = np.searchsorted(self.first, groups, side="right") - 1
        return np.where(self.lows[r] == self.highs[r], self.first[r], groups)


def _leaves(sizes: DataFrame, low: int, high: int, size: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of keys (first, last, bytes) that hold half the share at most, or one key: what is too much is cut to narrower ranges, by
    its bytes, in passes over the keys' sizes. A pass makes ranges 64 times narrower at least, so there are 11 at most."""
    low, high, held = np.array([low]), np.array([high]), np.array([size], np.int64)
    while (over := np.flatnonzero((held > share / 2) & (low < high))).size:
        cuts = np.maximum(64, np.ceil(4 * held[over] / share)).astype(np.int64)
        at, first = low[over], np.cumsum(cuts) - cuts
        span = high[over].astype(np.uint64) - at.astype(np.uint64)  # modulo 2^64, so that it is right beyond 2^63, too
        step = span // cuts.astype(np.uint64) + np.uint64(1)

        def count(batches, at=at, last=high[over], first=first, step=step, buckets=int(cuts.sum())):
            held, least, most = np.zeros(buckets, np.int64), np.full(buckets, 2**63 - 1), np.full(buckets, LEAST)
            for b in batches:
                k, w = b.column(0).to_numpy(), b.column(1).to_numpy()
                r = np.searchsorted(at, k, side="right") - 1
                inside = (r >= 0) & (k <= last[np.maximum(r, 0)])
                k, w, r = k[inside], w[inside], r[inside]
                bucket = first[r] + ((k.astype(np.uint64) - at[r].astype(np.uint64)) // step[r]).astype(np.int64)
                np.add.at(held, bucket, w)
                np.minimum.at(least, bucket, k)
                np.maximum.at(most, bucket, k)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(buckets), held, least, most)], ["bucket", "w", "low", "high"])

        got = sizes.mapInArrow(count, "bucket long, w long, low long, high long").groupBy("bucket").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
        keep = np.ones(len(low), bool)
        keep[over] = False
        low, high, held = (np.concatenate([x[keep], got.column(c).to_numpy()]) for x, c in ((low, "low"), (high, "high"), (held, "w")))
        order = np.argsort(low)
        low, high, held = low[order], high[order], held[order]
    return low, high, held


def ordinals(names: np.ndarray) -> np.ndarray:
    """0 for the first of equal names, 1 for the second and so on."""
    order = np.argsort(names, kind="stable")
    new = np.r_[True, names[order][1:] != names[order][:-1]][: len(names)]
    out = np.empty(len(names), np.int64)
    out[order] = np.arange(len(names)) - np.maximum.accumulate(np.where(new, np.arange(len(names)), 0)) if len(names) else 0
    return out


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context is not None else 0


def by_hash(groups: int) -> Callable[[np.ndarray, pa.Array], np.ndarray]:
    """Deals rows by a hash of key and text, and identical rows one by one."""

    def deal(keys: np.ndarray, texts: pa.Array) -> np.ndarray:
        h = mix(text_hash(texts) ^ mix(keys.astype(np.uint64)))
        return (mix(h + ordinals(h).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)

    return deal


def packed(df: DataFrame, key: str, text: str, deal: Callable[[np.ndarray, pa.Array], np.ndarray], pack_mb: int = 12) -> DataFrame:
    """(grp, blob): rows gathered by groups; each blob an Arrow stream under zstd.

    All columns travel inside the blob, so their names can't clash.
    """

    def flush(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        grp = deal(order_keys(t.column(key).combine_chunks()), _flat(t.column(text)))
        order = np.argsort(grp, kind="stable")
        t, grp = t.take(pa.array(order)), grp[order]
        cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
        blobs = []
        for a, b in zip(cuts, [*cuts[1:], len(grp)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t.slice(a, b - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        for i in range(0, len(blobs), 64):
            yield pa.RecordBatch.from_arrays([pa.array(grp[cuts[i : i + 64]], pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], ["grp", "blob"])

    def pack(batches):
        rows, size = [], 0
        for b in batches:
            if b.num_rows:
                rows.append(b)
                size += b.nbytes
            if size > pack_mb << 20:
                yield from flush(rows)
                rows, size = [], 0
        if rows:
            yield from flush(rows)
        release()

    return df.mapInArrow(pack, "grp int, blob binary")


def _flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def release() -> None:
    """Gives a worker's freed memory back: workers live on between stages, and glibc and Arrow keep what they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def unpacked(blobs: pa.Table, key: str, text: str) -> pa.Table:
    """The rows of one group in order of key, whatever order the shuffle fetched; rows of one key by the hash of their texts, then by the texts."""
    release()
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs.column("blob").combine_chunks()]
    t = pa.concat_tables(parts).combine_chunks()
    if t.num_rows < 2:
        return t
    keys = order_keys(t.column(key))
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    if again.any():
        tied = np.zeros(len(keys), bool)
        tied[order[1:][again]] = tied[order[:-1][again]] = True
        h = np.zeros(len(keys), np.uint64)
        texts = _flat(t.column(text))
        h[tied] = text_hash(texts.filter(pa.array(tied)))
        by = pa.table([pa.array(keys), pa.array(h), texts], names=["k", "h", "t"])
        order = np.asarray(pc.sort_indices(by, sort_keys=[("k", "ascending"), ("h", "ascending"), ("t", "ascending")]))
    return t.take(pa.array(order)).combine_chunks()


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes behind one another, and n + 1 bounds; a null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.fill_null("").cast(pa.large_binary())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    bounds = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]
