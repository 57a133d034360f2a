"""Operator 8, suffix-array dedup by depth-limited radix sort.

Suffixes are ordered by their bytes in passes over digits of eight bytes, most significant first: a pass orders what the
passes before left tied, what is alone drops out, and at the depth (100 bytes) the sort stops. Equal groups are then exactly
the repeated windows. Each group of documents sorts its own suffixes; the first of each equal group goes on to a bucket,
which sorts those of all groups. Suffixes that share no 36-byte anchor with another can't be tied at the depth and aren't
sorted at all; the anchors are least names of windows, which also say in which bucket equal windows meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table
from folio.llm.repeats import Group, Spec, mark_repeats


def remove_repeated_bytes(df: DataFrame, depth: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (the remaining bytes), removed (spans in bytes).

    A byte goes if a `depth`-byte string that covers it also starts earlier: in a row with a smaller key, or earlier
    in the same row. Rows of one key count in an order that their texts give. A null text is empty; a null key is the smallest;
    an empty table gives an empty result; other columns are ignored.
    """

    def finish(group: Group, mask: np.ndarray) -> pa.Table:
        doc, a, b = group.run_bounds(mask)
        at, ids = group.at, group.docs.column(key).combine_chunks()
        gone = np.diff(np.r_[0, np.cumsum(mask)][at])
        left = group.data[~mask].tobytes()
        ends = np.r_[0, np.cumsum(np.diff(at) - gone)].tolist()
        first = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        spans = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(kind)))
        kept = pa.array([left[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.table([ids.cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(gone, pa.int64()), kept, spans], names=["doc_id", "n_bytes", "n_removed", "kept", "removed"])

    spec = Spec("bytes", depth, min(36, depth), "minima", True)
    return mark_repeats(df.select(key, text), spec, key, text, finish, "doc_id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,end:long>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
