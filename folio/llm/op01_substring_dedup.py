"""Operator 1, substring dedup by fixed-block anchors.

Non-overlapping blocks of every document are indexed and probed with every rolling window of the same
length; hits are extended to windows of the threshold length, which are compared word by word
and united to maximal exact repeats. A window of n words holds a whole block of b words wherever it
starts if n >= 2 b - 1, so with n = 13 and b = 7 no repeat is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table
from folio.llm.repeats import Group, Spec, mark_repeats


def remove_repeated_passages(df: DataFrame, words: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), removed (spans in words).

    A word goes if a window of `words` words that covers it also starts in a row with a smaller key.
    Words are runs without ASCII white space. A null text has no words; rows of one key (null: one key, the
    smallest) don't remove each other's words; an empty table gives an empty result; other columns are ignored.
    """

    def finish(group: Group, mask: np.ndarray) -> pa.Table:
        doc, a, b = group.run_bounds(mask)
        at, bounds, ids = group.at, group.bounds, group.docs.column(key).combine_chunks()
        gone = np.diff(np.r_[0, np.cumsum(mask)][at])
        data, kept, spans = group.data.tobytes(), [], []
        first = np.searchsorted(doc, np.arange(len(ids) + 1))
        for i in range(len(ids)):
            parts = data[bounds[i] : bounds[i + 1]].split()
            if gone[i]:
                keep = ~mask[at[i] : at[i + 1]]
                parts = [w for w, k in zip(parts, keep.tolist(), strict=True) if k]
            kept.append(b" ".join(parts))
            r = slice(first[i], first[i + 1])
            spans.append([{"start": x, "end": y} for x, y in zip(a[r].tolist(), b[r].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([ids.cast(pa.int64()), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind)], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    spec = Spec("words", words, (words + 1) // 2, "blocks", False)
    return mark_repeats(df.select(key, text), spec, key, text, finish, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))
