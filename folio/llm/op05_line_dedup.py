"""Operator 5, line dedup by winnowing over line hashes.

Names of `gram` consecutive lines are winnowed: the least of each window is a fingerprint, so that any two equal
runs of `run` lines share one. Where fingerprints meet, the runs around them are compared line by line, and every later
copy of a repeated run is deleted. A long line stands for two lines or three, so a passage of few long lines is a run, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ddl, fresh, numbered, table
from folio.llm.repeats import Group, Spec, mark_repeats

LONG = (25, 50)  # words from which a line stands for two lines, and for three


def remove_repeated_lines(df: DataFrame, run: int = 3, gram: int = 2, long: tuple[int, ...] = LONG, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df with the lines deleted from its text, and n_lines_removed__ (long) behind them.

    A line goes if it lies in consecutive non-empty lines that also start earlier and count as `run` lines at least: in a
    row with a smaller key, or earlier in the same row (rows of one key: in an order that their texts give; a null key is
    the smallest). A line counts once, and once more for each number in `long` of words that it reaches. Lines end at "\\n";
    an empty line stays unless it lies inside a deleted run. A text that loses nothing stays as it is, null included; an
    empty table gives an empty result. If df has a column n_lines_removed__, underscores are appended to the new one's name.
    """
    names = [*df.columns, fresh(df, "n_lines_removed__")]
    df, (key, text) = numbered(df, key, text)

    def finish(group: Group, mask: np.ndarray) -> pa.Table:
        at, bounds = group.at, group.bounds
        gone = np.diff(np.r_[0, np.cumsum(mask)][at])
        doc, a, b = group.run_bounds(mask)
        texts = group.docs.column(text).combine_chunks().to_pylist()
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.flatnonzero(gone).tolist():
            data, left, have = group.data[bounds[i] : bounds[i + 1]].tobytes(), [], 0
            for x, y in zip(a[first[i] : first[i + 1]] + at[i], b[first[i] : first[i + 1]] + at[i], strict=True):
                left.append(data[have : group.starts[x] - bounds[i]])
                have = group.ends[y - 1] - bounds[i] + 1  # and the line's end
            left.append(data[have:])
            kept = b"".join(left)
            if not data.endswith(b"\n") and kept.endswith(b"\n"):
                kept = kept[:-1]
            texts[i] = kept.decode()
        t = group.docs
        t = t.set_column(t.column_names.index(text), text, pa.array(texts, pa.string()))
        return t.append_column("n", pa.array(gone, pa.int64()))

    return mark_repeats(df, Spec("lines", run, min(gram, run), "minima", True, tuple(long)), key, text, finish, f"{ddl(df)}, n long").toDF(*names)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the kept text's digest; its oracle is a brute-force version (tests/llm)."""
    out = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_removed__").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
