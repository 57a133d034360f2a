"""Folds over rows in order, for rules whose state no window can say: one pass over sorted partitions, nothing held but the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def sorted_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], begin: Callable[[], Any], step: Callable[[Any, Any], tuple | None], schema: str) -> DataFrame:
    """step(state, row) of each row, in order, with a fresh state for each group of `by`; a step that gives None gives no row.

    A group may be of any size: its rows pass in batches and only its state stays.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                key = tuple(getattr(row, c) for c in by)
                if last is None or key != last:
                    last, state = key, begin()
                if (got := step(state, row)) is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
