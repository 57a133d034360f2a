"""The folds that also run over streams: script counters by document and job states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.scripts import COUNTERS, script_counts
from folio.operators.catalog import job_states


def script_totals(lines: DataFrame) -> DataFrame:
    """Counters summed by doc_id over a stream (or table) of lines (doc_id, text); update or complete mode."""
    return lines.select("doc_id", *script_counts(F.col("text"))).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def streamed_job_states(events: DataFrame) -> DataFrame:
    return job_states(events)
