"""Queries over the events as jobs: by windows over the table, and replayed as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.plans.base import query, table
from folio.operators.rounds import new_folder
from folio.streaming.jobs import SCHEMA, job_flow as flow
from folio.streaming.jobs import kind_of, streamed_job_flow, with_timers

_FLOW = """WITH e AS (SELECT user_id AS slot, event_id AS id, ts, CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'step' END AS kind FROM events),
b AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 86400 SECOND OR lag(kind) OVER w IN ('done', 'error'), false) AS parted FROM e WINDOW w AS (PARTITION BY slot ORDER BY ts, id)),
p AS (SELECT *, sum(parted::INT) OVER (PARTITION BY slot ORDER BY ts, id) AS part FROM b),
f AS (SELECT *, min(CASE WHEN kind = 'request' THEN {'ts': ts, 'id': id} END) OVER (PARTITION BY slot, part) AS begin FROM p),
j AS (SELECT slot, begin.id AS job_id, begin.ts AS started, max(ts) AS last, arg_max(kind, {'ts': ts, 'id': id}) AS kind, count(*) FILTER (WHERE kind = 'step') AS n_steps, count(*) FILTER (WHERE kind = 'request') - 1 AS n_refused FROM f WHERE {'ts': ts, 'id': id} >= begin GROUP BY slot, part, begin)
SELECT slot, job_id, started, CASE WHEN kind IN ('done', 'error') THEN last ELSE last + INTERVAL 86400 SECOND END AS ended, n_steps, n_refused, CASE WHEN kind IN ('done', 'error') THEN kind ELSE 'timed out' END AS status FROM j"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a slot's: a stand-in."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("id"), "ts", kind_of(F.col("event_type")).alias("kind"))


@query(_FLOW)
def job_flow(spark, sf_dir):
    return flow(_events(spark, sf_dir))


@query(_FLOW)
def replayed_job_flow(spark, sf_dir):
    """The events as files of five days, each with a thirteenth of the rows of the five days before, late; the stream is stopped after three
    files and goes on from its checkpoint. A row far ahead ends all jobs."""
    top = new_folder(spark, "stream")
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone; it goes again below
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    day = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) / 86_400_000_000 / 5).cast("int")
    slices = e.withColumn("slice", day + (F.col("id") % 13 == 0).cast("int"))
    last = (high - low).days // 5 + 1
    slices.write.partitionBy("slice").parquet(f"{top}/slices")  # all at once, so that a file's task reads its own rows only
    slices = spark.read.schema(slices.schema).parquet(f"{top}/slices")
    with_timers(spark)

    def run() -> None:
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        out = streamed_job_flow(source, "11 days").writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
        out.trigger(availableNow=True).start().awaitTermination()

    for k in range(last + 1):
        slices.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(f"{top}/in")
        if k == 2:
            run()
    ahead = e.select(F.lit(-1).cast("long").alias("slot"), F.lit(-1).cast("long").alias("id"), (F.lit(high) + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit("step").alias("kind")).limit(1)
    ahead.write.mode("append").parquet(f"{top}/in")
    run()
    out = spark.read.schema(SCHEMA).parquet(f"{top}/out")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
