"""Jobs under load: a slot runs one job at a time; requests meanwhile are refused, and a job that nothing is heard of ends by itself.

``job_flow`` says it of a table, by windows; ``streamed_job_flow`` of a stream, with state and timers in event time, where rows may
come late and in any order within the watermark's delay. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMEOUT = 86_400  # seconds without an event of its slot after which a job ends
SCHEMA = "slot long, job_id long, started timestamp, ended timestamp, n_steps long, n_refused long, status string"
ENDS = ("done", "error")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_flow(events: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """The jobs of events (slot, id, ts, kind), one row each; the status is done, error or timed out.

    A `request` begins a job (named by the event's id) if the slot is free; `step`s are counted, further requests refused. `done`
    or `error` ends it, and so does a silence of its slot longer than the timeout, at the time when that is over. What is said
    of no job counts for nothing. Events of one time are in the order of their ids.
    """
    w = Window.partitionBy("slot").orderBy("ts", "id")
    silent = F.col("ts") > F.lag("ts").over(w) + F.make_interval(secs=F.lit(timeout))
    parted = F.coalesce(silent | F.lag("kind").over(w).isin(*ENDS), F.lit(False))
    e = events.withColumn("part", F.sum(parted.cast("int")).over(w))
    at = F.struct("ts", "id")
    begin = F.min(F.when(F.col("kind") == "request", at)).over(Window.partitionBy("slot", "part"))
    e = e.withColumn("begin", begin).where(at >= F.col("begin"))
    last = F.max(F.struct("ts", "id", "kind")).alias("last")
    jobs = e.groupBy("slot", "part", "begin").agg(last, F.count_if(F.col("kind") == "step").alias("n_steps"), (F.count_if(F.col("kind") == "request") - 1).alias("n_refused"))
    over = F.col("last.kind").isin(*ENDS)
    ended = F.when(over, F.col("last.ts")).otherwise(F.col("last.ts") + F.make_interval(secs=F.lit(timeout)))
    return jobs.select("slot", F.col("begin.id").alias("job_id"), F.col("begin.ts").alias("started"), ended.alias("ended"), "n_steps", "n_refused", F.when(over, F.col("last.kind")).otherwise("timed out").alias("status"))


def _micros(t: datetime) -> int:
    t = t.astimezone(timezone.utc) if t.tzinfo is None else t
    return (t - _EPOCH) // timedelta(microseconds=1)


def _time(micros: int) -> datetime:
    return (_EPOCH + timedelta(microseconds=micros)).astimezone().replace(tzinfo=None)


class JobFlow(StatefulProcessor):
    """Of each slot: what has come but may still be preceded, the running job, and the one timer that is set."""

    def __init__(self, timeout: int):
        self.timeout = timeout * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each call is a round trip: what waits, the time of the timer, and the job
        self.slot = handle.getValueState("slot", "waiting array<struct<ts: long, id: long, kind: string>>, alarm long, job struct<id: long, started: long, heard: long, steps: long, refused: long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(_micros(r["ts"]), r["id"], r["kind"]) for r in rows]
        waiting, alarm, job = self.slot.get() or ((), None, None)
        alarm = self._set(min(r[0] for r in fresh), alarm)
        self.slot.update(([*map(tuple, waiting), *fresh], alarm, job and tuple(job)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # nothing of this time or before comes any more
        waiting, _, job = self.slot.get() or ((), None, None)
        rows, job, out = sorted(map(tuple, waiting)), job and list(job), []
        due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        for at, id_, kind in due:
            if job and at > job[2] + self.timeout:
                out.append(self._ended(key, job, job[2] + self.timeout, "timed out"))
                job = None
            if job is None:
                job = [id_, at, at, 0, 0] if kind == "request" else None
                continue
            job[2] = at
            if kind in ENDS:
                out.append(self._ended(key, job, at, kind))
                job = None
            else:
                job[3] += kind == "step"
                job[4] += kind == "request"
        if job and job[2] + self.timeout <= now:
            out.append(self._ended(key, job, job[2] + self.timeout, "timed out"))
            job = None
        if rest or job:
            alarm = self._set(min([r[0] for r in rest] + ([job[2] + self.timeout] if job else [])), None)
            self.slot.update((rest, alarm, job and tuple(job)))
        else:
            self.slot.clear()
        return iter(out)

    def _set(self, at: int, have: int | None) -> int:
        """The time of the timer that is set: this, or the one that is, if that is before."""
        at = -(-at // 1000)
        if have is not None and have <= at:
            return have
        if have is not None:
            self.handle.deleteTimer(have)
        self.handle.registerTimer(at)
        return at

    @staticmethod
    def _ended(key, job: list, at: int, status: str) -> Row:
        return Row(slot=key[0], job_id=job[0], started=_time(job[1]), ended=_time(at), n_steps=job[3], n_refused=job[4], status=status)

    def close(self) -> None:
        pass


def streamed_job_flow(events: DataFrame, delay: str, timeout: int = TIMEOUT) -> DataFrame:
    """The same of a stream, each job once, as soon as the watermark has passed its end; events later than the delay are left out. The
    session's state store has to be one that holds timers (``with_timers``)."""
    rows = events.select("slot", "id", "ts", "kind").withWatermark("ts", delay)
    return rows.groupBy("slot").transformWithState(JobFlow(timeout), SCHEMA, "Append", "EventTime")


def with_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def kind_of(event_type: Column) -> Column:
    """A stand-in: what a shop's events are as a job's."""
    return F.when(event_type == "signup", "request").when(event_type == "purchase", "done").when(event_type == "error", "error").otherwise("step")
