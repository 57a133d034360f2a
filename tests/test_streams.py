import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folio.streaming.jobs import ENDS, SCHEMA, JobFlow, job_flow, streamed_job_flow, with_timers

BEGIN = datetime(2024, 1, 1)
EVENTS = "slot long, id long, ts timestamp, kind string"


def jobs(events, timeout):
    """By a loop over each slot's events in order."""
    out = []
    for slot in {e[0] for e in events}:
        job = None
        for _, id_, at, kind in sorted((e for e in events if e[0] == slot), key=lambda e: (e[2], e[1])):
            if job and at > job["heard"] + timedelta(seconds=timeout):
                out.append((slot, job["id"], job["begin"], job["heard"] + timedelta(seconds=timeout), job["steps"], job["refused"], "timed out"))
                job = None
            if job is None:
                if kind == "request":
                    job = {"id": id_, "begin": at, "heard": at, "steps": 0, "refused": 0}
                continue
            job["heard"] = at
            job["steps"] += kind == "step"
            job["refused"] += kind == "request"
            if kind in ENDS:
                out.append((slot, job["id"], job["begin"], at, job["steps"], job["refused"], kind))
                job = None
        if job:
            out.append((slot, job["id"], job["begin"], job["heard"] + timedelta(seconds=timeout), job["steps"], job["refused"], "timed out"))
    return sorted(out)


def some_events(seed, n=300, slots=4):
    r = random.Random(seed)
    at, out = BEGIN, []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 5, 30]), microseconds=r.randrange(0, 3) * 333)
        out.append((r.randrange(slots), i, at, r.choices(["request", "step", "done", "error"], [3, 4, 1, 1])[0]))
    return out


@pytest.mark.parametrize("seed,timeout", [(1, 10), (2, 60), (3, 100_000)])
def test_job_flow(spark, seed, timeout):
    events = some_events(seed)
    assert sorted(map(tuple, job_flow(spark.createDataFrame(events, EVENTS).repartition(3), timeout).collect())) == jobs(events, timeout)


def test_no_jobs(spark):
    assert job_flow(spark.createDataFrame([], EVENTS)).collect() == job_flow(spark.createDataFrame([(1, 1, BEGIN, "step"), (1, 2, BEGIN, "done")], EVENTS)).collect() == []


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    """Files out of order by less than the delay, a restart in between, one row that comes after the delay, and timers at the end."""
    events = some_events(5, 240, 3)
    span = (events[-1][2] - BEGIN).total_seconds()
    part = lambda e: int((e[2] - BEGIN).total_seconds() / span * 3.999) + (e[1] % 7 == 0)
    with_timers(spark)

    def run():
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = streamed_job_flow(source, f"{int(span / 2)} seconds", 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()))

    def send(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for k in range(3):
        send([e for e in events if part(e) == k])
    before = run()
    for k in range(3, 5):
        send([e for e in events if part(e) == k])
    send([(9, 1000, events[-1][2] + timedelta(days=1), "step")])
    send([(0, 1001, BEGIN, "request"), (9, 1002, events[-1][2] + timedelta(days=1), "step")])  # far too late
    got = run()
    assert got == jobs(events, 60)
    assert set(before) < set(got) and len(got) > 20


def test_a_slot_takes_few_calls_of_the_state():
    """Each call is a round trip to the engine: rows that come take a look and a write, a timer too, however much there is."""
    calls, value = [], [None]

    class State:
        def get(self):
            calls.append("get")
            return value[0]

        def update(self, new):
            calls.append("update")
            value[0] = new

        def clear(self):
            calls.append("clear")
            value[0] = None

    class Handle:
        def getValueState(self, *args):
            return State()

        getListState = getValueState

        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    p = JobFlow(60)
    p.init(Handle())
    zone = timezone.utc
    rows = [{"ts": datetime(1970, 1, 1, 0, 0, s, tzinfo=zone), "id": s, "kind": "request" if s == 5 else "step"} for s in (9, 5, 7, 30)]
    assert list(p.handleInputRows((3,), iter(rows), Now(0))) == [] and calls == ["get", "register", "update"]
    calls.clear()
    assert list(p.handleExpiredTimer((3,), Now(20_000), None)) == [] and calls == ["get", "register", "update"]
    calls.clear()
    out = list(p.handleExpiredTimer((3,), Now(100_000), None))
    assert calls == ["get", "clear"] and [(r["job_id"], r["n_steps"], r["n_refused"], r["status"]) for r in out] == [(5, 3, 0, "timed out")]
