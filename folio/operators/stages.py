"""Stages that run outside the engine (renderers, recognition, parsers) as pluggable steps over rows.

A stage is a function of one row's inputs; what it calls is the user's. The engine deals the rows out, keeps each row's outcome
and never fails a job because of one row.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Runner = Callable[[Sequence[str], float], tuple[int, bytes, str]]


@dataclass(frozen=True)
class Stage:
    """A named step: `call` takes a row's inputs by name and gives the output's bytes, or raises with a message."""

    name: str
    inputs: tuple[str, ...]
    call: Callable[..., bytes | None]


def run_command(argv: Sequence[str], timeout: float) -> tuple[int, bytes, str]:
    """Exit code, output and messages of a command; 124 if its time is up."""
    try:
        done = subprocess.run(list(argv), capture_output=True, timeout=timeout, check=False)
        return done.returncode, done.stdout, done.stderr.decode("utf-8", "replace")
    except subprocess.TimeoutExpired:
        return 124, b"", "timeout"
    except OSError as e:
        return 127, b"", f"not found: {e}"


def command_stage(name: str, argv: str = "argv", timeout: str = "timeout", runner: Runner = run_command) -> Stage:
    """A stage that runs each row's command line (array column argv) within its time (column timeout, seconds)."""

    def call(**row) -> bytes:
        code, output, said = runner([str(a) for a in row[argv]], float(row[timeout]))
        if code:
            raise RuntimeError(said.strip() or f"exit code {code}")
        return output

    return Stage(name, (argv, timeout), call)


def apply_stage(df: DataFrame, stage: Stage, key: str = "doc_id", retries: int = 0, final: Callable[[str], bool] = lambda message: False, wait: Callable[[int], float] = lambda attempt: 0.0) -> DataFrame:
    """(key, stage, ok, attempts, message, output) of each row. An error is tried again unless `final` says that no retry mends it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for attempt in range(1, retries + 2):
                    try:
                        got = (True, attempt, "", stage.call(**{c: row[c] for c in stage.inputs}))
                        break
                    except Exception as e:  # noqa: BLE001  # a stage's errors are its rows' outcomes
                        got = (False, attempt, str(e), None)
                        if final(str(e)) or attempt > retries:
                            break
                        time.sleep(wait(attempt))
                out.append((row[key], stage.name, *got))
            yield pd.DataFrame(out, columns=["key", "stage", "ok", "attempts", "message", "output"])

    kind = dict(df.dtypes)[key]
    return df.select(key, *stage.inputs).mapInPandas(run, f"key {kind}, stage string, ok boolean, attempts int, message string, output binary").withColumnRenamed("key", key)
