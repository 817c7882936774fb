"""Lookups and downloads over a network, off unless a caller passes a way to fetch.

A fetch is a function from an address to an Answer; ``http`` makes one.  Addresses are asked once each, in as many tasks
as the caller allows, with a pause after each request.  What fails is unknown, never absent.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds that a request may take, and between two requests of a task.
TIMEOUT, PAUSE = 20.0, 0.15
RATE_LIMITED = "rate limit"


@dataclass(frozen=True)
class Answer:
    """status is null where no answer came; error then says why."""

    status: int | None
    body: str = ""
    error: str | None = None


Fetch = Callable[[str], Answer]


def http(token: str = "", accept: str = "application/json", timeout: float = TIMEOUT) -> Fetch:
    """A fetch by GET.  An exhausted rate limit is told apart from other refusals by the host's header."""

    def fetch(address: str) -> Answer:
        headers = {"Accept": accept, "User-Agent": "verdictflow"} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=timeout) as answer:
                return Answer(answer.status, answer.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            spent = e.code in (403, 429) and (e.headers or {}).get("X-RateLimit-Remaining") == "0"
            return Answer(e.code, error=RATE_LIMITED if spent else None)
        except OSError as e:
            return Answer(None, error=f"{type(e).__name__}: {e}"[:500])

    return fetch


def ask(addresses: DataFrame, fetch: Fetch, tasks: int = 1, pause: float = PAUSE) -> DataFrame:
    """addresses (key, address) to key, status, body, error; each distinct row is one request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, address in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = fetch(address)
                time.sleep(pause)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([a.status], pa.int32()), pa.array([a.body], pa.string()), pa.array([a.error], pa.string())], ["key", "status", "body", "error"])

    return addresses.select("key", "address").distinct().repartition(tasks, "key").mapInArrow(run, "key string, status int, body string, error string")


def registry(names: DataFrame, base: str, fetch: Fetch, checked: str, tasks: int = 1, pause: float = PAUSE) -> DataFrame:
    """names (norm) to registry rows name, status, exists, checked.  Only 200 is there and only 404 is absent."""
    found = ask(names.select(F.col("norm").alias("key"), F.concat(F.lit(base.rstrip("/") + "/"), "norm", F.lit("/json")).alias("address")), fetch, tasks, pause)
    exists = F.when(F.col("status") == 200, True).when(F.col("status") == 404, False)
    return found.select(F.col("key").alias("name"), "status", exists.alias("exists"), F.lit(checked).alias("checked"))


def diffs(cases: DataFrame, fetch: Fetch, tasks: int = 1, pause: float = PAUSE) -> DataFrame:
    """cases (case_id, address) to case_id, diff, error: a diff that can't be had is a null one, not a failed job."""
    found = ask(cases.select(F.col("case_id").alias("key"), "address"), fetch, tasks, pause)
    had = F.col("status") == 200
    return found.select(F.col("key").alias("case_id"), F.when(had, F.col("body")).alias("diff"), F.when(~F.coalesce(had, F.lit(False)), F.coalesce("error", F.concat(F.lit("status "), F.col("status").cast("string")))).alias("error"))
