"""Rows from HTTP sources, with retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers after which a request is tried again.
RETRY = frozenset((429, 500, 502, 503, 504))


def ask(url: str, body: str | None = None, tries: int = 4, first_wait_s: float = 1.0, timeout_s: float = 30.0, sleep=time.sleep) -> tuple[int, str]:
    """(status, text) of a request, a POST of JSON if there is a body; 0 if no answer came.

    Waits double after answers of RETRY and failed connections; other answers end at once.
    """
    status, text = 0, ""
    for nth in range(tries):
        if nth:
            sleep(first_wait_s * 2 ** (nth - 1))
        request = urllib.request.Request(url, body.encode() if body is not None else None, {"Content-Type": "application/json"} if body is not None else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            status, text = e.code, e.read().decode("utf-8", "replace")
            if status not in RETRY:
                break
        except (urllib.error.URLError, TimeoutError) as e:
            status, text = 0, str(e)
    return status, text


def fetch(requests: DataFrame, tries: int = 4, first_wait_s: float = 1.0) -> DataFrame:
    """requests (url, body or null) with status and text. Requests run in the tasks of their partitions, so the number of partitions bounds how many run at once."""

    def run(batches):
        for batch in batches:
            rows = [ask(u, b, tries, first_wait_s) for u, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["url", "body", "status", "text"])

    return requests.select(F.col("url").cast("string"), F.col("body").cast("string")).mapInArrow(run, "url string, body string, status int, text string")


def request_body(**fields) -> str:
    """The JSON of a request, keys in order."""
    return json.dumps(fields, sort_keys=True)
