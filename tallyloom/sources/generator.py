"""Model calls as a table function: requests in, responses out, with a generator that is given."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "request_id string, body string, finish_reason string, prompt_tokens int, completion_tokens int, total_tokens int, attempts int"
#: Bytes of answers that a task gathers before it hands them on.
HELD_BYTES = 4 << 20


def stub(request: str) -> tuple[str, str]:
    """A deterministic answer: a body made from the request's digest alone, so that running a task again repeats it."""
    digest = hashlib.sha256(request.encode()).hexdigest()
    return json.dumps({"complete": True, "omitted_count": 0, "items": [{"title": f"Item {digest[:8]}", "description": f"Derived from request {digest[8:16]}."}]}), "stop"


def generate(requests: DataFrame, call: Callable[[str], tuple[str, str]] = stub, retries: int = 2, parallel: int | None = None) -> DataFrame:
    """A response for each request (request_id, request). The number of partitions bounds the calls in flight; an
    error is tried again `retries` times and then fails the task. Keep the result before using it twice, or a
    generator that costs money is asked again."""

    names, kinds = [c.split()[0] for c in RESPONSE.split(", ")], [pa.string()] * 3 + [pa.int32()] * 4

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, text in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):  # a request may be large
                for attempt in range(1, retries + 2):
                    try:
                        body, reason = call(text)
                        break
                    except (ConnectionError, TimeoutError):
                        if attempt > retries:
                            raise
                asked, said = len(text.encode()) // 4 + 1, len(body.encode()) // 4 + 1
                rows.append((key, body, reason, asked, said, asked + said, attempt))
                held += len(body)
                if held >= HELD_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    src = requests.select("request_id", "request")
    return (src.repartition(parallel) if parallel else src).mapInArrow(run, RESPONSE)


def repaired(requests: DataFrame, valid, call: Callable[[str], tuple[str, str]] = stub, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Responses with `ok`: those that `valid` (a column of body) refuses are asked for once more, with what was wrong."""
    first = keep(generate(requests, call)).withColumn("ok", valid(F.col("body")))
    again = requests.join(first.where("not ok").select("request_id", "body"), "request_id").select("request_id", F.concat("request", F.lit("\nInvalid answer: "), "body").alias("request"))
    second = keep(generate(again, call)).withColumn("ok", valid(F.col("body")))
    return first.where("ok").unionByName(second)
