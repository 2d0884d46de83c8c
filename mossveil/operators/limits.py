"""Rolling-window rate limiting over a table of requests."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def admit(seen: deque, now: float, limit: int, window: float) -> tuple[bool, int]:
    """Whether a request passes and, if not, the seconds to wait. Denied requests leave no trace in ``seen``."""
    while seen and seen[0] <= now - window:
        seen.popleft()
    if len(seen) < limit:
        seen.append(now)
        return True, 0
    return False, max(1, math.ceil(seen[0] + window - now))


def rate_limit(requests: DataFrame, limit: int = 60, window: float = 60.0) -> DataFrame:
    """``client, at, allowed, retry_after`` for each request (``client`` string, ``at`` seconds), in order of time.

    A denial depends on the ones before, so no window function expresses it. A client's requests are streamed in
    order through one task, which holds ``limit`` times at most, however many requests there are. Null clients are
    one client; requests without a time are denied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, seen = object(), deque()
        for batch in batches:
            allowed, wait = [], []
            for c, at in zip(batch.column("client").to_pylist(), batch.column("at").to_pylist()):
                if c != client:
                    client, seen = c, deque()
                ok, after = admit(seen, at, limit, window) if at is not None else (False, 0)
                allowed.append(ok), wait.append(after)
            yield pa.RecordBatch.from_arrays([batch.column("client"), batch.column("at"), pa.array(allowed), pa.array(wait, pa.int32())], ["client", "at", "allowed", "retry_after"])

    ordered = requests.select("client", "at").repartition("client").sortWithinPartitions("client", "at")
    return ordered.mapInArrow(run, "client string, at double, allowed boolean, retry_after int")
