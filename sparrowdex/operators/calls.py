"""Calls of model endpoints from tasks: several at a time, results in order, tried again, failures told."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched
from typing import Any

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import Embedder

#: Fixed value: the longest wait between two tries, in seconds.
LONGEST_WAIT = 10.0


def attempted(call: Callable, part: Any, *, tries: int = 3, wait: float = 0.5, passing: Callable[[Exception], bool] = lambda e: True) -> tuple[Any, Exception | None]:
    """(value, error) of a call that is tried again, after doubled waits, while its errors are such as pass."""
    for n in range(tries):
        try:
            return call(part), None
        except Exception as e:  # noqa: BLE001 - told to the caller
            if n + 1 >= tries or not passing(e):
                return None, e
            time.sleep(min(wait * 2**n, LONGEST_WAIT))
    return None, ValueError("no try was allowed")


def in_order(parts: Iterable, call: Callable, *, concurrent: int = 3, delay: float = 0.0, **options) -> Iterator[tuple[Any, Any, Exception | None]]:
    """(part, value, error) in the order of the parts. ``concurrent`` calls at most are under way or not taken yet; ``delay`` seconds lie between their starts."""
    if concurrent < 1:
        raise ValueError("one call at a time at least")
    with ThreadPoolExecutor(concurrent) as pool:
        held: deque = deque()
        for n, p in enumerate(parts):
            if len(held) == concurrent:
                q, f = held.popleft()
                yield q, *f.result()
            if n and delay:
                time.sleep(delay)
            held.append((p, pool.submit(attempted, call, p, **options)))
        while held:
            q, f = held.popleft()
            yield q, *f.result()


def embedded(rows: DataFrame, text: str, embedder: Embedder, *, batch: int = 128, concurrent: int = 3, done: Accumulator | None = None, failed: Accumulator | None = None, **options) -> DataFrame:
    """Adds embedding and embedding_error to rows; one of them is null.

    Texts go to the endpoint in batches, several at a time. Of a batch that fails each text is asked for by itself, so one bad text fails alone. A vector that is
    missing, of another length or not finite is an error; a null text counts as empty. ``done`` and ``failed`` are accumulators of finished tasks' texts, which
    the driver can read while others run; a task that runs again counts again.
    """

    def checked(v) -> tuple[list | None, str | None]:
        if v is None or len(v) != embedder.dimension:
            return None, f"a vector of {0 if v is None else len(v)}, not {embedder.dimension}"
        return (list(v), None) if all(x is not None and math.isfinite(x) for x in v) else (None, "a vector that isn't finite")

    def whole(texts: tuple) -> list:
        found = embedder.embed(list(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in columns:
            out = []
            for texts, found, error in in_order(batched(column.fillna("").tolist(), batch), whole, concurrent=concurrent, **options):
                if error is None:
                    out += map(checked, found)
                elif len(texts) == 1:
                    out.append((None, str(error) or type(error).__name__))
                else:
                    single = in_order(((t,) for t in texts), whole, concurrent=concurrent, **options | {"tries": 1})
                    out += [checked(f[0]) if e is None else (None, str(e) or type(e).__name__) for _, f, e in single]
            bad = sum(e is not None for _, e in out)
            if done is not None:
                done.add(len(out) - bad)
            if failed is not None:
                failed.add(bad)
            yield pd.DataFrame(out, columns=["embedding", "embedding_error"])

    made = F.pandas_udf(run, "embedding array<float>, embedding_error string")
    rest = rows.drop("embedding", "embedding_error")
    return rest.withColumn("_made", made(F.col(text))).select(*(F.col(f"`{c}`") for c in rest.columns), "_made.*")
