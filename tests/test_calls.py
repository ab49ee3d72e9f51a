"""Calls of endpoints: order, bound, tries, delay, failures of single texts, progress."""

import threading
import time

import pytest

from sparrowdex.models import HashEmbedder
from sparrowdex.operators import calls


def test_order_bound_and_tries():
    lock, now, most, seen = threading.Lock(), [0], [0], {}

    def call(n):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            seen[n] = seen.get(n, 0) + 1
        time.sleep(0.03 if n % 3 else 0.06)
        with lock:
            now[0] -= 1
        if n == 5 or (n == 7 and seen[n] < 3):
            raise OSError(f"no {n}")
        return n * 10

    out = list(calls.in_order(range(12), call, concurrent=4, tries=3, wait=0.0))
    assert [p for p, _, _ in out] == list(range(12)) and 2 <= most[0] <= 4
    assert [v for _, v, _ in out] == [None if n == 5 else n * 10 for n in range(12)] and str(out[5][2]) == "no 5"
    assert seen[5] == 3 and seen[7] == 3 and seen[0] == 1
    seen.clear()
    assert calls.attempted(call, 5, tries=3, wait=0.0, passing=lambda e: False)[1] is not None and seen[5] == 1
    assert list(calls.in_order([], call)) == []
    start = time.monotonic()
    list(calls.in_order(range(3), lambda n: n, delay=0.05))
    assert time.monotonic() - start >= 0.1
    with pytest.raises(ValueError):
        list(calls.in_order([1], call, concurrent=0))


def test_parts_are_taken_as_they_are_needed():
    taken = []

    def parts():
        for n in range(100):
            taken.append(n)
            yield n

    run = calls.in_order(parts(), lambda n: n, concurrent=3)
    assert next(run)[1] == 0 and len(taken) <= 4
    run.close()


class Picky(HashEmbedder):
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise OSError("refused")
        return [[float("nan")] * 8 if t == "nan" else [0.5] * 3 if t == "short" else v for t, v in zip(texts, super().embed(texts), strict=True)]


def test_one_bad_text_fails_alone(spark):
    texts = ["one", "bad one", None, "short", "nan", "six", *["plain"] * 30]
    rows = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "id int, t string, embedding string").repartition(3)
    done, failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    out = {r["id"]: r for r in calls.embedded(rows, "t", Picky(8), batch=4, tries=2, wait=0.0, done=done, failed=failed).collect()}
    errors = {i: r["embedding_error"] for i, r in out.items() if r["embedding_error"]}
    assert errors == {1: "refused", 3: "a vector of 3, not 8", 4: "a vector that isn't finite"} and len(out) == len(texts)
    assert all((r["embedding"] is None) == (i in errors) for i, r in out.items()) and done.value == len(texts) - 3 and failed.value == 3
    assert [round(x, 5) for x in out[0]["embedding"]] == [round(x, 5) for x in Picky(8).embed(["one"])[0]]
    assert calls.embedded(rows.limit(0), "t", Picky(8)).count() == 0
