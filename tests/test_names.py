"""Names in texts against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import fusion, names

NAMES = ["Rome", "rome", "om", "the city of Rome", "É", "", None, "a.b", "city of", "x" * 300]
TEXTS = ["I saw ROME", "the City of rome", None, "", "é", "aab", "a.b.a.b", "x" * 5000, "nothing", "Home"]


def sample(spark, seed):
    rng = random.Random(seed)
    named = [(i, rng.choice(NAMES), rng.choice(["d1", "d1", "d2", None])) for i in range(40)] + [(0, "Rome", "d1")] * 2
    texts = [(i, rng.choice(TEXTS), rng.choice(["d1", "d1", "d1", "d3", None])) for i in range(60)] + [(0, "Rome", "d1")] * 2
    return named, texts, spark.createDataFrame(named, "nid long, name string, ndoc string"), spark.createDataFrame(texts, "tid long, text string, doc string").withColumn("low", F.lit(1))


def holds(text, name):
    return text is not None and name is not None and name.lower() in text.lower()


@pytest.mark.parametrize("travel", [True, False])
def test_names_in_text(spark, travel, monkeypatch):
    if not travel:
        for c, v in (("TRAVEL_BYTES", 0), ("BLOCK_NAMES", 3), ("GROUP_TEXTS", 7)):
            monkeypatch.setattr(names, c, v)
    named, texts, n, t = sample(spark, 1)
    got = sorted((r["nid"], r["tid"]) for r in names.names_in_text(n, t).collect())
    assert got == sorted((a, b) for a, x, _ in named for b, y, _ in texts if holds(y, x))
    assert names.names_in_text(n.limit(0), t).count() == 0 == names.names_in_text(n, t.limit(0)).count()


def test_names_in_own_text(spark, monkeypatch):
    for c, v in (("BLOCK_NAMES", 3), ("GROUP_TEXTS", 7)):
        monkeypatch.setattr(names, c, v)
    named, texts, n, t = sample(spark, 2)
    got = sorted((r["nid"], r["tid"]) for r in names.names_in_own_text(n.withColumnRenamed("ndoc", "doc"), t, key="doc").collect())
    assert got == sorted((a, b) for a, x, d in named for b, y, e in texts if d is not None and d == e and holds(y, x))


def test_places_by_query(spark):
    chunks = spark.createDataFrame([(q, i, f"t{i}") for q in ("a", "b") for i in range(6)], "document_id string, chunk_index int, text string")
    anchors = spark.createDataFrame([("q1", "a", 2, 1), ("q1", "b", 0, 2), ("q2", "a", 2, 1)], "q string, document_id string, chunk_index int, rank int")
    rows = fusion.neighbours(anchors, chunks, 1, by=("q",)).orderBy("q", "place").collect()
    assert [(r["q"], r["document_id"], r["chunk_index"], r["place"]) for r in rows] == [("q1", "a", 1, 1), ("q1", "a", 2, 2), ("q1", "a", 3, 3), ("q1", "b", 0, 4), ("q1", "b", 1, 5), ("q2", "a", 1, 1), ("q2", "a", 2, 2), ("q2", "a", 3, 3)]


def test_names_of_their_own_text_move_no_text(spark):
    from unittest import mock

    held = spark.createDataFrame([(i % 3 if i else None, i, f"Text of Ann Lee {i} and BOB ") for i in range(40)], "k long, i long, text string")
    sought = spark.createDataFrame([(0, "ann lee"), (1, "Bob"), (1, ""), (2, "nobody"), (2, None), (None, "ann lee")], "k long, name string")
    rows = lambda: sorted((r["i"], r["name"]) for r in names.names_in_own_text(sought, held, key="k").collect())
    want = sorted([(i, "ann lee") for i in range(3, 40, 3)] + [(i, n) for i in range(1, 40, 3) for n in ("Bob", "")])
    with mock.patch.object(names, "_grouped", side_effect=AssertionError):
        assert rows() == want
    with mock.patch.object(names, "TRAVEL_BYTES", 0):
        assert rows() == want
