"""Arms at the same time, statistics by stage, and figures by anchor, reranker and judge."""

import time

import pytest

from sparrowdex.models import HashEmbedder, OverlapReranker
from sparrowdex.operators import retrieval

E = HashEmbedder(16)
CHUNKS = "chunk_id string, document_id string, chunk_index int, content string, chunk_type string, section string, asset_key string, anchor_chunk_index int, embedding array<float>"


@pytest.fixture(scope="module")
def tables(spark):
    texts = [("d1", 0, "the ship leaves harbour"), ("d1", 1, "cargo of grain and salt"), ("d2", 0, "mountain huts open in june"), ("d3", 0, "secret harbour ship")]
    rows = [(f"{d}_{i}", d, i, t, "prose", None, None, None) for d, i, t in texts]
    rows += [
        ("d1_2", "d1", 2, "[image] ", "figure", "", "a/anchored.png", 0),
        ("d1_3", "d1", 3, "[image] Gambar 1 harbour crane", "figure", "Gambar 1 harbour crane", "a/crane.png", None),
        ("d1_4", "d1", 4, "[image] Gambar 2 ship lantern", "figure", "Gambar 2 ship lantern", "a/ship.png", None),
        ("d2_1", "d2", 1, "[image] Gambar 9 harbour", "figure", "Gambar 9 harbour hut", "b/hut.png", None),
    ]
    # figures have no vector near the query, so they come in by their rules alone
    rows = [(*r, E.embed([r[3] if r[4] == "prose" else "zzz"])[0]) for r in rows]
    chunks = spark.createDataFrame(rows, CHUNKS)
    docs = spark.createDataFrame([("d1", "Ports", ["x"]), ("d2", "Hills", [])], "document_id string, title string, categories array<string>")
    entities = spark.createDataFrame([("e1", "d1", "Place", "harbour", 0.9), ("e2", "d3", "Place", "harbour", 0.9)], "entity_id string, document_id string, type string, name string, confidence double")
    return chunks, docs, entities


def test_statistics_and_walls(spark, tables):
    chunks, docs, _ = tables
    r = retrieval.retrieve(chunks, docs, "harbour ship", embedder=E, max_chunks=3, minimum=0.1)
    hits = r.hits.collect()
    assert {"d3"} & {h["document_id"] for h in hits} == set() and hits[0]["chunk_id"] == "d1_0" and "[1] Ports" in r.context.head()[0]
    assert r.stats["vector"]["rows"] >= 1 and r.stats["bm25"]["rows"] >= 1 and r.stats["fusion"]["rows"] == len(hits) and r.stats["forms"] == 1
    assert "bm25" not in retrieval.retrieve(chunks, docs, "harbour", embedder=E, bm25=False).stats
    none = retrieval.retrieve(chunks, docs.limit(0), "harbour", embedder=E)
    assert none.hits.count() == 0 and none.context.head()[0] == "" and none.stats["vector"]["rows"] == 0
    shut = retrieval.retrieve(chunks, docs, "zzzz", embedder=E, max_chunks=2, minimum=0.99, expander=lambda p: '["harbour ship leaves the", "grain"]')
    assert shut.stats["forms"] == 3


def test_arms_run_together():
    start = time.monotonic()
    out = retrieval._together(lambda: time.sleep(0.2) or [1], lambda: time.sleep(0.2) or [2])
    assert out == [[1], [2]] and time.monotonic() - start < 0.35
    with pytest.raises(ZeroDivisionError):
        retrieval._together(lambda: [1 / 0], lambda: [])


def keys(result):
    return [h["asset_key"] for h in result.hits.collect() if h["asset_key"]]


def test_hybrid_figures(spark, tables):
    chunks, docs, entities = tables
    figures = chunks.filter("chunk_type = 'figure'")
    texts = chunks.filter("chunk_type = 'prose'")
    run = lambda **o: retrieval.hybrid(texts, docs, entities, "harbour crane", embedder=E, max_chunks=1, window=0, top=3, figures=figures, **o)
    plain = run()
    hits = plain.hits.collect()
    assert {h["document_id"] for h in hits} == {"d1"} and hits[0]["entities"][0]["name"] == "harbour"
    # anchored first, then the caption's word in the query, then in the text; other documents' figures stay out
    assert keys(plain) == ["a/anchored.png", "a/crane.png", "a/ship.png"] and keys(run(figure_limit=1)) == ["a/anchored.png"] and keys(run(figure_limit=0)) == []
    assert [h["place"] for h in hits] == list(range(1, len(hits) + 1)) and all(h["source_no"] for h in hits)
    assert {"vector", "entities", "fusion", "neighbours", "figures"} <= set(plain.stats) and plain.stats["figures"]["rows"] == 3
    # a reranker orders by captions; those under the floor go
    assert keys(run(reranker=OverlapReranker())) == ["a/crane.png"]
    assert keys(run(reranker=OverlapReranker(), figure_floor=0.0))[0] == "a/crane.png"

    class Broken:
        def rerank(self, *a):
            raise OSError

    assert keys(run(reranker=Broken())) == keys(plain)
    seen = []
    judge = lambda q, c: seen.append((q, c["asset_key"])) or ("YA" if "crane" in c["asset_key"] else "TIDAK")
    assert keys(run(judge=judge)) == ["a/crane.png"] and sorted(seen) == [("harbour crane", "a/anchored.png"), ("harbour crane", "a/crane.png")]
    assert keys(run(judge=lambda q, c: 1 / 0)) == []


def test_hybrid_without_hits(spark, tables):
    chunks, docs, entities = tables
    r = retrieval.hybrid(chunks, docs.limit(0), entities, "harbour", embedder=E, figures=chunks.filter("chunk_type = 'figure'"))
    assert r.hits.count() == 0 and r.stats["vector"]["rows"] == 0
