"""Settings, registries, model-backed extraction with stand-ins, and functions for SQL."""

import json

import pytest

from sparrowdex.config import DEFAULTS, Registry, Settings
from sparrowdex.functions.register import register
from sparrowdex.operators import model_extract


def test_settings():
    now = [0.0]
    stored = {"KB_RERANK_ENABLED": "true", "KB_CHUNK_SIZE": " ", "KB_EMBEDDING_DIM": "7"}
    s = Settings(lambda: stored, {"KB_CHUNK_SIZE": "500", "KB_BM25_ENABLED": "no", "KB_EMBEDDING_DIM": "12x"}, clock=lambda: now[0])
    assert s.get("KB_RERANK_ENABLED") is True and s.get("KB_CHUNK_SIZE") == 500 and s.get("KB_BM25_ENABLED") is True
    with pytest.raises(ValueError):
        s.get("KB_EMBEDDING_DIM")
    stored["KB_RERANK_ENABLED"] = "1"
    assert s.get("KB_RERANK_ENABLED") is True
    now[0] = 61
    assert s.get("KB_RERANK_ENABLED") is False and Settings(env={}).get("KB_RERANK_INITIAL_K") == DEFAULTS["KB_RERANK_INITIAL_K"] == 20
    assert Settings(env={"KB_BM25_ENABLED": "false"}).get("KB_BM25_ENABLED") is False


def test_registry():
    r = Registry(one=lambda: 1)
    r.add("two", lambda: 2)
    assert (r.make("one"), r.make("two"), r.make(None), r.make("off")) == (1, 2, None, None)
    with pytest.raises(KeyError):
        r.make("three")
    with pytest.raises(ValueError):
        r.make("two", within="two")


class Echo:
    """Answers with what follows its mark in the prompt; fails without one."""

    def __call__(self, prompt):
        return prompt.split("@@", 1)[1]


def test_model_extraction(spark):
    answer = json.dumps({"entities": [{"name": "Acme", "type": "Org"}, {"name": "acme ", "type": "Org", "confidence": 0.95}, {"name": "Bob", "type": "Person"}], "relations": [{"source": "bob", "target": "ACME", "type": "WORKS_FOR"}, {"source": "bob", "target": "Nobody", "type": "KNOWS"}]})
    docs = spark.createDataFrame([(1, "text a@b.org @@" + answer), (2, "no mark"), (3, "x @@" + answer[:60])], "doc_id long, text string")
    entities, relations = model_extract.combined(docs, Echo())
    got = {(r["doc_id"], r["name"]): r["confidence"] for r in entities.collect()}
    assert got[(1, "Acme")] == 0.95 and (1, "Bob") in got and not any(k[0] == 2 for k in got)
    assert [(r["source"], r["rel_type"], r["target"]) for r in relations.filter("doc_id = 1").collect()] == [("Bob", "WORKS_FOR", "Acme")]
    both = {(r["type"], r["name"]) for r in model_extract.hybrid_entities(docs.filter("doc_id = 1"), Echo()).collect()}
    assert ("Email", "a@b.org") in both and ("Person", "Bob") in both
    grid = model_extract.relation_grid(docs.filter("doc_id = 1"), entities)
    assert grid.count() == 1 and sorted(grid.head()["names"]) == ["Acme", "Bob"]
    assert model_extract.model_relations(docs.filter("doc_id = 1"), entities, Echo()).count() == 2
    assert "Acme (Org)" in model_extract.rendered(entities).head()[0]


def test_registered(spark):
    names = register(spark)
    assert len(names) == 6
    assert spark.sql("SELECT kb_stem('running'), kb_strip_html('<p>a<script>x</script></p>')").head()[:] == ("run", "a")
    rows = spark.sql("SELECT c.* FROM VALUES ('# H\n\nbody text') AS t(x), LATERAL kb_chunks(t.x, 800, 200) c").collect()
    assert rows[0]["section"] == "H"
    assert spark.sql("SELECT count(*) FROM VALUES ('a ![x](i.png)') AS t(x), LATERAL kb_blocks(t.x, 1) b").head()[0] == 2
