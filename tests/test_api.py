"""A knowledge base from upload to search, and the walls between tenants."""

import pytest
from pyspark.sql import functions as F

from sparrowdex.api import Key, KnowledgeBase, Tables, hash_key, mint_key
from sparrowdex.sources import files


def upload(spark, tmp_path, name, text):
    d = tmp_path / name.replace(".", "_")
    d.mkdir()
    (d / name).write_text(text)
    return files.scan_directory(spark, f"file://{d}")


def test_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    mine, theirs = KnowledgeBase(spark, root, Key("t1")), KnowledgeBase(spark, root, Key("t2"))
    kb = mine.create_kb("travel")
    with pytest.raises(ValueError):
        mine.create_kb("travel")
    csv = "Kota,Pengunjung,Bulan\n" + "\n".join(f"Kota{i},{i * 10},Mei" for i in range(40))
    assert mine.ingest(upload(spark, tmp_path, "visits.csv", csv), kb_ids=[kb], categories=["stats"]).head()["status"] == "ready"
    note = "# Contact\n\nWrite to a@b.org about /api/v1/visits.\n\nThe office is open."
    mine.ingest(upload(spark, tmp_path, "note.md", note))
    bad = mine.ingest(upload(spark, tmp_path, "x.docx", "broken")).head()
    assert bad["status"] == "failed" and bad["error"]
    docs = mine.documents().collect()
    assert len(docs) == 3 and theirs.documents().count() == 0
    assert [r["documents"] for r in mine.knowledge_bases().collect()] == [1]
    found = mine.search("Kota0 Pengunjung", max_chunks=3)
    hits = found.hits.collect()
    assert hits and any("Kota0" in h["content"] for h in hits) and "[1] visits.csv" in found.context.head()[0]
    assert theirs.search("Kota0").hits.count() == 0
    assert mine.search("contact office", category="stats").hits.filter(F.col("title") == "note.md").count() == 0
    hybrid = mine.search("a@b.org office", hybrid=True, max_chunks=2).hits.collect()
    assert hybrid and {"place", "source_no"} <= set(hybrid[0].asDict())
    limited = KnowledgeBase(spark, root, Key("t1", ["search", "read"], [kb]))
    assert {h["title"] for h in limited.search("Kota0 office").hits.collect()} == {"visits.csv"}
    assert limited.documents(["other"]).count() == 0 and limited.documents().count() == 1
    with pytest.raises(PermissionError):
        limited.ingest(spark.createDataFrame([], "path string, length long, content binary"))
    doc = next(d["id"] for d in docs if d["title"] == "note.md")
    assert mine.search("office", document_ids=[doc], max_chunks=5).count() >= 0
    mine.record(hybrid and mine.search("office").hits)
    assert mine.tables.read("documents").filter("retrieval_count > 0").count() >= 1
    assert mine.jobs().filter("status = 'failed'").count() == 1
    assert mine.drift().filter("stale").count() == 0 and mine.re_embed([doc]).head()["ok"] == 1
    assert not theirs.delete(doc) and mine.delete(doc)
    assert mine.tables.read("chunks").filter(F.col("document_id") == doc).count() == 0
    assert mine.tables.read("entities").filter(F.col("document_id") == doc).count() == 0
    assert mine.health()["ok"] and len(mine.formats()) == 53


def test_keys(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    secret, stored = mint_key()
    assert hash_key(secret) == stored
    rows = [(stored, "t", "k", ["read"], [], None)]
    Tables(spark, root).append("api_keys", spark.createDataFrame(rows, "hash string, tenant_id string, name string, scopes array<string>, knowledge_base_ids array<string>, revoked_at timestamp"))
    assert KnowledgeBase.from_key(spark, root, secret).key.tenant == "t"
    with pytest.raises(PermissionError):
        KnowledgeBase.from_key(spark, root, "wrong")
    assert Key("t", [], ["a"]).narrowed(["a", "b"]) == ["a"] and Key("t", [], ["a"]).narrowed(["b"]) == [] and Key("t").narrowed(["b"]) == ["b"] and Key("t").narrowed([]) is None


def test_scopes_counters_events_and_clearing(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    mine, theirs = KnowledgeBase(spark, root, Key("t1", ["kb:read", "kb:write"])), KnowledgeBase(spark, root, Key("t2"))
    for name, kb in (("a.md", mine), ("b.md", theirs)):
        kb.ingest(upload(spark, tmp_path, name, "# Harbour\n\nThe harbour opens at nine."))
    reader = KnowledgeBase(spark, root, Key("t1", ["kb:read"]))
    with pytest.raises(PermissionError):
        reader.clear()
    for _ in range(2):
        assert reader.search("harbour").hits.count() >= 1
    assert [r["retrieval_count"] for r in mine.documents().collect()] == [2] and [r["retrieval_count"] for r in theirs.documents().collect()] == [0]
    frames = mine.events().collect()
    assert [(r["status"], r["label"], r["progress"]) for r in frames] == [("success", "Done", 100)]
    assert mine.events(frames[0]["updated_at"]).count() == 0
    mine.clear()
    assert mine.documents().count() == 0 and mine.tables.read("entities").count() == 0 and mine.tables.read("chunks").filter("tenant_id = 't1'").count() == 0
    assert theirs.documents().count() == 1 and theirs.search("harbour").hits.count() >= 1
