"""Ingest with a layout's blocks: pages, figures, prefixes; search brings the figures and obeys the settings."""

from pyspark.sql import functions as F

from sparrowdex.api import Key, KnowledgeBase
from sparrowdex.config import Settings
from sparrowdex.sources import files

BLOCKS = "path string, page int, pos int, type string, text string, box array<double>, image string, captions array<string>"


def test_layout_to_search(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one = "The harbour opens at nine in the morning for every ship."
    two = "Cargo of grain and salt is weighed behind the old customs house."
    (folder / "port.md").write_text(f"# Port of Surabaya\n\n{one}\n\n# Cargo and duties\n\n{two}")
    (folder / "plain.md").write_text("# Hills\n\nNothing is known of these hills but their names.")
    source = files.scan_directory(spark, f"file://{folder}")
    path = next(r["path"] for r in source.collect() if r["path"].endswith("port.md"))
    rows = [
        (path, 1, -1, "text", "Port of Surabaya", [0.0, 50.0, 900.0, 90.0], None, None),
        (path, 1, 0, "text", one, [0.0, 100.0, 900.0, 140.0], None, None),
        (path, 1, 1, "image", None, [0.0, 200.0, 900.0, 500.0], "images/crane.jpg", None),
        (path, 1, 2, "text", "Gambar 1 Harbour crane", [0.0, 510.0, 900.0, 530.0], None, None),
        (path, 2, 2, "text", "Cargo and duties", [0.0, 50.0, 900.0, 90.0], None, None),
        (path, 2, 3, "text", two, [0.0, 100.0, 900.0, 140.0], None, None),
        (path, 2, 4, "chart", None, None, "images/grain.jpg", None),
    ]
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb", Key("t"), contextualizer=lambda p: '["first", "second"]', settings=Settings(env={"KB_FIGURE_LIMIT": "1"}))
    kb.ingest(source, figures="force", layouts=spark.createDataFrame(rows, BLOCKS))
    chunks = kb.tables.read("chunks").collect()
    prose = {r["content"]: r for r in chunks if r["chunk_type"] != "figure"}
    assert {r["page"] for c, r in prose.items() if "harbour opens" in c} == {1} and {r["page"] for c, r in prose.items() if "Cargo of grain" in c} == {2}
    assert all(r["page"] is None for c, r in prose.items() if "hills" in c)
    figures = {r["asset_key"].rsplit("/", 1)[1]: r for r in chunks if r["chunk_type"] == "figure"}
    assert set(figures) == {"crane.jpg", "grain.jpg"} and all(r["embedding"] for r in figures.values())
    assert figures["crane.jpg"]["section"] == "Gambar 1 Harbour crane" and one in figures["crane.jpg"]["content"]
    assert two in figures["grain.jpg"]["content"] and figures["grain.jpg"]["page"] == 2
    by_index = {(r["document_id"], r["chunk_index"]): r for r in chunks}
    assert len(by_index) == len(chunks)
    for name, text in (("crane.jpg", one), ("grain.jpg", two)):
        f = figures[name]
        assert text in by_index[f["document_id"], f["anchor_chunk_index"]]["content"]
    assert {r["contextual_prefix"] for r in prose.values()} <= {"first", "second", None}
    found = kb.search("harbour crane ship", hybrid=True, max_chunks=2)
    shown = [h["asset_key"] for h in found.hits.collect() if h["asset_key"]]
    assert any("crane.jpg" in a for a in shown) and found.stats["figures"]["rows"] <= 1
    off = KnowledgeBase(spark, f"file://{tmp_path}/kb", Key("t"), settings=Settings(env={"KB_BM25_ENABLED": "false", "KB_RERANK_ENABLED": "true"}))
    stats = off.search("harbour", max_chunks=1).stats
    assert "bm25" not in stats and "rerank" in stats
    assert kb.tables.read("chunks").filter(F.col("chunk_type") == "figure").count() == 2
