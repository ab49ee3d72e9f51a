"""Captions by place against every pair, and layouts' figures."""

import random

from sparrowdex.operators import placement

BLOCK = "document_id string, page int, pos int, type string, text string, box array<double>, image string, captions array<string>"


def test_captions_below_against_all_pairs(spark):
    r = random.Random(5)
    words = ["Gambar 1 {}", "Fig. {}", "figure", "Figures {}", "TABEL{}", " Chart: {}", "plain {}", None, ""]
    figures = [(i, r.choice(["a", "b", None]), r.choice([0, 1, None]), r.choice([float(r.randrange(0, 900, 5)), None, r.uniform(-300, 5000)]), "x") for i in range(400)]
    blocks = [(r.choice(["a", "b", None]), r.choice([0, 1, None]), n, r.choice([float(r.randrange(0, 900, 5)), None, r.uniform(-300, 5000)]), (r.choice(words) or "").format(n) or None) for n in range(60)]
    starts = ("gambar", "figure", "fig", "tabel", "table", "chart", "grafik", "diagram")

    def caption(text):
        t = (text or "").strip().lower()
        return any(t.startswith(w) and not (t[len(w) :][:1].isalnum() or t[len(w) :][:1] == "_") for w in starts)

    def near(doc, page, y1):
        met = [((y0 or 0.0), pos, text.strip()) for d, p, pos, y0, text in blocks if d is not None and d == doc and (p or 0) == (page or 0) and caption(text)]
        met = [m for m in met if (y1 or 0.0) - 30 <= m[0] and m[0] - (y1 or 0.0) < 200]
        return min(met)[2] if met else None

    f = spark.createDataFrame(figures, "id int, document_id string, page int, y1 double, near_caption string")
    b = spark.createDataFrame(blocks, "document_id string, page int, pos int, y0 double, text string")
    found = {x["id"]: x["near_caption"] for x in placement.captions_below(f, b).collect()}
    want = {i: near(d, p, y1) for i, d, p, y1, _ in figures}
    assert found == want and sum(v is not None for v in want.values()) > 50
    assert placement.captions_below(f.limit(0), b).count() == 0 and placement.captions_below(f, b.limit(0)).filter("near_caption IS NOT NULL").count() == 0


def test_equal_figures_and_user_columns_stay(spark):
    f = spark.createDataFrame([("a", 0, 100.0, 7, 8, 9)] * 3, "document_id string, page int, y1 double, _y int, _band int, _doc int")
    b = spark.createDataFrame([("a", 0, 2, 120.0, "Gambar 2"), ("a", 0, 1, 120.0, "Gambar 1"), ("a", 0, 0, 300.0, "Gambar 3")], "document_id string, page int, pos int, y0 double, text string")
    rows = placement.captions_below(f, b).collect()
    assert [(x["near_caption"], x["_y"], x["_band"], x["_doc"]) for x in rows] == [("Gambar 1", 7, 8, 9)] * 3


def test_layout_figures(spark):
    rows = [
        ("d", 0, 0, "image", None, [100.0, 100.0, 900.0, 500.0], "images/a.jpg", []),
        ("d", 0, 1, "text", "Gambar 2.1 Peta", [100.0, 520.0, 900.0, 540.0], None, None),
        ("d", 0, 2, "chart", None, [0.0, 600.0, 1200.0, 700.0], "images/b.jpg", [" Grafik", "lima "]),
        ("d", 1, 3, "image_block", None, None, "c.jpg", None),
        ("d", 1, 4, "image", None, None, None, None),
        ("d", 1, 5, "table", None, None, "t.jpg", None),
    ]
    out = {r["figure_id"]: r for r in placement.layout_figures(spark.createDataFrame(rows, BLOCK)).collect()}
    assert set(out) == {"a.jpg", "b.jpg", "c.jpg"}
    assert out["a.jpg"]["caption"] == "Gambar 2.1 Peta" and out["a.jpg"]["box"] == [0.1, 0.1, 0.9, 0.5]
    assert out["b.jpg"]["caption"] == "Grafik lima" and out["b.jpg"]["box"] == [0.0, 0.6, 1.0, 0.7]
    assert out["c.jpg"]["caption"] is None and out["c.jpg"]["box"] == [0.0, 0.0, 1.0, 1.0] and out["c.jpg"]["page"] == 1
