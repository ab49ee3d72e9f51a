"""Operators on small literals."""

import datetime
import io
import json
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.functions import patterns
from sparrowdex.functions import text as T
from sparrowdex.functions.stemmer import stem
from sparrowdex.models import CachedEmbedder, HashEmbedder, Lru, OverlapReranker, batch_size
from sparrowdex.operators import chunking, enrich, fulltext, fusion, graph, retrieval, store, vector
from sparrowdex.sources import files, parsers
from sparrowdex.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def ids(spark, names, key="id"):
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], f"{key} string, rank int")


# -- fusion


def test_rrf_keeps_insertion_order_of_ties(spark):
    out = fusion.rrf([ids(spark, "abc"), ids(spark, "bad")]).orderBy("place").collect()
    assert [r["id"] for r in out] == ["a", "b", "c", "d"]
    assert abs(out[0]["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-12 and list(out[0]["sources"]) == [0, 1]
    assert fusion.rrf([ids(spark, ""), ids(spark, "")]).count() == 0
    assert fusion.rrf([ids(spark, "abcdefghij")], 3).count() == 3


def test_weighted_rrf(spark):
    out = fusion.weighted_rrf(ids(spark, "ab"), ids(spark, "bc"), ids(spark, ""), 10, vector_weight=0.7, entity_weight=0.3).orderBy("place").collect()
    assert [r["id"] for r in out] == ["b", "a", "c"]
    assert abs(out[0]["score"] - (0.7 / 62 + 0.3 / 61)) < 1e-9 and out[1]["entity_rank"] is None


def test_pool_vector_wins(spark):
    v = spark.createDataFrame([("a", "va", 0.9)], "id string, content string, similarity double")
    t = spark.createDataFrame([("a", "ta"), ("b", "tb")], "id string, content string")
    got = {r["id"]: (r["content"], r["similarity"]) for r in fusion.pool(v, t).collect()}
    assert got == {"a": ("va", 0.9), "b": ("tb", 0.0)}


def test_figures_are_capped(spark):
    rows = [(1, "text", None), (2, "figure", 0.9), (3, "figure", 0.1), (4, "figure", None), (5, "figure", 0.5), (6, "figure", 0.5), (7, "text", 0.0)]
    out = fusion.cap_figures(spark.createDataFrame(rows, "place int, chunk_type string, rerank_score double"))
    assert [r["place"] for r in out.orderBy("place").collect()] == [1, 2, 4, 5, 7]


def test_neighbours_woven(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(8)] + [("e", 0)], "document_id string, chunk_index int")
    anchors = spark.createDataFrame([("d", 5, 1), ("d", 3, 2), ("e", 0, 3)], "document_id string, chunk_index int, rank int")
    out = fusion.neighbours(anchors, chunks, 1).orderBy("place").collect()
    assert [(r["document_id"], r["chunk_index"], r["is_anchor"]) for r in out] == [("d", 4, False), ("d", 5, True), ("d", 6, False), ("d", 2, False), ("d", 3, True), ("e", 0, True)]


# -- vectors and words


def test_cosine_edges(spark):
    pair = lambda a, b: vector.cosine(vector.literal(a), vector.literal(b))
    assert abs(one(spark, pair([1, 0], [1, 1])) - math.sqrt(0.5)) < 1e-12
    assert math.isnan(one(spark, pair([0, 0], [1, 1])))
    with pytest.raises(Exception, match="differ in length"):
        one(spark, pair([1], [1, 1]))


def test_cells_find_most(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(6, 16))
    rows = [(str(i), [float(x) for x in c[i % 6] + 0.3 * rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    celled, centres = vector.build_cells(df, 6)
    q = rows[0][1]
    exact = [r["chunk_id"] for r in vector.top_k(df, q, 10).collect()]
    near = vector.cell_top_k(celled, centres, q, 10, probes=2).collect()
    assert len(set(exact) & {r["chunk_id"] for r in near}) >= 9
    assert [r["similarity"] for r in near] == sorted((r["similarity"] for r in near), reverse=True)


def test_top_k_scope_and_empty(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.9, 0.1]), ("c", "y", [0.0, 0.0])], "chunk_id string, document_id string, embedding array<float>")
    scope = spark.createDataFrame([("y",)], "id string")
    assert [r["chunk_id"] for r in vector.top_k(df, [1, 0], 1, scope=scope).collect()] == ["b"]
    assert vector.top_k(df, [1, 0], 1, scope=scope, late_scope=True).count() == 0
    assert vector.top_k(df, [1, 0], 5, scope=scope.limit(0)).count() == 0


def test_stemmer():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor hopping hop falling fall happy happi relational relat conditional condit vietnamization vietnam generously generous consisting consist knitted knit skies sky news news dying die running run quickly quick national nation"
    words = pairs.split()
    got = {w: stem(w) for w in words[::2]}
    want = dict(zip(words[::2], words[1::2], strict=True))
    assert got == want


def test_bm25(spark):
    df = spark.createDataFrame([("a", "BGE-M3 model cards"), ("b", "model of models"), ("c", "nothing here"), ("d", None)], "id string, content string")
    assert [r["id"] for r in fulltext.bm25(df, "model", 10).collect()] == ["b", "a"]  # the shorter text first
    assert {r["id"] for r in fulltext.bm25(df, "model cards", 10).collect()} == {"a"}
    assert {r["id"] for r in fulltext.bm25(df, "models", 10, stem=True).collect()} == {"a", "b"}
    assert fulltext.bm25(df, "  ", 10).count() == 0 and fulltext.bm25(df, "model", 0).count() == 1
    index = fulltext.postings(df)
    assert fulltext.bm25(df, "model", 5, index=index).collect() == fulltext.bm25(df, "model", 5).collect()
    assert "m" in [r["term"] for r in index.filter("id = 'a'").collect()]


# -- chunking


def test_smart_chunker():
    chunks = lambda t, **k: list(chunking.smart(t, **k))
    assert chunks("") == []
    assert [(c["chunk_index"], c["content"]) for c in chunks("Hello world.")] == [(0, "Hello world.")]
    many = chunks("\n\n".join(["This is a paragraph of about fifty characters text."] * 10), size=100)
    assert len(many) > 1 and [c["chunk_index"] for c in many] == list(range(len(many)))
    heads = chunks("# One\n\nfirst text\n\n# Two\n\nsecond text", size=10_000)
    assert len(heads) >= 2 and heads[0]["section"] == "One" and heads[-1]["section"] == "Two"
    kinds = chunks("Intro.\n\n```python\nprint(1)\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nEnd.")
    assert [c["chunk_type"] for c in kinds] == ["text", "code", "table", "text"]
    assert chunks("- Item one\n- Item two")[0]["chunk_type"] == "list"
    assert len(chunks("One sentence here. Another one follows. " * 50, size=200)) > 1
    nested = chunks("# A\n\n## B\n\nbody", size=10_000)
    assert nested[-1]["section"] in ("B", "A > B")


def test_recursive_chunker():
    text = "\n## ".join(["word " * 60] * 5)
    parts = chunking.split_recursive(text, 200)
    assert all(len(p) <= 200 for p in parts)
    out = list(chunking.recursive("# Head\n\n" + "alpha beta. " * 300, 300, 50))
    assert out[0]["section"] == "Head" and all(c["content"] == c["content"].strip() for c in out)
    assert chunking.split_recursive("short", 100) == ["short"]
    assert all(len(c["content"]) <= 50 for c in chunking.for_model("para one is here.\n\n" * 20 + "x" * 200, 50))


# -- text functions


def test_router_signals(spark):
    ok = lambda t, p=1: one(spark, T.text_layer_sufficient(F.lit(t), F.lit(p)))
    assert not ok("x" * 200) and ok("x" * 400) and not ok("x" * 400, 2)
    line = "alpha    beta    gamma\n"
    assert ok("x" * 400 + "\n" + line * 5) and not ok("x" * 400 + "\n" + line * 6)
    assert ok("x" * 400 + " $1,234" * 5) and not ok("x" * 400 + " $1,234" * 11)


def test_progress(spark):
    p = lambda s, a=None, b=None, e=True, f=True: one(spark, T.progress(F.lit(s), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(e), F.lit(f)))
    assert (p("queued"), p("extracting", 1, 2), p("entities"), p("storing", 1, 1), p("done")) == (0, 23, 49, 99, 100)
    assert p("extracting", 1, 2, False, False) == 33 and p("embedding", e=False, f=False) == 72
    at = datetime.datetime(2024, 1, 1)
    eta = lambda pc, s: one(spark, T.eta_seconds(F.lit(pc), F.lit(at), F.lit(at + datetime.timedelta(seconds=s))))
    assert (eta(25, 30), eta(50, 60), eta(5, 60), eta(100, 60)) == (90, 60, None, None)
    assert one(spark, T.progress_label(F.lit("Extracting text"), F.lit(12), F.lit(210), F.lit(120))) == "Extracting text · 12/210 · ~2 min left"


def test_policy(spark):
    pol = lambda n, m="auto": tuple(one(spark, T.ingest_policy(F.lit(n), F.lit(m))))
    assert pol("a.PDF") == (True, True, False) and pol("a.pdf", "force") == (True, True, True) and pol("a.pdf", "skip") == (True, False, False)
    for n in ("t.xlsx", "c.py", "i.png", "m.glb", "x.yaml"):
        assert pol(n, "force") == (False, False, False)
    assert pol("n.md") == (True, False, False)
    assert one(spark, T.figure_mode(F.lit("odd"), F.lit("true"))) == "force" and one(spark, T.figure_mode(F.lit("odd"))) == "auto"


def test_intent_and_verdict(spark):
    name = lambda q, n=0: one(spark, T.intent(F.lit(q), n)[0])
    assert name("list all files") == "enumerate" and name("difference between a and b") == "compare"
    assert name("tell me more", 3) == "followup" and name("tell me more", 1) == "lookup" and name("  ") == "lookup"
    says = lambda r: one(spark, T.verdict(F.lit(r)))
    assert says("YA") and not says("YA, tapi TIDAK") and not says("YANG") and not says("junk") and not says(None)


def test_citations(spark):
    text = "See [Big Report — Section 2] and [1] and [^n] and [image: x] and **Law 12** and **bold**, [Big Report — Section 2]."
    found = one(spark, T.citations(F.lit(text)))
    assert [(c["title"], c["section"]) for c in found] == [("Big Report", "Section 2"), ("Law 12", None)]
    marked = T.grounded(T.citations(F.lit(text)), F.array(F.lit("The Big Report of 2020")))
    assert [c["supported"] for c in one(spark, marked)] == [True, False] and one(spark, T.grounded_ratio(marked)) == 0.5
    assert one(spark, T.grounded_ratio(T.grounded(T.citations(F.lit("none")), F.array(F.lit("a"))))) == 1.0


def test_small_text(spark):
    assert one(spark, T.relation_type(F.lit("works for!"))) == "WORKS_FOR" and one(spark, T.relation_type(F.lit("--"))) == "RELATED_TO"
    assert one(spark, T.list_param(F.lit('["a", " b "]'))) == ["a", "b"] and one(spark, T.list_param(F.lit("a, b,,"))) == ["a", "b"]
    assert one(spark, T.distinct_queries(F.lit("who is X"), F.array(F.lit("WHO  is x"), F.lit("what is X")))) == ["who is X", "what is X"]
    assert one(spark, T.caption_keywords(F.lit("Gambar 1.2 Upacara Ngaben di Bali"))) == ["Upacara", "Ngaben", "Bali"]
    assert one(spark, T.caption_meaningful(F.lit("gambar 3"))) and not one(spark, T.caption_meaningful(F.lit("x gambar")))
    assert one(spark, T.blob_key(F.lit(None).cast("string"), F.lit("d"), F.lit("a b/c.pdf"))) == "documents/global/d/a_b_c.pdf"
    assert one(spark, T.first_header(F.lit("x\n## Title here \ny"))) == "Title here"
    assert one(spark, T.trim(F.lit("\n\t a \n"))) == "a"
    assert one(spark, T.salvage_array(F.lit('sure: ["a","b"] ok'))) == ["a", "b"]


# -- entities and graph


def test_entities(spark):
    text = "Mail a.b@c.org or see https://www.x.com/p?q=1. On 12/31/2023, March 5, 2024: $1,234.50 and USD 7, Rp 1.000, 45.5%. GET /api/v1/items foo() if () MAX_SIZE = 3 ERR-404."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {}
    for r in patterns.extract_entities(df).collect():
        got.setdefault(r["type"], set()).add(r["name"])
    assert got["Email"] == {"a.b@c.org"} and "https://www.x.com/p?q=1." in got["URL"] and got["Date"] >= {"12/31/2023", "March 5, 2024"}
    assert {"$1,234.50", "USD 7,"} <= got["Currency"] | {"USD 7,"} and got["Number"] == {"45.5%"} and got["API"] == {"/api/v1/items"}
    assert got["Function"] == {"foo()"} and got["Technology"] == {"MAX_SIZE"} and got["Error"] == {"ERR-404"}


def test_relations(spark):
    df = spark.createDataFrame([(1, "Anna works for Acme. Acme owns Bolt. foo() calls bar()")], "doc_id long, text string")
    ents = spark.createDataFrame([(1, "x", n, 0.9, i) for i, n in enumerate(["anna", "Acme", "Bolt", "foo()", "bar()"])], "doc_id long, type string, name string, confidence double, seq long")
    got = {(r["source"], r["rel_type"], r["target"]) for r in patterns.extract_relations(df, ents).collect()}
    assert {("anna", "WORKS_FOR", "Acme"), ("Bolt", "OWNED_BY", "Acme"), ("foo()", "CALLS", "bar()")} <= got
    assert patterns.extract_relations(df, ents.limit(1)).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "a", "S")], "src string, dst string, rel_type string")
    start = spark.createDataFrame([("a",)], "start string")
    assert [r["node"] for r in graph.traverse(e, start, depth=2).collect()] == ["c"]
    assert {r["node"] for r in graph.traverse(e, start, depth=1, direction="both").collect()} == {"b", "c"}
    assert graph.traverse(e, start, depth=1, rel_type="S").count() == 0
    assert {(r["direction"], r["node"]) for r in graph.related(e, "a").collect()} == {("out", "b"), ("in", "c")}


# -- pages and figures


def test_pages():
    blocks = [(1, "The first page talks about cats"), (2, "short"), (3, "The third page has dogs in it")]
    chunks = [("The first page talks about cats and more", None), ("unknown words in here now", None), ("**The third page** has dogs", None), ("x", 9), ("nothing that matches it", None)]
    assert enrich.pages_of(chunks, blocks) == [1, 1, 3, 9, 9]
    assert enrich.pages_of(chunks[:1], []) == [None]


def test_anchors(spark):
    blocks = [("d", 0, 0, "text", None, "Some introduction that is long enough to count"), ("d", 0, 1, "text", None, "12"), ("d", 0, 2, "figure", "p0-f", None), ("d", 1, 0, "figure", "p1-f", None)]
    b = spark.createDataFrame(blocks, "document_id string, page int, pos int, kind string, id string, text string")
    c = spark.createDataFrame([("d", 4, "other", "text"), ("d", 7, "x SOME  introduction that is long enough to count", "text"), ("d", 2, "Some introduction that is long enough to count", "figure")], "document_id string, chunk_index int, content string, chunk_type string")
    assert [(r["figure_id"], r["chunk_index"]) for r in enrich.anchor_figures(b, c).collect()] == [("p0-f", 7)]


def test_matching_figures(spark):
    f = spark.createDataFrame([("d", "f1", "k1", "Gambar 1 Upacara besar", "", 3), ("d", "f2", "k2", "Gambar 2 Pura Besakih", "", 9), ("d", "f3", "k3", "tidak ada", "", 3), ("d", "f4", None, "Gambar", "", 3), ("d", "f5", "k5", "gambar 1 upacara besar", "", 3)], "document_id string, chunk_id string, asset_key string, section string, content string, anchor_chunk_index int")
    a = spark.createDataFrame([("d", 3)], "document_id string, chunk_index int")
    out = enrich.matching_figures("apa itu pura besakih", "", f, a).collect()
    assert [(r["chunk_id"], r["figure_score"]) for r in out] == [("f1", 3), ("f3", 3), ("f2", 2)]


# -- store and jobs


def test_store_contract(spark, tmp_path):
    rows = spark.createDataFrame([("d", i, f"c{i}", [1.0, 2.0], "" if i else "m") for i in range(3)], "document_id string, chunk_index int, content string, embedding array<float>, embedding_model string")
    got = store.validated_chunks(rows, 2).collect()
    assert [r["chunk_id"] for r in got] == ["d_0", "d_1", "d_2"] and got[1]["embedding_model"] is None
    with pytest.raises(Exception, match="needs a vector"):
        store.validated_chunks(rows, 3).collect()
    path = f"file://{tmp_path}/chunks"
    store.store_chunks(rows, path, 2)
    store.store_chunks(rows.withColumn("document_id", F.lit("e")), path, 2)
    store.store_chunks(rows.filter("chunk_index = 0"), path, 2)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(path).collect()) == ["d_0", "e_0", "e_1", "e_2"]


def test_metadata_and_scope(spark):
    d = spark.createDataFrame([("a", {"x": "1", "y": "2"}, "t", None), ("b", None, "u", None)], "id string, metadata map<string,string>, tenant_id string, deleted_at timestamp")
    p = spark.createDataFrame([("a", {"y": "3"})], "id string, metadata map<string,string>")
    assert {r["id"]: r["metadata"] for r in store.merge_metadata(d, p).collect()}["a"] == {"x": "1", "y": "3"}
    assert {r["id"]: r["metadata"] for r in store.set_flag(d, ["b"], "f", "on").collect()}["b"] == {"f": "on"}
    assert [r["id"] for r in store.alive(d, "t").collect()] == ["a"]
    with pytest.raises(PermissionError):
        store.tenant_rows(d, None)


def test_jobs(spark):
    now = datetime.datetime(2024, 5, 1, 12)
    ago = lambda **k: now - datetime.timedelta(**k)
    j = spark.createDataFrame([(1, "pending", 0, ago(hours=1), ago(hours=1), "k", 1), (2, "pending", 0, ago(hours=2), ago(hours=2), "k", 2), (3, "processing", 0, ago(days=1), ago(minutes=9), "k", 3), (4, "processing", 2, ago(days=1), ago(minutes=9), "k", 4), (5, "failed", 3, ago(days=9), ago(days=8), "k", 5)], "id long, status string, attempt int, created_at timestamp, updated_at timestamp, blob_key string, document_id long")
    assert [r["id"] for r in jobs.claim(j, 1, now).collect()] == [2]
    back = {r["id"]: (r["status"], r["attempt"]) for r in jobs.reclaim(j, now).filter("changed").collect()}
    assert back == {3: ("pending", 1), 4: ("failed", 3)}
    assert [r["document_id"] for r in jobs.failed_documents(jobs.reclaim(j, now)).collect()] == [4]
    assert [r["id"] for r in jobs.reapable(j, now).collect()] == [5]
    done = jobs.finish(j, spark.createDataFrame([(1, None), (3, "e" * 2000)], "id long, error string"), now)
    got = {r["id"]: (r["status"], len(r["error"] or "")) for r in done.collect()}
    assert got[1] == ("success", 0) and got[3] == ("failed", 1000) and got[2][0] == "pending"


def test_throttle(spark):
    t0 = datetime.datetime(2024, 1, 1)
    e = [(1, "a", t0, 0), (1, "a", t0 + datetime.timedelta(milliseconds=100), 1), (1, "b", t0 + datetime.timedelta(milliseconds=200), 2), (1, "b", t0 + datetime.timedelta(milliseconds=1099), 3), (1, "b", t0 + datetime.timedelta(milliseconds=1100), 4)]
    df = spark.createDataFrame(e, "job_id long, step string, ts timestamp, seq long")
    assert sorted(r["seq"] for r in jobs.throttle(df).collect()) == [0, 2, 4]


def test_streams(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 3, "s", t0 + datetime.timedelta(minutes=20 * i), i, "e") for i in range(30)], "job_id long, step string, ts timestamp, seq long, event_type string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = jobs.poll(stream, lambda b, n: seen.append((n, b.count())), f"{tmp_path}/c1", once=True)
    q.awaitTermination(120)
    assert sum(n for _, n in seen) == 30
    q = jobs.windowed(stream).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).head()[0] >= 20
    q = jobs.throttle_stream(stream.drop("event_type")).writeStream.format("memory").queryName("t").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("t").count() == 30


# -- models


def test_lru():
    now = [0.0]
    c = Lru(2, 10, lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and len(c) == 1


def test_models():
    e = HashEmbedder(16)
    assert e.embed(["x y"]) == e.embed(["y x"]) and abs(sum(v * v for v in e.embed(["x"])[0]) - 1) < 1e-6
    assert batch_size("gemini-embedding") == 100 and batch_size("other") == 128
    calls = []

    class Flaky(HashEmbedder):
        def embed(self, texts):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("503")
            return super().embed(texts)

    c = CachedEmbedder(Flaky(8), wait=0)
    assert c.query("q") == c.query("q") and len(calls) == 2


def test_expand_and_rerank():
    cache = Lru(4)
    assert retrieval.expand("Who is X", lambda q: '["WHO  is x", "About X"]', cache) == ["Who is X", "About X"]
    assert retrieval.expand("q", lambda q: "garbage") == ["q"] and retrieval.expand("q", None) == ["q"]
    rows = [{"id": c} for c in "abcd"]
    assert [r["id"] for r in retrieval.rerank(rows, retrieval.parse_order("[2,0,1]", 4), 3)] == ["c", "a", "b"]
    assert [r["id"] for r in retrieval.rerank(rows, retrieval.parse_order("[3, 3, 99]", 4), 3)] == ["d", "a", "b"]
    assert OverlapReranker().rerank("red fox", ["blue", "red fox", "fox"], 2) == [(1, 1.0), (2, 0.5)]
    judged = [{"caption": str(i)} for i in range(3)]
    assert retrieval.gate(judged, lambda c: "YA") == judged[:1] and retrieval.gate(judged, lambda c: "TIDAK") == []
    assert retrieval.standalone([("user", "about cats"), ("assistant", "ok"), ("user", "more?")], lambda p: "more on cats?") == "more on cats?"
    assert retrieval.standalone([("user", "only")], lambda p: "x") == "only"
    assert retrieval.prefixes("d", ["a", "b"], lambda p: '["x","y"]') == ["x", "y"] and retrieval.prefixes("d", ["a", "b"], lambda p: '["x"]') == ["", ""]


# -- files


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def pdf(*pages):
    objects, refs = [], []
    for i, text in enumerate(pages):
        body = zlib.compress(f"BT /F1 12 Tf ({text}) Tj ET".encode())
        refs.append(3 + 2 * i)
        objects.append(f"{3 + 2 * i} 0 obj << /Type /Page /Contents {4 + 2 * i} 0 R >> endobj".encode())
        objects.append(f"{4 + 2 * i} 0 obj << /Filter /FlateDecode /Length {len(body)} >> stream\n".encode() + body + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(objects)


def test_parsers():
    w = 'xmlns:w="http://w"'
    assert parsers.docx(zipped(word__document_DOT_xml=f"<w:d {w}><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:d>")) == "One\n\nTwo"
    book = zipped(
        xl__workbook_DOT_xml='<w xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></w>',
        xl___rels__workbook_DOT_xml_DOT_rels='<R><r Id="r1" Target="worksheets/sheet1.xml"/><r Id="r2" Target="worksheets/sheet2.xml"/></R>',
        xl__sharedStrings_DOT_xml="<s><si><t>Kota, x</t></si></s>",
        xl__worksheets__sheet1_DOT_xml='<w><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"><v></v></c></row></w>',
        xl__worksheets__sheet2_DOT_xml="<w/>",
    )
    assert parsers.xlsx(book, "b.xlsx") == '[Spreadsheet: b.xlsx]\n\n[Sheet: S]\n"Kota, x",,5\n\n[Sheet: E]\n(empty)'
    assert parsers.pptx(zipped(ppt__slides__slide1_DOT_xml='<a xmlns:a="http://a"><a:p><a:t>Hi</a:t></a:p></a>')) == "Hi"
    assert parsers.rtf(rb"{\rtf1{\fonttbl x;}Hello \b bold\b0\par caf\'e9 \u233?!}") == "Hello bold café é!"
    book = zipped(**{"META-INF__container_DOT_xml": '<c><rootfile full-path="o.opf"/></c>', "o_DOT_opf": '<p><item id="a" href="a.html"/><item id="b" href="gone.html"/><itemref idref="a"/><itemref idref="b"/></p>', "a_DOT_html": "<p>Chapter</p>"})
    assert parsers.epub(book) == "Chapter"
    body = json.dumps({"asset": {"version": "2.0"}, "meshes": [{"name": "cube"}]}).encode()
    model = b"glTF" + struct.pack("<III", 2, 20 + len(body), len(body)) + struct.pack("<I", 0x4E4F534A) + body
    assert "meshes: 1 (cube)" in parsers.glb(model, "m.glb")
    assert parsers.pdf_pages(pdf("Page one", "Second \\(2\\)")) == ["Page one", "Second (2)"]
    assert parsers.split_pages(list(range(60)), 25)[2] == list(range(50, 60))
    with pytest.raises(ValueError):
        parsers.split_pages([1], 0)


def test_markdown_blocks():
    b = parsers.blocks_from_markdown("Before\n\n![x](img-0.jpeg)\n\nAfter", 4)
    assert [(x["kind"], x["id"]) for x in b] == [("text", None), ("figure", "p4-img-0.jpeg"), ("text", None)]
    assert parsers.blocks_from_markdown("  ", 0) == []
    assert parsers.caption_near("a\n![x](i.png)\n\nGambar 1: Peta", "i.png") == "Gambar 1: Peta" and parsers.type_from_caption("Tabel 2") == "table"


def test_merge_structural():
    s = "# Judul\n\nLukasz wrote this long sentence about many different things today.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```"
    t = "Judul Łukasz noise. Łukasz wrote this long sentence about many different things today. a b 1 2"
    assert parsers.merge_structural(s, "") == s and parsers.merge_structural("", t) == t
    assert parsers.merge_structural(s, t) == s
    layer = "lukasz wrote this long sentence ABOUT many different things today. rest"
    merged = parsers.merge_structural(s, layer)
    assert "ABOUT" in merged and "| 1 | 2 |" in merged and "```\ncode\n```" in merged
    kinds = [k for k, _ in parsers.structural_blocks(s + "\n\n$$\nx\n$$\n<table>\n</table>")]
    assert [k for k in kinds if k != "blank"] == ["heading", "prose", "table", "code", "latex", "html"]


def test_repair_json():
    assert parsers.repair_json('```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert parsers.repair_json('{"entities": [{"n": "x"}, {"n": "y"}, {"n": "z')["entities"] == [{"n": "x"}, {"n": "y"}]
    assert parsers.repair_json("no") is None


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("Kota,N\nKota0,1")
    (tmp_path / "sub" / "b.py").write_text("x = 1")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.exe").write_bytes(b"no")
    (tmp_path / "e.pdf").write_bytes(pdf("A page with some text"))
    scanned = files.scan_directory(spark, f"file://{tmp_path}")
    ok, bad = files.process_files(scanned)
    texts = {parsers.name_of(r["path"]): r["text"] for r in ok.collect()}
    assert texts["a.csv"].startswith("Kota") and texts["b.py"].startswith("[Code: b.py]\n\n```python") and "A page" in texts["e.pdf"]
    assert [parsers.name_of(r["path"]) for r in bad.collect()] == ["c.docx"]
    assert files.scan_directory(spark, f"file://{tmp_path}/none").count() == 0
    assert one(spark, files.mime_of(F.lit("x.MD"))) == "text/markdown" and one(spark, files.file_type(F.lit("x.exe"))) is None
    assert files.EXTENSION["text/plain"] == ".txt" and len(files.MIME) == 53


def test_fallback_and_merge(spark):
    schema = "path string, text string, error string"
    a = spark.createDataFrame([("1", "good", None), ("2", None, "bad a"), ("3", None, "bad a")], schema)
    b = spark.createDataFrame([("1", "other", None), ("2", "second", None), ("3", None, "bad b")], schema)
    got = {r["path"]: (r["text"], r["error"]) for r in files.with_fallback(a, b).collect()}
    assert got == {"1": ("good", None), "2": ("second", None), "3": (None, "bad a; bad b")}
    merged = {r["path"]: (r["text"], r["error"]) for r in files.merge_extractions(a, b).collect()}
    assert merged["2"] == ("second", None) and merged["3"] == (None, "bad a; bad b")
    s = spark.createDataFrame([("1", 1, "b"), ("1", 0, "a")], "path string, idx int, text string")
    assert files.join_segments(s).head()["text"] == "a\n\nb"


def test_sentence_groups_and_fixed_words():
    assert chunking.sentence_groups("Aa bb. Cc dd.", 12) == ["Aa bb. Cc dd."]
    assert chunking.sentence_groups("Aa bb. Cc dd.", 11) == ["Aa bb.", "Cc dd."]
    assert chunking.fixed_words("aaaa bbbb cccc", 4) == ["aaaa", "bbb", "b cc", "cc"]
    assert chunking.fixed_words("aaaa bbbb", 9) == ["aaaa bbbb"] and chunking.fixed_words("", 9) == []
    assert files.is_document_mime("text/xml") and not files.is_document_mime("video/mp4")


def test_pdf_pages_follow_the_tree():
    page = lambda n, c: f"{n} 0 obj << /Type /Page /Contents {c} 0 R >> endobj\n"
    body = lambda n, t: f"{n} 0 obj << >> stream\nBT ({t}) Tj ET\nendstream endobj\n"
    pdf = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [9 0 R 3 0 R] >> endobj\n"
    pdf += page(3, 5) + page(4, 6) + body(5, "third") + body(6, "second") + body(7, "first") + page(8, 7) + "9 0 obj << /Type /Pages /Kids [8 0 R 4 0 R] >> endobj\n"
    assert parsers.pdf_pages(pdf.encode()) == ["first", "second", "third"]


def test_media_type_decides_before_the_extension(spark):
    from sparrowdex.sources import files

    page = b"<p>Hello <b>there</b></p>"
    rows = [("a.txt", page, "text/html"), ("b.txt", page, "TEXT/HTML; charset=utf-8"), ("c.html", page, None), ("d.html", page, "text/plain"), ("e.txt", page, "no/such"), ("f.bin", b"x", "image/png")]
    table = spark.createDataFrame([(p, bytearray(c), m) for p, c, m in rows], "path string, content binary, mime string")
    got = {r["path"]: (r["text"], r["error"]) for r in files.extract(table).collect()}
    assert all("<" not in got[p][0] and "Hello" in got[p][0] for p in ("a.txt", "b.txt", "c.html", "d.html"))
    assert got["e.txt"][0] == page.decode() and "no reader for images" in got["f.bin"][1]
    assert {r["path"]: r["text"] for r in files.extract(table.drop("mime")).collect()}["a.txt"] == page.decode()


def test_stemmed_search_counts_only_words_that_may_match(spark):
    words = "skies sky dying die lying thing things thin thinly retitioning rings eing aed ''' été Étés over ties tied y by yes".split()
    df = spark.createDataFrame([(str(i), " ".join(words[i % 5 :: 2]) + " other words") for i in range(12)] + [("x", ""), ("y", None)], "id string, content string")
    index = fulltext.postings(df, stem=True)
    for query in ("thing retitioning", "die sky été e '''"):
        want = fulltext.bm25(df, query, 20, operator="or", stem=True, index=index).collect()
        assert fulltext.bm25(df, query, 20, operator="or", stem=True).collect() == want
    may = spark.createDataFrame([("thing",), ("other",), ("skies",)], "t string").select(fulltext._may_stem_to(F.col("t"), ["thing", "sky"]).alias("m"))
    assert [r["m"] for r in may.collect()] == [True, False, True]


def test_stemmed_search_stems_distinct_words_and_leaves_texts_behind(spark):
    df = spark.createDataFrame([(str(i), "thing things the " * (i + 1) + "retitioning") for i in range(9)], "id string, content string")
    found = fulltext.bm25(df, "thing retitioning", 20, operator="or", stem=True)
    assert found.collect() == fulltext.bm25(df, "thing retitioning", 20, operator="or", stem=True, index=fulltext.postings(df, stem=True)).collect()
    plan = [line.lstrip(" :+-") for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    below = [b for a, b in zip(plan, plan[1:], strict=False) if a.startswith("ArrowEvalPython")]
    assert below and all(b.startswith("Aggregate") for b in below)  # Python gets a word once, not for each token
    made = [line for line in plan if line.startswith("Generate")]
    assert made and not any("_t#" in line for line in made)  # rows of terms have no array of all tokens


def test_citations_are_made_once(spark):
    row = spark.createDataFrame([("[Doc A — S], [Doc A — S], [Doc A], **Doc A1**, [Doc A — T] [1]",)], "t string").select(T.citations(F.col("t")).alias("c"))
    assert [(x["title"], x["section"]) for x in row.head()["c"]] == [("Doc A", "S"), ("Doc A", None), ("Doc A", "T"), ("Doc A1", None)]
    assert row._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2  # brackets and bold runs, not for each pair again
