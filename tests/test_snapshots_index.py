"""Tables under several writers, and the stored word index against BM25 over all rows."""

import threading

import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import fulltext, index, snapshots

SCHEMAS = {"t": "id string, n long"}


def rows(spark, *ids):
    return spark.createDataFrame([(i, len(i)) for i in ids], "id string, n long")


def ids(tables):
    return sorted(r["id"] for r in tables.read("t").collect())


def test_deletes_hold_for_what_stands_before(spark, tmp_path):
    t = snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS)
    assert ids(t) == []
    t.append("t", rows(spark, "a", "b", "c"))
    before = {p.name for p in tmp_path.glob("x/t/in_folder=*")}
    t.delete("t", rows(spark, "b", "zz").select("id"), "id")
    new = [p for p in tmp_path.glob("x/t/in_folder=*") if p.name not in before]
    assert len(new) == 1 and spark.read.parquet(f"file://{new[0]}").columns == ["key"]  # only the ids were written
    t.append("t", rows(spark, "b", "d"))
    assert ids(t) == ["a", "b", "c", "d"]
    t.delete("t", spark.createDataFrame([(1,)], "n long"), "n")
    assert ids(t) == []


def test_writers_at_once_both_count(spark, tmp_path):
    t = snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS)
    t.append("t", rows(spark, "a", "b"))
    number, entries = t.listed("t")
    other = snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS)
    other.append("t", rows(spark, "c"))
    with pytest.raises(snapshots.Conflict):
        t.replace("t", rows(spark, "z"), number)
    seen = []

    def change(df):
        if not seen:  # another writer comes in between
            other.append("t", rows(spark, "d"))
        seen.append(1)
        return df.withColumn("id", F.upper("id"))

    t.update("t", change)
    assert len(seen) == 2 and ids(t) == ["A", "B", "C", "D"]
    threads = [threading.Thread(target=lambda i=i: snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS).append("t", rows(spark, f"w{i}"))) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert ids(t) == ["A", "B", "C", "D", "w0", "w1", "w2", "w3"]


def test_compaction_bounds_folders_and_keeps_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_ENTRIES", 6)
    t = snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS)
    for i in range(20):
        t.append("t", rows(spark, f"r{i}"))
        assert len(t.listed("t")[1]) <= 7
    t.delete("t", rows(spark, "r3").select("id"), "id")
    t.append("t", rows(spark, "r3", "r30"))
    # a large folder stays where it is, with the deletions after it
    monkeypatch.setattr(snapshots, "SMALL_BYTES", 0)
    t.delete("t", rows(spark, "r4").select("id"), "id")
    t.delete("t", rows(spark, "r5").select("id"), "id")
    want = sorted([f"r{i}" for i in range(20) if i not in (4, 5)] + ["r30"])
    assert ids(t) == want
    large = [e for e in t.listed("t")[1] if e.by is None]
    assert t.compact("t")
    now = t.listed("t")[1]
    assert [e for e in now if e.by is None] == large and ids(t) == want
    monkeypatch.setattr(snapshots, "SMALL_BYTES", 64 << 20)
    assert t.compact("t") and len(t.listed("t")[1]) == 1 and ids(t) == want
    assert t.vacuum("t") == 0 and t.vacuum("t", seconds=0) > 0 and ids(t) == want


def test_a_list_without_its_last_line_is_not_read(spark, tmp_path):
    t = snapshots.Tables(spark, f"file://{tmp_path}/x", SCHEMAS)
    t.append("t", rows(spark, "a"))
    (tmp_path / "x/t/_lists/000000000099").write_text('{"folder": "half"')
    assert ids(t) == ["a"]


TEXTS = ["the house of cards", "a house", "houses and the garden of the house", "", None, "garden gardens gardening", "THE the the", "of of of", "x" * 5000 + " house", "the house of cards"]


def test_index_equals_bm25_over_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 8)
    texts = [(f"k{i:03d}", TEXTS[i % len(TEXTS)] and TEXTS[i % len(TEXTS)] + f" n{i % 17}" * (i % 5)) for i in range(120)]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string").withColumn("len", F.lit("clash"))
    words = index.WordIndex(spark, f"file://{tmp_path}/w")
    assert words.search("house").collect() == []
    part = F.substring("chunk_id", 4, 1).cast("int")
    words.add(chunks.filter(part < 5))
    words.add(chunks.filter(part >= 5))

    def same(left, query, k, operator):
        got = [tuple(r) for r in words.search(query, k, operator=operator).collect()]
        assert got == [tuple(r) for r in fulltext.bm25(left, query, k, key="chunk_id", operator=operator, stem=True).collect()]
        return got

    assert len(same(chunks, "the house", 7, "or")) == 7
    gone = chunks.filter("chunk_id < 'k030'")
    words.remove(gone.select("chunk_id"))
    left = chunks.join(gone, "chunk_id", "left_anti")
    for operator in ("and", "or"):
        same(left, "the gardens of houses n3", 10, operator)
    assert same(left, "zzzz", 5, "or") == [] == same(left, " ", 5, "or")
    words.add(gone)
    same(chunks, "house n4", 500, "or")
    words.compact()
    same(chunks, "house n4 cards", 5, "or")
    scope = chunks.filter("chunk_id like 'k09%'").select("chunk_id")
    found = [r["key"] for r in words.search("house", 50, scope=scope).collect()]
    assert found and all(k.startswith("k09") for k in found)


def test_search_reads_its_terms_buckets_alone(spark, tmp_path):
    words = index.WordIndex(spark, f"file://{tmp_path}/w")
    words.add(spark.createDataFrame([(str(i), f"word{i} common") for i in range(200)], "chunk_id string, content string"))
    plan = words._rows(["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    read = words._rows(["common"]).select(F.input_file_name().alias("f")).distinct().count()
    assert read == 1


def shuffled(spark):
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(spark._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_building_moves_texts_and_lists_once(spark, tmp_path):
    """What a delta shuffles stays near the size of its texts."""
    chunks = spark.range(3000).select(F.col("id").cast("string").alias("chunk_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(3000))))).alias("content"))
    size = chunks.agg(F.sum(F.length("content"))).first()[0]
    before = shuffled(spark)
    words = index.WordIndex(spark, f"file://{tmp_path}/w", stem=False)
    words.add(chunks)
    moved = shuffled(spark) - before
    assert moved < 3.5 * size
    assert [tuple(r) for r in words.search("w1 w2", 9).collect()] == [tuple(r) for r in fulltext.bm25(chunks, "w1 w2", 9, key="chunk_id", operator="or").collect()]
