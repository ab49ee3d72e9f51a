"""The stored vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import cells, vector


def frame(spark, n=3000, width=20, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = centres[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, width))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    hard = [(n, None), (n + 1, [0.0] * width), (n + 2, [1.0]), (n + 3, [float("nan")] * width), (n + 4, [None] * width), (n + 5, rows[0][1]), (n + 6, [])]
    return x, spark.createDataFrame(rows + hard, "chunk_id long, embedding array<double>").repartition(4)


def test_recall_and_pruning(spark, tmp_path):
    x, table = frame(spark)
    index = cells.VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(table, cells=16)
    found = wanted = 0
    for i in range(0, 300, 20):
        want = [r["chunk_id"] for r in vector.top_k(table.filter("size(embedding) = 20 AND chunk_id < 3000"), list(x[i]), 10).collect()]
        got = index.search(list(x[i]), 10, probes=4).collect()
        assert [r["similarity"] for r in got] == sorted((r["similarity"] for r in got), reverse=True)
        found += len(set(want) & {r["key"] for r in got})
        wanted += len(want)
    assert found / wanted >= 0.9
    first = [r["key"] for r in index.search(list(x[0]), 2).collect()]
    assert first == [0, 3005]  # equal vectors, by key; null, zero and odd ones are nowhere
    plan = index.candidates(list(x[0]), 10, probes=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]
    assert index.candidates(list(x[0]), 10, probes=4).select("cell").distinct().count() <= 4


def test_scope_and_fallback(spark, tmp_path):
    x, table = frame(spark, n=400)
    table = table.filter("size(embedding) = 20 AND chunk_id < 400")
    index = cells.VectorIndex(spark, f"file://{tmp_path}/v")
    with pytest.raises(ValueError):
        index.search(list(x[0]), 3)
    exact = lambda scope=None: [(r["chunk_id"], round(r["similarity"], 9)) for r in vector.top_k(table, list(x[7]), 10, scope=scope, scope_key="chunk_id").collect()]
    rows = lambda df: [(r["key"], round(r["similarity"], 9)) for r in df.collect()]
    assert rows(index.search(list(x[7]), 10, table=table)) == exact()  # no index yet
    index.build(table, cells=8)
    scope = table.filter("chunk_id % 50 = 0").select("chunk_id")  # eight rows, fewer than are wanted
    assert rows(index.search(list(x[7]), 10, probes=1, scope=scope, table=table)) == exact(scope)
    assert len(index.search(list(x[7]), 10, probes=1, scope=scope).collect()) < 10
    wide = table.filter("chunk_id % 2 = 0").select("chunk_id")
    assert rows(index.search(list(x[7]), 10, probes=8, scope=wide)) == exact(wide)


def test_over_fetch():
    assert [cells.over_fetch(k) for k in (1, 20, 50, 1000)] == [100, 100, 250, 2000]


def test_whole_search_loses_none(spark, tmp_path):
    """Vectors without any groups, which the codes tell apart badly."""
    from sparrowdex.plans import catalog

    x = np.random.default_rng(8).normal(size=(4000, 64)).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    score = unit @ unit[0]
    want = sorted((i for i in range(4000) if i % 5 in (1, 2, 3)), key=lambda i: (-score[i], i))[:10]
    assert [r["vec_id"] for r in catalog.queries()["vec_index_scoped"](spark, str(tmp_path)).collect()] == want
