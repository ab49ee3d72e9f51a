"""Vector search: exact top-k by cosine in double precision, in batches, and over cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_double(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, *, strict: bool = True) -> Column:
    """Cosine of two vectors; different lengths are an error (null if not strict), a zero vector gives NaN."""
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    value = F.coalesce(value, F.lit(float("nan")))
    fits = F.size(a) == F.size(b)
    return F.when(fits, value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double") if strict else F.lit(None).cast("double"))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def with_norm(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Stores each vector's length, which exact search then needn't work out again."""
    return vectors.withColumn("norm", norm(F.col(vector)))


def top_k(
    chunks: DataFrame,
    query: Sequence[float],
    k: int = 5,
    *,
    vector: str = "embedding",
    key: str = "chunk_id",
    minimum: float | None = None,
    scope: DataFrame | None = None,
    scope_key: str = "document_id",
    late_scope: bool = False,
) -> DataFrame:
    """The k chunks nearest to a query vector, nearest first, ties by key, with their similarity.

    ``scope`` (one column of ids) restricts the chunks before the cut; ``late_scope`` applies it after the cut instead, which can leave fewer
    than k. ``minimum`` is applied to the k. The cut is a top-k in each partition and one merge; no row is sorted that cannot be in it.
    """
    q = np.asarray(query, np.float64)
    size = float(np.sqrt((q**2).sum()))
    length = F.col("norm") if "norm" in chunks.columns else norm(F.col(vector))
    value = dot(F.col(vector), literal(q)) / F.nullif(length * size, F.lit(0.0))
    rows = chunks.filter(F.size(vector) == len(q))
    limited = lambda df: df.join(scope.select(F.col(scope.columns[0]).alias(scope_key)).distinct(), scope_key, "left_semi")
    if scope is not None and not late_scope:
        rows = limited(rows)
    best = rows.withColumn("similarity", value).orderBy(F.desc_nulls_last("similarity"), key).limit(k)
    if scope is not None and late_scope:
        best = limited(best)
    return best if minimum is None else best.filter(F.col("similarity") >= minimum)


def top_k_by_query(
    queries: DataFrame, vectors: DataFrame, k: int = 5, *, query_key: str = "query_id", query_vector: str = "query", key: str = "vec_id", vector: str = "embedding", skip_same: bool = False, block: int = 256
) -> DataFrame:
    """(query_key, key, similarity, rank): for each of many queries the k nearest vectors.

    A set of queries against all rows, in blocks: queries are packed into blocks of rows, each block meets each partition of the vectors once, and a matrix product with a
    local top-k leaves k rows for each query and batch to be ranked.
    """
    width = len(queries.select(query_vector).head()[0]) if queries.take(1) else 0
    blocks = queries.select(F.col(query_key).alias("qid"), F.col(query_vector).alias("qv")).withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // block)))))
    packed = blocks.groupBy("b").agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list(as_double(F.col("qv")))).alias("qvs"))
    rows = vectors.filter(F.size(vector) == width).select(F.col(key).alias("k"), as_double(F.col(vector)).alias("v"))
    # rows are packed as well, so that a block of queries is joined to blocks of vectors, not to single ones
    packs = rows.withColumn("p", F.floor(F.monotonically_increasing_id() / 1024)).groupBy("p").agg(F.collect_list("k").alias("ks"), F.flatten(F.collect_list("v")).alias("vs"))
    met = packs.crossJoin(packed)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                take = lambda c, row=row: np.asarray(row.column(c)[0].values.to_numpy(zero_copy_only=False))
                ks, qids = take("ks"), take("qids")
                v, q = take("vs").reshape(-1, width), take("qvs").reshape(-1, width)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (q @ v.T) / (np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((v**2).sum(axis=1))[None, :])
                s[~np.isfinite(s)] = -np.inf
                if skip_same:
                    s[qids[:, None] == ks[None, :]] = -np.inf
                near = np.sort(s, axis=1)[:, -min(k, s.shape[1]) - 0][:, None] - 1e-9  # ties at the cut all go on
                qi, vi = np.nonzero((s >= near) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(qids[qi]), pa.array(ks[vi]), pa.array(s[qi, vi])], names=["q", "k", "s"])

    found = met.mapInArrow(run, "q long, k long, s double")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "k")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key), F.col("s").alias("similarity"), F.col("rank").cast("int").alias("rank"))


def union_of_variants(hits: DataFrame, k: int, *, key: str = "chunk_id", minimum: float | None = None) -> DataFrame:
    """Hits of several forms of one query as one list: threshold for each hit, the best similarity of each id, cut."""
    rows = hits if minimum is None else hits.filter(F.col("similarity") >= minimum)
    rest = [c for c in rows.columns if c not in (key, "similarity")]
    best = rows.groupBy(key).agg(F.max("similarity").alias("similarity"), *[F.max_by(c, "similarity").alias(c) for c in rest])
    return best.orderBy(F.desc("similarity"), key).limit(k).select(*rows.columns)


# -- cells ------------------------------------------------------------------------------------------


def build_cells(vectors: DataFrame, cells: int = 16, *, vector: str = "embedding", sample: int = 20_000, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Adds the nearest of ``cells`` centres to every vector; centres are fitted on a bounded sample of unit vectors, and every row is assigned."""
    rows = vectors.select(F.xxhash64(vector).alias("h"), as_double(F.col(vector)).alias("v")).filter(norm(F.col("v")) > 0).orderBy("h").limit(sample).collect()
    if not rows:
        return vectors.withColumn("cell", F.lit(0)), np.zeros((1, 1))
    x = np.array([r["v"] for r in rows])
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        near = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                m = x[near == c].mean(axis=0)
                centres[c] = m / max(np.sqrt((m**2).sum()), 1e-12)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series((np.stack(v.to_numpy()).astype(np.float64) @ centres.T).argmax(axis=1) if len(v) else [], dtype="int32")

    return vectors.withColumn("cell", cell(F.col(vector))), centres


def cell_top_k(celled: DataFrame, centres: np.ndarray, query: Sequence[float], k: int = 5, *, probes: int = 4, **options) -> DataFrame:
    """Approximate top-k: exact scores within the cells nearest to the query, which partition pruning reads alone."""
    near = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")[:probes]
    return top_k(celled.filter(F.col("cell").isin([int(c) for c in near])), query, k, **options)


def drift(chunks: DataFrame, current: str, model: str = "embedding_model") -> DataFrame:
    """Chunks by the model that embedded them, and whether those are stale."""
    return chunks.groupBy(model).agg(F.count("*").alias("chunks")).withColumn("stale", ~F.col(model).eqNullSafe(F.lit(current)))


def stale_documents(chunks: DataFrame, current: str, model: str = "embedding_model") -> DataFrame:
    return chunks.filter(~F.col(model).eqNullSafe(F.lit(current))).select("document_id").distinct()


def embedding_text(title: Column, content: Column) -> Column:
    return F.concat_ws("\n\n", title, content)


def embedding_text_with_header(category: Column, subcategory: Column, section: Column, prefix: Column, content: Column) -> Column:
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Category", category), line("Topic", subcategory), line("Section", section), line("Context", prefix), content)
