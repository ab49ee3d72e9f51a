"""Fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def ranked(rows: DataFrame, *order, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds places from 1 by a total order; over the rows of each query, if ``by`` names what tells queries apart. Without it the rows must be one search's."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def rrf(lists: list[DataFrame], limit: int | None = None, *, key: str = "id", rank: str = "rank", k: int = K, digits: int = 12) -> DataFrame:
    """(key, rrf_score, sources, place): sum over the lists of 1 / (k + rank), ranks from 1.

    Ties keep the order in which ids first occur, list by list. Lists are short (a search's hits), so places are worked out over all of them.
    """
    tagged = [d.select(key, F.col(rank).cast("long").alias("_r"), F.lit(i).alias("_l")) for i, d in enumerate(lists)]
    if not tagged:
        raise ValueError("no lists")
    every = reduce(DataFrame.unionByName, tagged)
    fused = every.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("_r"))), digits).alias("rrf_score"), F.sort_array(F.collect_list("_l")).alias("sources"), F.min(F.struct("_l", "_r")).alias("_first")
    )
    out = fused.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "_first", key))).drop("_first")
    return out if limit is None else out.filter(F.col("place") <= limit)


def weighted_rrf(vector: DataFrame, entity: DataFrame, graph: DataFrame, limit: int, *, vector_weight: float = 0.7, entity_weight: float = 0.3, key: str = "id", rank: str = "rank", k: int = K, digits: int = 12) -> DataFrame:
    """Weighted fusion of three arms with their ranks; what the weights leave is the graph's. Absent arms count nothing."""
    weights = (vector_weight, entity_weight, 1 - vector_weight - entity_weight)
    names = ("vector_rank", "entity_rank", "graph_rank")
    arms = [d.select(key, F.col(rank).cast("long").alias(n)) for d, n in zip((vector, entity, graph), names, strict=True)]
    both = arms[0].join(arms[1], key, "full_outer").join(arms[2], key, "full_outer")
    parts = [F.coalesce(w / (k + F.col(n)), F.lit(0.0)) for w, n in zip(weights, names, strict=True)]
    scored = both.withColumn("score", F.round(parts[0] + parts[1] + parts[2], digits))
    last = F.lit(1 << 40)
    order = Window.orderBy(F.desc("score"), *[F.coalesce(F.col(n), last) for n in names], key)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def pool(vector: DataFrame, text: DataFrame, *, key: str = "id") -> DataFrame:
    """Hits of both searches, those of the vector search first where both have one; text hits have no similarity."""
    more = text.join(vector.select(key), key, "left_anti")
    for c in vector.columns:
        if c not in more.columns:
            more = more.withColumn(c, F.lit(0.0 if c == "similarity" else None).cast(vector.schema[c].dataType))
    return vector.unionByName(more.select(*vector.columns))


def number_sources(rows: DataFrame, *, place: str = "place") -> DataFrame:
    """source_no: dense numbers by first appearance of the asset key, or of title and section."""
    asset = F.when(F.coalesce("asset_key", F.lit("")) != "", F.concat(F.lit("asset:"), "asset_key")) if "asset_key" in rows.columns else F.lit(None)
    key = F.coalesce(asset, F.concat_ws("-", F.coalesce("document_title", F.lit("")), F.coalesce("section", F.lit(""))))
    first = rows.withColumn("_key", key).withColumn("_first", F.min(place).over(Window.partitionBy("_key")))
    return first.withColumn("source_no", F.dense_rank().over(Window.orderBy("_first"))).drop("_key", "_first")


def context(rows: DataFrame, *, place: str = "place") -> DataFrame:
    """One row with the text of all hits: numbered title and section, prefix, content, in order."""
    title = F.concat_ws(" — ", "document_title", F.when(F.coalesce("section", F.lit("")) != "", F.col("section")))
    head = F.concat(F.lit("["), F.col("source_no").cast("string"), F.lit("] "), title)
    prefix = F.when(F.coalesce("contextual_prefix", F.lit("")) != "", F.concat(F.col("contextual_prefix"), F.lit("\n\n"))) if "contextual_prefix" in rows.columns else F.lit("")
    block = F.concat(head, F.lit("\n"), F.coalesce(prefix, F.lit("")), "content")
    listed = rows.select(F.struct(F.col(place).alias("p"), block.alias("b")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("l"))
    return listed.select(F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def cap_figures(rows: DataFrame, most: int = 3, floor: float = 0.2, *, place: str = "place", score: str = "rerank_score", by: tuple[str, ...] = ()) -> DataFrame:
    """All texts, and in order up to ``most`` figures that reach the floor, of each query (``by``); a figure without a score passes it."""
    figure = F.coalesce(F.col("chunk_type") == "figure", F.lit(False))
    ok = figure & (F.col(score).isNull() | (F.col(score) >= floor))
    run = F.sum(ok.cast("int")).over(Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_n", run).filter(~figure | (ok & (F.col("_n") <= most))).drop("_n")


def neighbours(anchors: DataFrame, chunks: DataFrame, window: int = 1, *, doc: str = "document_id", index: str = "chunk_index", rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Anchors and the chunks up to ``window`` before and after them, in reading order within each anchor's group; adds place and is_anchor.

    A chunk near several anchors goes with the best of them; an anchor keeps its own rank. ``by`` names columns of the anchors that tell queries apart: each has its own places.
    """
    part = Window.partitionBy(*by)
    by = tuple(c for c in by if c != doc)
    near = anchors.select(*by, doc, F.col(rank).alias("_g"), F.explode(F.sequence(F.col(index) - window, F.col(index) + window)).alias(index))
    best = near.groupBy(*by, doc, index).agg(F.min("_g").alias("_g"))
    own = anchors.select(*by, doc, index, F.col(rank).alias("_own"))
    rows = chunks.join(best, [doc, index]).join(own, [*by, doc, index], "left").withColumn("_g", F.coalesce("_own", "_g"))
    order = part.orderBy("_g", doc, index)
    return rows.withColumns({"place": F.row_number().over(order), "is_anchor": F.col("_own").isNotNull()}).drop("_g", "_own")
