"""The graph of entities: relations as edges, traversal by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hop(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    back = edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def traverse(edges: DataFrame, starts: DataFrame, *, depth: int = 1, direction: str = "out", rel_type: str | None = None) -> DataFrame:
    """(start, node): what lies exactly ``depth`` edges from each start; one join for each edge."""
    edges = edges if rel_type is None else edges.filter(F.col("rel_type") == rel_type)
    hop, at = _hop(edges, direction), starts.select("start", F.col("start").alias("node")).distinct()
    for _ in range(depth):
        at = at.join(hop, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
    return at


def related(edges: DataFrame, entity: str, *, rel_types: list[str] | None = None, direction: str = "both", limit: int = 50) -> DataFrame:
    """(direction, rel_type, node, other columns) of an entity's edges, at most ``limit`` for each direction, most confident first."""
    rows = edges if rel_types is None else edges.filter(F.col("rel_type").isin(rel_types))
    order = ([F.desc("confidence")] if "confidence" in rows.columns else []) + ["rel_type", "node"]
    sides = []
    for name, own, other in (("out", "src", "dst"), ("in", "dst", "src")):
        if direction in (name, "both"):
            side = rows.filter(F.col(own) == entity).withColumn("direction", F.lit(name)).withColumnRenamed(other, "node").drop(own)
            sides.append(side.orderBy(*order).limit(limit))
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def link(relations: DataFrame, entities: DataFrame, *, doc: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """Edges between entity ids, found by lower-case names; and the relations left over because an end is unknown."""
    known = entities.select(doc, F.lower("name").alias("_n"), "entity_id").dropDuplicates([doc, "_n"])
    a = known.withColumnsRenamed({"_n": "_s", "entity_id": "src"})
    b = known.withColumnsRenamed({"_n": "_t", "entity_id": "dst"})
    rows = relations.withColumns({"_s": F.lower("source"), "_t": F.lower("target")})
    both = rows.join(a, [doc, "_s"], "left").join(b, [doc, "_t"], "left").drop("_s", "_t")
    found = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return both.filter(found), both.filter(~found).drop("src", "dst")
