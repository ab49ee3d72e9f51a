"""Entities and relations that a model finds, beside those of the rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..models import Model
from ..sources.parsers import repair_json
from . import calls, chunking

CONFIDENCE = 0.8
DIRECT_CHARS, PART_CHARS, RELATION_CHARS, BATCH = 16_000, 5_000, 4_000, 15


def _parts(docs: DataFrame, key: str, text: str, most: int, direct: int = 0) -> DataFrame:
    short = docs.filter(F.length(text) <= direct).select(key, F.lit(0).alias("chunk_index"), F.col(text).alias("content"))
    return short.unionByName(chunking.model_chunks(docs.filter(F.length(text) > direct), key=key, content=text, max_chars=most))


def _asked(parts: DataFrame, model: Model, key: str, tries: int, concurrent: int = 1, delay: float = 0.0) -> DataFrame:
    """(key, chunk_index, kind, name, type, source, target, confidence, seq): what the model's answers hold; a failed part has nothing.

    Each task has ``concurrent`` questions under way at most, whose starts lie ``delay`` seconds apart.
    """
    kinds = dict(parts.dtypes)
    schema = f"`{key}` {kinds[key]}, chunk_index int, kind string, name string, type string, source string, target string, confidence double, seq long"

    def ask(part: tuple):
        found = repair_json(model(part[2]))
        if found is None:
            raise ValueError("no JSON in the answer")
        return found

    def run(frames):
        for pdf in frames:
            out = []
            parts = zip(pdf[key], pdf["chunk_index"], pdf["content"], strict=True)
            for (k, i, _), found, _ in calls.in_order(parts, ask, concurrent=concurrent, delay=delay, tries=tries, wait=0.0):
                found = {"entities": found} if isinstance(found, list) else found or {}
                for n, e in enumerate(found.get("entities") or []):
                    if isinstance(e, dict) and e.get("name"):
                        out.append((k, i, "entity", str(e["name"]), str(e.get("type") or "Unknown"), None, None, float(e.get("confidence") or CONFIDENCE), i * 10_000 + n))
                for n, r in enumerate(found.get("relations") or []):
                    if isinstance(r, dict) and r.get("source") and r.get("target"):
                        out.append((k, i, "relation", None, str(r.get("type") or "RELATED_TO"), str(r["source"]), str(r["target"]), float(r.get("confidence") or CONFIDENCE), i * 10_000 + n))
            yield pd.DataFrame(out, columns=[key, "chunk_index", "kind", "name", "type", "source", "target", "confidence", "seq"])

    return parts.mapInPandas(run, schema)


def model_entities(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", tries: int = 3, concurrent: int = 1, delay: float = 0.0) -> DataFrame:
    """(key, type, name, confidence, seq): short texts at once, long ones in parts."""
    rows = _asked(_parts(docs, key, text, PART_CHARS, DIRECT_CHARS), model, key, tries, concurrent, delay).filter("kind = 'entity'")
    return rows.select(key, "type", "name", "confidence", "seq")


def hybrid_entities(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Entities of the rules and of the model, one of each type and name: the more confident, the rules' of equals."""
    rows = patterns.extract_entities(docs, key=key, text=text).withColumn("_o", F.lit(0))
    if model is not None:
        rows = rows.unionByName(model_entities(docs, model, key=key, text=text).withColumn("_o", F.lit(1)))
    rows = rows.withColumn("seq", F.col("_o") * F.lit(1 << 40) + F.col("seq")).drop("_o")
    return patterns.dedupe_entities(rows, key=key)


def combined(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", tries: int = 3, concurrent: int = 1, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Entities and relations from one answer for each part: merged across parts, relations by their entities' names, ends that are no entity dropped."""
    rows = _asked(_parts(docs, key, text, PART_CHARS), model, key, tries, concurrent, delay)
    raw = rows.filter("kind = 'entity'").select(key, "type", "name", "confidence", "seq")
    entities = patterns.merge_entities(raw, key=key)
    # of entities with one name and several types the last one names it
    names = entities.groupBy(key, F.lower(F.trim("name")).alias("_n")).agg(F.max_by("name", F.struct("seq", "type")).alias("_name"))
    a = names.withColumnsRenamed({"_n": "_s", "_name": "source_name"})
    b = names.withColumnsRenamed({"_n": "_t", "_name": "target_name"})
    rel = rows.filter("kind = 'relation'").select(key, F.lower(F.trim("source")).alias("_s"), F.lower(F.trim("target")).alias("_t"), F.col("type").alias("rel_type"), "confidence", "seq")
    rel = rel.join(a, [key, "_s"]).join(b, [key, "_t"]).select(key, F.col("source_name").alias("source"), F.col("target_name").alias("target"), "rel_type", "confidence", "seq")
    return entities, patterns.dedupe_relations(rel, key=key)


def relation_grid(docs: DataFrame, entities: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, batch, content, names): every part of a text with every batch of its own entities."""
    parts = chunking.model_chunks(docs, key=key, content=text, max_chars=RELATION_CHARS)
    listed = entities.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "name"))).alias("l"))
    batches = listed.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / BATCH).cast("int")), lambda i: F.transform(F.slice("l", i * BATCH + 1, BATCH), lambda x: x["name"]))).alias("batch", "names"))
    return parts.join(batches, key).select(key, "chunk_index", "batch", "content", "names")


def model_relations(docs: DataFrame, entities: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", tries: int = 3, concurrent: int = 1, delay: float = 0.0) -> DataFrame:
    """Relations that the model finds between the batches' entities, one of each."""
    grid = relation_grid(docs, entities, key=key, text=text)
    asked = grid.select(key, "chunk_index", F.concat(F.lit("Entities: "), F.array_join("names", ", "), F.lit("\n\n"), F.col("content")).alias("content"))
    rows = _asked(asked, model, key, tries, concurrent, delay).filter("kind = 'relation'")
    rel = rows.select(key, "source", "target", F.col("type").alias("rel_type"), "confidence", "seq")
    return patterns.dedupe_relations(rel, key=key)


def hybrid_relations(docs: DataFrame, entities: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = patterns.extract_relations(docs, entities, key=key, text=text).drop("context")
    if model is not None:
        rows = rows.unionByName(model_relations(docs, entities, model, key=key, text=text))
    return patterns.dedupe_relations(rows, key=key)


def rendered(entities: DataFrame, most: int = 10) -> DataFrame:
    """One row: the first distinct names with their types."""
    first = entities.groupBy(F.lower("name").alias("_n")).agg(F.min_by(F.struct("name", "type"), "seq").alias("e"), F.min("seq").alias("s")).orderBy("s", "_n").limit(most)
    listed = first.agg(F.sort_array(F.collect_list(F.struct("s", "_n", "e"))).alias("l"))
    return listed.select(F.array_join(F.transform("l", lambda x: F.concat(x["e"]["name"], F.lit(" ("), x["e"]["type"], F.lit(")"))), ", ").alias("entities"))
