"""What is added to chunks: pages, figures and their contexts, entities, histories."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .names import names_in_own_text, names_in_text


def history(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", text: str = "text", most: int = 6, glue: str = " | ") -> DataFrame:
    """(key, order, history): the last messages before each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-most, -1)
    return turns.select(key, order, F.array_join(F.collect_list(text).over(w), glue).alias("history"))


def top_entities(entities: DataFrame, most: int = 5, *, key: str = "doc_id") -> DataFrame:
    """(key, entities): the most confident ones of each document, in order."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "seq")
    best = entities.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    listed = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "name", "type", "confidence"))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["confidence"].alias("confidence"))).alias("entities"))


def entity_arm(query: str, entities: DataFrame, chunks: DataFrame, seeds: DataFrame, k: int, *, most: int = 2000) -> DataFrame:
    """(chunk_id, score, rank): chunks of the seed documents by the share of the query's entities that they name.

    Entities are those of the seed documents (``most`` of them, in a fixed order) whose names are in the query; a name counts as often as it is listed.
    """
    docs = seeds.select("document_id").distinct()
    named = entities.join(docs, "document_id", "left_semi").orderBy("document_id", "entity_id").limit(most)
    named = named.filter(F.contains(F.lit(query.lower()), F.lower("name")) & (F.col("name") != "")).select(F.lower("name").alias("n"))
    listed = named.agg(F.collect_list("n").alias("names"))  # ``most`` names at most
    rows = chunks.join(docs, "document_id", "left_semi").crossJoin(F.broadcast(listed)).filter(F.size("names") > 0)
    met = F.size(F.filter("names", lambda n: F.contains(F.lower("content"), n)))
    scored = rows.withColumn("score", met / F.size("names")).filter("score > 0").orderBy("document_id", "chunk_index").limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "document_id", "chunk_index"))).select("chunk_id", "score", "rank")


# -- pages -------------------------------------------------------------------------------------------------


def page_text(chunks: DataFrame, *, page: str = "page", order: str = "chunk_index", content: str = "content", limit: int = 1200) -> DataFrame:
    """(page, page_text): texts of a page in order, until there are ``limit`` characters."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.withColumn("_b", F.coalesce(F.sum(F.length(content) + 1).over(w), F.lit(0)) - 1).filter(F.col("_b") < limit)
    listed = before.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(content).alias("c")))).alias("l"))
    return listed.select(page, F.array_join(F.transform("l", lambda x: x["c"]), " ").alias("page_text"))


def figure_context(figures: DataFrame, pages: DataFrame, *, page: str = "page", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds context: text of the figure's page, else of the next, else of the one before; empty texts count as missing."""
    out, parts = figures, []
    for n, shift in (("_0", 0), ("_1", 1), ("_2", -1)):
        side = pages.select(*by, (F.col(page) - shift).alias(page), F.nullif(F.col("page_text"), F.lit("")).alias(n))
        out = out.join(side, [*by, page], "left")
        parts.append(F.col(n))
    return out.withColumn("context", F.coalesce(*parts, F.lit(""))).drop("_0", "_1", "_2")


def _norm(s: str) -> str:
    return " ".join(re.sub(r"[`*#>|_~\[\]()!\-]", " ", s.lower()).split())


def pages_of(chunks: list[tuple[str, int | None]], blocks: list[tuple[int, str]]) -> list[int | None]:
    """Page of each chunk, in order: a cursor moves over the page's blocks and wraps around; what isn't found keeps the page before."""
    known = [(p, n) for p, n in ((p, _norm(t or "")) for p, t in blocks) if len(n) >= 10]
    at, last, out = 0, None, []
    for content, page in chunks:
        if page is not None:
            last = page
            out.append(page)
            continue
        key = _norm(content or "")[:24]
        if known and len(key) >= 10:
            for i in [*range(at, len(known)), *range(at)]:
                n = known[i][1]
                if key in n or n[:24] in key:
                    at, last = i, known[i][0]
                    break
        out.append(last)
    return out


def assign_pages(chunks: DataFrame, blocks: DataFrame, *, doc: str = "document_id") -> DataFrame:
    """Chunks with their pages; sequential within a document, so a document is a group."""
    schema = chunks.schema

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("chunk_index", kind="stable").reset_index(drop=True)
        right = right.sort_values("page", kind="stable")
        own = [None if pd.isna(p) else int(p) for p in left["page"]]
        found = pages_of(list(zip(left["content"], own, strict=True)), list(zip(right["page"].astype(int), right["text"], strict=True)))
        left["page"] = pd.array(found, dtype="Int32")
        return left[[f.name for f in schema]]

    return chunks.groupBy(doc).cogroup(blocks.select(doc, "page", "text").groupBy(doc)).applyInPandas(run, schema)


# -- figures -------------------------------------------------------------------------------------------------


def anchor_figures(blocks: DataFrame, chunks: DataFrame, *, doc: str = "document_id") -> DataFrame:
    """(doc, figure_id, chunk_index): the text chunk that a figure stands in.

    On its page a figure goes with the nearest block of text before it (25 characters, four words). The first chunk that holds the longest beginning of that
    text, of 10 words down to 4, is its anchor; without one there is no row.
    """
    prose = F.when((F.col("kind") == "text") & (F.length(T.trim(F.col("text"))) >= 25), T.collapse(F.lower("text")))
    w = Window.partitionBy(doc, "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    figures = blocks.withColumn("_p", F.last(prose, ignorenulls=True).over(w)).filter((F.col("kind") == "figure") & F.col("id").isNotNull() & F.col("_p").isNotNull())
    words = F.split("_p", " ")
    figures = figures.withColumn("_w", words).filter(F.size("_w") >= 4)
    heads = figures.select(doc, F.col("id").alias("figure_id"), F.explode(F.sequence(F.lit(4), F.least(F.lit(10), F.size("_w")))).alias("_n"), "_w")
    heads = heads.withColumn("_h", F.array_join(F.slice("_w", 1, F.col("_n")), " ")).drop("_w")
    texts = chunks.filter(~F.coalesce(F.col("chunk_type") == "figure", F.lit(False))).select(doc, "chunk_index", T.collapse(F.lower("content")).alias("_c"))
    met = heads.join(texts, doc).filter(F.contains("_c", "_h"))
    return met.groupBy(doc, "figure_id").agg(F.min_by("chunk_index", F.struct(-F.col("_n"), "chunk_index")).alias("chunk_index"))


def figure_chunks(figures: DataFrame, pages: DataFrame, *, doc: str = "document_id") -> DataFrame:
    """A chunk for each figure: ``[kind] label`` and the text around it; caption, or else a label from that text."""
    rows = figure_context(figures, pages, by=(doc,))
    caption = F.nullif(T.trim(F.col("caption")), F.lit(""))
    label = F.coalesce(caption, T.label_of(F.col("context")), F.concat(F.lit("Figure on page "), F.col("page").cast("string")))
    kind = T.figure_kind(F.col("type"))
    return rows.select(
        doc, "page", "asset_key", label.alias("section"), F.lit("figure").alias("chunk_type"), kind.alias("figure_type"),
        F.concat_ws("\n", F.concat(F.lit("["), kind, F.lit("] "), label), F.nullif(F.col("context"), F.lit(""))).alias("content"),
    )


def matching_figures(query: str, retrieved: str, figures: DataFrame, anchors: DataFrame, *, present: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """Figures that belong to an answer, best first: anchored in a hit 3, a caption's word in the query 2, in the retrieved text 1.

    figures: document_id, chunk_id, asset_key, section, content, anchor_chunk_index; anchors: (document_id, chunk_index) of the hits. Of equal captions the first is kept.
    """
    rows = figures.filter(F.coalesce("asset_key", F.lit("")) != "")
    if present is not None:
        rows = rows.join(present.select("asset_key").distinct(), "asset_key", "left_anti")
    hit = anchors.select("document_id", F.col("chunk_index").alias("anchor_chunk_index")).distinct().withColumn("_a", F.lit(True))
    caption = F.coalesce(F.nullif(F.col("section"), F.lit("")), T.strip_bracket(F.col("content")))
    rows = rows.join(F.broadcast(hit), ["document_id", "anchor_chunk_index"], "left").withColumn("caption", caption)
    words = T.caption_keywords(F.col("caption"))
    found = lambda s: F.exists(words, lambda w: F.contains(F.lit(s.lower()), F.lower(w)))
    score = F.when(F.col("_a"), 3).when(T.caption_meaningful(F.col("caption")), F.when(found(query), 2).when(found(retrieved), 1).otherwise(0)).otherwise(0)
    rows = rows.withColumn("figure_score", score).filter("figure_score > 0")
    first = Window.partitionBy(F.lower("caption")).orderBy("document_id", "chunk_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) | (F.col("caption") == ""))
    return rows.drop("_n", "_a").orderBy(F.desc("figure_score"), "document_id", "chunk_id").limit(limit)


def vlm_figures(rows: DataFrame, types: list[str], limit: int = 3) -> DataFrame:
    """(asset_key, source_no): figures of the wanted kinds by the first source that names them."""
    want = [t.strip().lower() for t in types]
    kind = F.lower(F.regexp_extract("content", r"^\[([^\]]+)\]", 1))
    ok = F.lit(True) if {"figure", "image"} & set(want) else kind.isin(want)
    hit = rows.filter((F.col("chunk_type") == "figure") & (F.coalesce("asset_key", F.lit("")) != "") & ok)
    return hit.groupBy("asset_key").agg(F.min("source_no").alias("source_no")).orderBy("source_no", "asset_key").limit(limit)
