"""What a layout's blocks give: captions by place, figures, pages of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import Model
from . import enrich
from .retrieval import prefixes

#: The gap in thousandths of a page that a caption may have to its figure, from the figure's lower edge down; the upper bound is outside.
LOW, HIGH = -30.0, 200.0


def captions_below(figures: DataFrame, blocks: DataFrame, *, doc: str = "document_id", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Adds near_caption to figures (doc, page, y1): the first caption of the page at or under y1 + low, if it is less than high under y1; else null.

    blocks: (doc, page, pos, y0, text); a caption begins with one of the caption words. Captions at one height: the first by pos. A null page or height counts
    as 0; a null text is no caption; a null document meets nothing. Equal figures stay as many rows; near_caption replaces a column of that name.

    Both sides are first reduced to distinct heights. Heights lie in bands as high as the reach, so a figure looks into two bands at most, and one ordered pass over
    a band finds the next caption of every height: no figure meets all captions of its page, and a page of any length is as many groups as it has bands.
    """
    height, keys = high - low, ["_doc", "_page"]
    band = lambda y: F.floor(y / height).cast("long")
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    page = F.coalesce(F.col("page").cast("long"), F.lit(0)).alias("_page")
    held = blocks.filter(T.caption_line(F.col("text"))).select(F.col(doc).alias("_doc"), page, at("y0").alias("_y"), "pos", T.trim(F.col("text")).alias("_text"))
    held = held.filter("_doc IS NOT NULL").groupBy(*keys, "_y").agg(F.min(F.struct("pos", "_text"))["_text"].alias("_text"))
    held = held.select(*keys, band(F.col("_y")).alias("_band"), "_y", F.lit(1).alias("_k"), "_text", F.lit(None).cast("double").alias("_end"))
    ends = figures.select(F.col(doc).alias("_doc"), page, at("y1").alias("_end")).filter("_doc IS NOT NULL").distinct()
    looks = ends.select(*keys, F.explode(F.sequence(band(F.col("_end") + low), band(F.col("_end") + high))).alias("_band"), (F.col("_end") + low).alias("_y"), F.lit(0).alias("_k"), F.lit(None).cast("string").alias("_text"), "_end")
    # from the band's end upwards, a caption before the figures that look from its height
    upwards = Window.partitionBy(*keys, "_band").orderBy(F.desc("_y"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_one = F.last(F.when(F.col("_k") == 1, F.struct("_y", "_text")), ignorenulls=True).over(upwards)
    seen = held.unionByName(looks).withColumn("_c", next_one).filter((F.col("_k") == 0) & (F.col("_c._y") - F.col("_end") < high))
    found = seen.groupBy(*keys, "_end").agg(F.min("_c")["_text"].alias("near_caption"))
    rest = figures.drop("near_caption")
    rows = rest.select(F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("_row"), F.col(doc).alias("_doc"), page, at("y1").alias("_end"))
    return rows.join(found, [*keys, "_end"], "left").select("_row.*", "near_caption")


#: Kinds of blocks that are figures.
FIGURES = ("image", "chart", "image_block")


def layout_figures(blocks: DataFrame, *, doc: str = "document_id", scale: float = 1000.0) -> DataFrame:
    """(doc, figure_id, type, page, box, caption) of the figures among a layout's blocks.

    blocks: (doc, page, pos, type, text, box array<double> in thousandths, image path ``image``, captions array<string>). The id is the image's name. A caption that
    came with the figure counts before one that stands below it. A figure without a box has the whole page, and looks for a caption from the page's top, as the
    place of its lower edge isn't known; one without an image is left out.
    """
    y = lambda i: F.try_element_at("box", F.lit(i))
    figures = blocks.filter(F.col("type").isin(*FIGURES) & (F.coalesce("image", F.lit("")) != "")).withColumn("y1", y(4))
    near = captions_below(figures, blocks.select(doc, "page", "pos", y(2).alias("y0"), "text"), doc=doc)
    own = F.nullif(T.trim(F.array_join("captions", " ")), F.lit(""))
    box = F.coalesce(F.transform("box", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / scale))), F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))))
    return near.select(
        doc, F.element_at(F.split("image", "/"), -1).alias("figure_id"), "type", F.coalesce(F.col("page"), F.lit(0)).alias("page"), box.alias("box"), F.coalesce(own, "near_caption").alias("caption"),
    )


def paged(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chunks with their pages, as far as the blocks' texts tell; chunks of documents without blocks keep a null page."""
    rows = chunks.withColumn("page", F.lit(None).cast("int")) if "page" not in chunks.columns else chunks
    texts = blocks.filter(T.trim(F.coalesce("text", F.lit(""))) != "").select("document_id", F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), "text")
    return enrich.assign_pages(rows, texts).filter("chunk_index IS NOT NULL")


def figures_as_chunks(chunks: DataFrame, blocks: DataFrame, tenant: str) -> DataFrame:
    """A chunk for each figure among the blocks, numbered after the document's chunks (with pages): label, kind, text of its page, key of its image, anchor.

    Figures of one name in a document are one. Their order is page, then key.
    """
    key = lambda name: T.blob_key(F.lit(tenant), F.col("document_id"), name, asset=True)
    figures = layout_figures(blocks).withColumn("asset_key", key(F.col("figure_id")))
    figures = figures.groupBy("document_id", "asset_key").agg(F.min(F.struct("page", "type", "caption")).alias("f")).select("document_id", "asset_key", "f.*")
    texts = chunks.filter("page IS NOT NULL").withColumn("_at", F.struct("document_id", "page"))
    pages = enrich.page_text(texts, page="_at").select("_at.*", "page_text")
    is_figure = F.col("type").isin(*FIGURES) & (F.coalesce("image", F.lit("")) != "")
    marked = blocks.select("document_id", "page", "pos", F.when(is_figure, "figure").otherwise("text").alias("kind"), F.when(is_figure, key(F.element_at(F.split("image", "/"), -1))).alias("id"), "text")
    anchors = enrich.anchor_figures(marked, chunks).select("document_id", F.col("figure_id").alias("asset_key"), F.col("chunk_index").alias("anchor_chunk_index"))
    anchors = anchors.groupBy("document_id", "asset_key").agg(F.min("anchor_chunk_index").alias("anchor_chunk_index"))
    last = chunks.groupBy("document_id").agg(F.max("chunk_index").alias("_last"))
    out = enrich.figure_chunks(figures, pages).join(anchors, ["document_id", "asset_key"], "left").join(last, "document_id", "left")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "asset_key"))
    return out.withColumn("chunk_index", (F.coalesce("_last", F.lit(-1)) + place).cast("int")).drop("_last")


def prefixed(chunks: DataFrame, docs: DataFrame, model: Model | None) -> DataFrame:
    """Chunks with a contextual_prefix, which a model gives for all chunks of a document in one call; empty where it fails.

    That call needs the whole document and its chunks, so a document is a group.
    """
    if model is None:
        return chunks.withColumn("contextual_prefix", F.lit(None).cast("string"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "contextual_prefix"]
    names = [f.name for f in chunks.schema if f.name != "contextual_prefix"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("chunk_index", kind="stable").reset_index(drop=True)
        left["contextual_prefix"] = prefixes(right["content"].iloc[0] or "" if len(right) else "", left["content"].fillna("").tolist(), model) if len(left) else []
        return left[[*names, "contextual_prefix"]]

    met = chunks.select(*names).groupBy("document_id").cogroup(docs.select("document_id", "content").groupBy("document_id"))
    return met.applyInPandas(run, ", ".join([*fields, "contextual_prefix string"]))
