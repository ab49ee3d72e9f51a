"""Retrieval: arms, fusion, reranking, neighbours, figures and the numbered context."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Embedder, Lru, Model, Reranker
from . import enrich, fulltext, fusion, store, vector
from .index import WordIndex


#: Fixed value: the score that a reranker must give a figure's caption.
FIGURE_FLOOR = 0.001


@dataclass
class Result:
    """Hits with place and source_no, their context as a one-row frame, and by stage the number of rows and the seconds."""

    hits: DataFrame
    context: DataFrame
    stats: dict = field(default_factory=dict)


def _timed(stats: dict, name: str, run: Callable[[], list]) -> list:
    """The rows of a stage, which are a search's few hits, as lists; its count and seconds go to the statistics, without a further job."""
    start = time.monotonic()
    rows = run()
    stats[name] = {"rows": len(rows), "seconds": round(time.monotonic() - start, 4)}
    return rows


def _together(*runs: Callable[[], list]) -> list[list]:
    """Results of several arms that run at the same time; the first error of the list is raised when all have ended."""
    with ThreadPoolExecutor(len(runs)) as pool:
        return [f.result() for f in [pool.submit(r) for r in runs]]


def _joined(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits of visible documents, with title and categories; hits are few, so they are the side that travels."""
    own = [c for c in meta.columns if c == "document_id" or c not in hits.columns]
    return meta.select(*own).join(F.broadcast(hits), "document_id").withColumn("document_title", F.col("title"))


def expand(query: str, model: Model | None, cache: Lru | None = None) -> list[str]:
    """The query and a model's paraphrases, one of each up to case and spaces; only answers that worked are cached."""
    out = [query]
    if model is not None:
        found = cache.get(query) if cache is not None else None
        if found is None:
            try:
                m = re.search(r"\[[\s\S]*\]", model(query))
                found = [str(x) for x in json.loads(m.group(0))] if m else None
            except Exception:  # noqa: BLE001 - a failed expansion leaves the query alone
                found = None
            if found is not None and cache is not None:
                cache.put(query, found)
        out += found or []
    seen: dict[str, str] = {}
    for q in out:
        key = " ".join(q.lower().split())
        if key:
            seen.setdefault(key, q)
    return list(seen.values()) or [query]


def rerank(rows: list[dict], order: Sequence[tuple[int, float]], k: int) -> list[dict]:
    """Rows in a reranker's order: unknown and repeated indexes are skipped, and what is missing is filled up in the old order with score 0."""
    out, used = [], set()
    for i, score in order:
        if isinstance(i, int) and 0 <= i < len(rows) and i not in used and len(out) < k:
            used.add(i)
            out.append(rows[i] | {"rerank_score": float(score)})
    for i, r in enumerate(rows):
        if len(out) >= k:
            break
        if i not in used:
            out.append(r | {"rerank_score": 0.0})
    return out


def parse_order(reply: str, n: int) -> list[tuple[int, float]]:
    """Indexes in a model's reply, with falling scores; none if there is no array."""
    m = re.search(r"\[[\s\S]*?\]", reply or "")
    try:
        found = json.loads(m.group(0)) if m else []
    except ValueError:
        found = []
    kept = list(dict.fromkeys(x for x in found if isinstance(x, int) and 0 <= x < n))
    return [(i, float(len(kept) - p)) for p, i in enumerate(kept)]


def _reranked(hits: DataFrame, query: str, reranker: Reranker, k: int) -> DataFrame:
    """The k best by the reranker; the pool (bounded by the fetch limit) is scored on the driver, as a model's endpoint is. Errors keep the order."""
    rows = [r.asDict() for r in hits.select("chunk_id", "content").orderBy("place").collect()]
    try:
        order = reranker.rerank(query, [r["content"] for r in rows], k)
    except Exception:  # noqa: BLE001
        order = []
    best = rerank(rows, order, k) if order else [r | {"rerank_score": None} for r in rows[:k]]
    ranks = hits.sparkSession.createDataFrame([(r["chunk_id"], i + 1, r["rerank_score"]) for i, r in enumerate(best)], "chunk_id string, place int, rerank_score double")
    return hits.drop("place", "rerank_score").join(F.broadcast(ranks), "chunk_id")


def _finish(hits: DataFrame, stats: dict) -> Result:
    numbered = fusion.number_sources(hits)
    return Result(numbered.orderBy("place"), fusion.context(numbered), stats)


def retrieve(
    chunks: DataFrame,
    documents: DataFrame,
    query: str,
    *,
    embedder: Embedder,
    max_chunks: int = 8,
    minimum: float = 0.3,
    bm25: bool = True,
    operator: str = "or",
    expander: Model | None = None,
    reranker: Reranker | None = None,
    initial: int = 20,
    scope: DataFrame | None = None,
    index: WordIndex | None = None,
    index_scope: bool = True,
    most_figures: int = 3,
    figure_floor: float = 0.2,
) -> Result:
    """Default retrieval: vector arm over all forms of the query, BM25 arm, fusion, reranking and figure rules, numbered context.

    ``documents`` are those the caller may see; chunks of others never enter an arm. With no BM25 hits the vector order stays. With a stored ``index`` the BM25 arm reads its
    lists in place of all texts; ``index_scope`` is false if the caller may see all that it holds. Arms run at the same time and once each; the statistics
    hold the rows and seconds of vector, bm25, fusion and rerank, and the number of forms.
    """
    chunks, spark, stats = _with_ids(chunks), chunks.sparkSession, {}
    fetch = max(initial, max_chunks) if reranker else max_chunks
    own = (scope if scope is not None else documents).select("document_id").distinct()
    mine = chunks.join(own, "document_id", "left_semi")
    forms = expand(query, expander)
    vectors = embedder.embed(forms)  # one call for all forms

    def by_vector() -> list:
        hits = None
        for v in vectors:
            one = vector.top_k(mine, v, fetch, minimum=minimum).select("chunk_id", "similarity")
            hits = one if hits is None else hits.unionByName(one)
        return (vector.union_of_variants(hits, fetch) if len(vectors) > 1 else hits).collect()

    runs = [lambda: _timed(stats, "vector", by_vector)]
    if bm25:
        runs.append(lambda: _timed(stats, "bm25", lambda: _words(mine, query, fetch, operator, index, index_scope)))
    near, words = (*_together(*runs), [])[:2]
    near = _frame(spark, near, "similarity")
    if words:
        ranked = _frame(spark, words, "score")
        fused = fusion.rrf([near, ranked], fetch, key="chunk_id").select("chunk_id", "place", "rrf_score")
        fused = fused.join(F.broadcast(near.select("chunk_id", "similarity")), "chunk_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    else:
        fused = near.select("chunk_id", F.col("rank").alias("place"), F.col("similarity").alias("rrf_score"), "similarity").filter(F.col("place") <= fetch)
    fused = _timed(stats, "fusion", fused.collect)
    # only the hits' own rows are read
    rows = mine.filter(F.col("chunk_id").isin([r["chunk_id"] for r in fused])).drop("embedding", "norm")
    pool = _joined(rows.join(F.broadcast(spark.createDataFrame(fused, "chunk_id string, place int, rrf_score double, similarity double")), "chunk_id"), documents)
    if reranker is not None and len(fused) > max_chunks:
        start = time.monotonic()
        pool = fusion.cap_figures(_reranked(pool, query, reranker, max_chunks), most_figures, figure_floor)
        stats["rerank"] = {"rows": min(len(fused), max_chunks), "seconds": round(time.monotonic() - start, 4)}
    return _finish(pool.filter(F.col("place") <= max_chunks), stats | {"forms": len(forms)})


def _frame(spark: SparkSession, rows: list, score: str) -> DataFrame:
    """(chunk_id, score, rank) of an arm's hits."""
    best = sorted(((r["chunk_id"], r[score]) for r in rows), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(k, v, i + 1) for i, (k, v) in enumerate(best)], f"chunk_id string, {score} double, rank int")


def _words(chunks: DataFrame, query: str, k: int, operator: str, index: WordIndex | None, scoped: bool) -> list:
    """(chunk_id, score) of the BM25 arm, k rows at most."""
    if index is None:
        found = fulltext.bm25(chunks, query, k, key="chunk_id", operator=operator)
    else:
        found = index.search(query, k, operator=operator, scope=chunks.select("chunk_id") if scoped else None).withColumnRenamed("key", "chunk_id")
    return found.select("chunk_id", "score").collect()


def _with_ids(chunks: DataFrame) -> DataFrame:
    out = chunks
    if "chunk_id" not in out.columns:
        out = out.withColumn("chunk_id", F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")))
    for c in ("section", "asset_key", "contextual_prefix", "chunk_type"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.withColumn("chunk_id", F.col("chunk_id").cast("string"))


def hybrid(
    chunks: DataFrame,
    documents: DataFrame,
    entities: DataFrame,
    query: str,
    *,
    embedder: Embedder,
    max_chunks: int = 8,
    top: int = 20,
    window: int = 1,
    vector_weight: float = 0.7,
    entity_weight: float = 0.3,
    use_entities: bool = True,
    figures: DataFrame | None = None,
    figure_limit: int = 3,
    figure_floor: float = FIGURE_FLOOR,
    reranker: Reranker | None = None,
    judge: Callable[[str, dict], str] | None = None,
) -> Result:
    """Hybrid retrieval: vector arm, entity arm seeded by its best five documents, weighted fusion, entities, neighbours, figures.

    A missing group filter is no filter, the caller's limit holds, and only the caller's documents are searched. Figures come from the hits' documents (see
    ``select_figures``). The statistics hold the rows and seconds of vector, entities, fusion, neighbours and figures.
    """
    chunks, spark, stats = _with_ids(chunks), chunks.sparkSession, {"weights": (vector_weight, entity_weight)}
    mine = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    best = _timed(stats, "vector", vector.top_k(mine, embedder.embed([query])[0], top).filter("similarity IS NOT NULL").select("chunk_id", "document_id", "similarity").collect)
    near = _frame(spark, best, "similarity")
    order = sorted(best, key=lambda r: (-r["similarity"], r["chunk_id"]))
    seeds = spark.createDataFrame([(r["document_id"],) for r in order[:5]], "document_id string")
    found = _timed(stats, "entities", enrich.entity_arm(query, entities, mine, seeds, top).collect) if use_entities and best else []
    arm = spark.createDataFrame([(r["chunk_id"], r["score"], r["rank"]) for r in found], "chunk_id string, score double, rank int")
    fused = fusion.weighted_rrf(near, arm, arm.limit(0), max_chunks, vector_weight=vector_weight, entity_weight=entity_weight, key="chunk_id")
    fused = _timed(stats, "fusion", fused.select("chunk_id", F.col("place").alias("rank"), "score").collect)
    places = spark.createDataFrame(fused, "chunk_id string, rank int, score double")
    anchors = mine.filter(F.col("chunk_id").isin([r["chunk_id"] for r in fused])).select("chunk_id", "document_id", "chunk_index").join(F.broadcast(places), "chunk_id")
    anchors = anchors.select("document_id", "chunk_index", "rank", "score").collect()
    docs = sorted({r["document_id"] for r in anchors})
    anchors = spark.createDataFrame(anchors, "document_id string, chunk_index int, rank int, score double")
    rows = fusion.neighbours(anchors, mine.filter(F.col("document_id").isin(docs)).drop("embedding", "norm"), window)
    held = _timed(stats, "neighbours", rows.select("document_id", "chunk_id", "chunk_index", "chunk_type", "asset_key", "content").collect)  # a few chunks of each hit
    rows = _joined(rows.withColumn("similarity", F.lit(0.0)), documents)
    named = entities.filter(F.col("document_id").isin(docs)).withColumnRenamed("document_id", "doc_id").withColumn("seq", F.col("entity_id"))
    rows = rows.join(enrich.top_entities(named, 5).withColumnRenamed("doc_id", "document_id"), "document_id", "left")
    if figures is not None and held:
        chosen = _timed(stats, "figures", lambda: select_figures(query, figures.filter(F.col("document_id").isin(docs)), held, limit=figure_limit, floor=figure_floor, reranker=reranker, judge=judge))
        fields = ("document_id", "chunk_id", "asset_key", "section", "content")
        listed = [(*(r[c] for c in fields), "figure", 0.0, len(held) + i + 1) for i, r in enumerate(chosen)]
        more = spark.createDataFrame(listed, ", ".join(f"{c} string" for c in (*fields, "chunk_type")) + ", similarity double, place int")
        rows = rows.unionByName(_joined(more, documents), allowMissingColumns=True)
    return _finish(rows, stats)


def select_figures(
    query: str, figures: DataFrame, held: list, *, limit: int = 3, floor: float = FIGURE_FLOOR, reranker: Reranker | None = None, judge: Callable[[str, dict], str] | None = None, pool: int = 200
) -> list[dict]:
    """Figures that go with the retrieved chunks ``held`` and aren't among them, best first, ``limit`` at most.

    Candidates are those anchored in a retrieved text or with a caption's word in query or texts; the ``pool`` best of them go to a reranker, which orders
    them by their captions and drops those under the floor. A judge then looks at the first two and keeps one. An error of the reranker leaves the order as it is.
    """
    spark = figures.sparkSession
    if limit < 1:
        return []
    anchors = spark.createDataFrame([(r["document_id"], r["chunk_index"]) for r in held if r["chunk_type"] != "figure"], "document_id string, chunk_index int")
    present = spark.createDataFrame([(r["asset_key"],) for r in held if r["asset_key"]], "asset_key string")
    met = enrich.matching_figures(query, "\n".join(r["content"] or "" for r in held), figures, anchors, present=present, limit=max(pool, limit))
    found = [r.asDict() for r in met.select("document_id", "chunk_id", "asset_key", "section", "content", "caption", "figure_score").collect()]
    if reranker is not None and found:
        try:
            order = reranker.rerank(query, [r["caption"] or "" for r in found], len(found))
            found = [r | {"rerank_score": float(v)} for i, v in order if 0 <= i < len(found) and v >= floor for r in (found[i],)]
        except Exception:  # noqa: BLE001 - as for the pool of texts
            pass
    if judge is not None and found:
        found = gate(found, lambda c: judge(query, c), whole=True)
    return found[:limit]


def by_documents(chunks: DataFrame, documents: DataFrame, ids: list[str], query: str, *, embedder: Embedder, k: int = 5, minimum: float = 0.3) -> DataFrame:
    """Search within given documents, as far as the caller may see them."""
    scope = documents.filter(F.col("document_id").isin(ids)).select("document_id")
    return _joined(vector.top_k(_with_ids(chunks), embedder.embed([query])[0], k, minimum=minimum, scope=scope).drop("embedding", "norm"), documents)


def category(chunks: DataFrame, documents: DataFrame, name: str, query: str, *, embedder: Embedder, k: int = 8, minimum: float = 0.25) -> DataFrame:
    """Search within one category."""
    scope = documents.filter(F.array_contains("categories", name)).select("document_id")
    return _joined(vector.top_k(_with_ids(chunks), embedder.embed([query])[0], k, minimum=minimum, scope=scope).drop("embedding", "norm"), documents)


def gate(candidates: list[dict], judge: Callable, *, top: int = 2, keep: int = 1, whole: bool = False) -> list[dict]:
    """The first candidates that a judge says yes to; without an answer, or for an unreadable picture, the answer is no.

    The first ``top`` are judged at the same time, by their captions or as they are (``whole``); the others go unseen.
    """

    def yes(c: dict) -> bool:
        try:
            reply = judge(c if whole else c["caption"]) if c.get("image", True) is not None else ""
            return bool(re.search(r"(?i)(?<![A-Za-z0-9_])YA(?![A-Za-z0-9_])", reply)) and not re.search(r"(?i)(?<![A-Za-z0-9_])TIDAK(?![A-Za-z0-9_])", reply)
        except Exception:  # noqa: BLE001
            return False

    seen = candidates[:top]
    if not seen:
        return []
    with ThreadPoolExecutor(len(seen)) as pool:
        answers = list(pool.map(yes, seen))
    return [c for c, ok in zip(seen, answers, strict=True) if ok][:keep]


def standalone(messages: list[tuple[str, str]], model: Model | None, *, enabled: bool = True) -> str:
    """The latest user text, rewritten to stand alone if it is short and follows others; the model sees six earlier messages of 400 characters."""
    latest = next((t for r, t in reversed(messages) if r == "user"), "")
    turns = [m for m in messages if m[0] in ("user", "assistant")]
    if not enabled or model is None or len(turns) < 2 or len(latest) >= 60 or not latest.strip():
        return latest
    at = max(i for i, m in enumerate(messages) if m == ("user", latest))
    past = [m for m in messages[:at] if m[0] in ("user", "assistant") and m[1].strip()][-6:]
    if not past:
        return latest
    try:
        reply = model("\n".join(f"{r}: {t[:400]}" for r, t in past) + f"\nuser: {latest}").strip()
    except Exception:  # noqa: BLE001
        return latest
    return reply or latest


def prefixes(document: str, chunks: list[str], model: Model | None) -> list[str]:
    """A contextual prefix for each chunk from one call; all empty if it is off, fails or gives another number."""
    if model is None:
        return [""] * len(chunks)
    try:
        m = re.search(r"\[[\s\S]*\]", model(document + "\n" + "\n".join(chunks)))
        found = [str(x) for x in json.loads(m.group(0))] if m else []
    except Exception:  # noqa: BLE001
        found = []
    return found if len(found) == len(chunks) else [""] * len(chunks)


def counters(documents: DataFrame, hits: DataFrame, now) -> DataFrame:
    return store.record_hits(documents, hits, now)
