"""The facade: a knowledge base of one tenant over tables in a folder."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Registry, Settings
from .functions import patterns
from .functions import text as T
from .models import Embedder, HashEmbedder, Model, OverlapReranker, Reranker
from .operators import calls, chunking, graph, index, placement, retrieval, snapshots, store, vector
from .sources import files
from .streaming import jobs

DOCUMENTS = "id string, tenant_id string, title string, categories array<string>, filename string, content string, status string, metadata map<string,string>, created_at timestamp, deleted_at timestamp, retrieval_count long, last_retrieved_at timestamp"
TABLES = {
    "documents": DOCUMENTS,
    "chunks": "chunk_id string, document_id string, tenant_id string, chunk_index int, content string, chunk_type string, section string, page int, asset_key string, anchor_chunk_index int, contextual_prefix string, embedding array<float>, embedding_model string",
    "entities": "entity_id string, document_id string, type string, name string, confidence double, seq long",
    "relations": "document_id string, src string, dst string, rel_type string, confidence double, context string",
    "document_groups": "document_id string, knowledge_base_id string",
    "knowledge_bases": "id string, tenant_id string, name string, created_at timestamp",
    "ingest_jobs": "id string, tenant_id string, document_id string, blob_key string, status string, attempt int, step string, progress int, error string, created_at timestamp, updated_at timestamp",
    "retrievals": "document_id string, retrieval_id string, tenant_id string, at timestamp",
    "api_keys": "hash string, tenant_id string, name string, scopes array<string>, knowledge_base_ids array<string>, revoked_at timestamp",
}


#: The scopes of keys.
READ, WRITE = "kb:read", "kb:write"
OLDER = {READ: ("read", "search"), WRITE: ("ingest",)}


@dataclass
class Key:
    tenant: str
    scopes: list[str] = field(default_factory=list)
    knowledge_bases: list[str] = field(default_factory=list)

    def require(self, scope: str) -> None:
        """No scopes means all of them. The narrower names of older keys count as well."""
        if self.scopes and not {scope, *OLDER.get(scope, ())} & set(self.scopes):
            raise PermissionError(f"the key lacks {scope}")

    def narrowed(self, wanted: list[str] | None) -> list[str] | None:
        """Groups that a request may see: no list at all is no limit; an empty list sees nothing."""
        if not self.knowledge_bases:
            return wanted or None
        return [k for k in wanted if k in self.knowledge_bases] if wanted else list(self.knowledge_bases)


def mint_key() -> tuple[str, str]:
    """A new key, and the hash that is all that is kept of it."""
    key = "kb_" + secrets.token_urlsafe(32)
    return key, hash_key(key)


def hash_key(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


class Tables(snapshots.Tables):
    """The tables of all tenants in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, TABLES)


#: Rerankers by name; a deployment adds its own.
RERANKERS = Registry(overlap=OverlapReranker)


class KnowledgeBase:
    """One tenant's documents: ingest, search, listing, deletion and jobs.

    Settings say what is on and how far it goes; a reranker, an expander or a contextualizer that is passed in is on. ``judge`` looks at figures (query, candidate).
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        key: Key,
        *,
        embedder: Embedder | None = None,
        reranker: Reranker | None = None,
        expander: Model | None = None,
        contextualizer: Model | None = None,
        judge: Callable[[str, dict], str] | None = None,
        settings: Settings | None = None,
    ):
        if not key.tenant:
            raise PermissionError("no tenant in scope")
        self.spark, self.tables, self.key = spark, Tables(spark, root), key
        self.embedder, self.reranker, self.expander = embedder or HashEmbedder(64), reranker, expander
        self.contextualizer, self.judge, self.settings = contextualizer, judge, settings or Settings()
        #: The tenant's own word index, so its counts are those of its chunks alone.
        self.words = index.WordIndex(spark, f"{root.rstrip('/')}/words/{hash_key(key.tenant)}")

    @classmethod
    def from_key(cls, spark: SparkSession, root: str, secret: str, **options) -> KnowledgeBase:
        """Opens a knowledge base by a key; unknown and revoked keys are refused."""
        want = hash_key(secret)
        rows = Tables(spark, root).read("api_keys").filter((F.col("hash") == want) & F.col("revoked_at").isNull()).take(1)
        if not rows or not hmac.compare_digest(rows[0]["hash"], want):
            raise PermissionError("unknown key")
        return cls(spark, root, Key(rows[0]["tenant_id"], list(rows[0]["scopes"] or []), list(rows[0]["knowledge_base_ids"] or [])), **options)

    # -- documents

    def _documents(self, groups: list[str] | None = None, category: str | None = None) -> DataFrame:
        return store.alive(self.tables.read("documents"), self.key.tenant, category=category, groups=groups, document_groups=self.tables.read("document_groups"))

    def ingest(self, source: DataFrame, *, categories: list[str] | None = None, kb_ids: list[str] | None = None, figures: str = "auto", ids: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
        """Takes files (path, length, content) in and returns (id, path, status, error).

        Rejected and unreadable files become failed documents with an error; the others are chunked, their entities and relations found, embedded and stored. Taking the same
        paths in again makes new documents. ``ids`` (path, id, job_id, blob_key, created_at) gives the documents and jobs of queued files the ids that they have already.
        ``layouts`` (path and the columns of ``placement.layout_figures``) are blocks that a layout reader found: they give chunks their pages, and figures chunks of their own.
        """
        groups = self.require_write(kb_ids)
        now = datetime.now(UTC)
        taken = files.accepted(source)
        texts = files.extract(taken.filter("rejection IS NULL"))
        rows = taken.select("path", "rejection").join(texts, "path", "left")
        if ids is None:
            rows = rows.withColumns({"id": F.expr("uuid()"), "job_id": F.expr("uuid()"), "blob_key": F.col("path"), "created_at": F.lit(now)})
        else:
            rows = rows.join(ids, "path")
        rows = rows.select("id", "job_id", "blob_key", "path", "text", F.coalesce("rejection", "error").alias("error"), "created_at")
        staged = f"{self.tables.root}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        good = rows.filter("error IS NULL")
        name = F.element_at(F.split("path", "/"), -1)
        docs = rows.select(
            "id", F.lit(self.key.tenant).alias("tenant_id"), name.alias("title"), F.array(*map(F.lit, categories or [])).cast("array<string>").alias("categories"), name.alias("filename"),
            F.translate("text", "\0", "").alias("content"), F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), F.create_map(F.lit("figures"), F.lit(figures)).alias("metadata"), "created_at",
        )
        self._index(good.select(F.col("id").alias("document_id"), name.alias("title"), F.col("text").alias("content"), T.ingest_policy(name, F.lit(figures)).alias("policy")), None if layouts is None else layouts.join(good.select("path", F.col("id").alias("document_id")), "path").drop("path"), figures != "skip")
        self.tables.append("documents", docs)
        if groups:
            self.tables.append("document_groups", docs.select(F.col("id").alias("document_id"), F.explode(F.array(*map(F.lit, groups))).alias("knowledge_base_id")))
        done = rows.select(F.col("job_id").alias("id"), F.col("id").alias("document_id"), "blob_key", F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.substring("error", 1, jobs.ERROR_CHARS).alias("error"), "created_at")
        self.tables.append("ingest_jobs", done.withColumns({"tenant_id": F.lit(self.key.tenant), "attempt": F.lit(1), "step": F.lit("done"), "progress": F.lit(100), "updated_at": F.lit(now)}))
        return rows.select("id", "path", F.when(F.col("error").isNull(), "ready").otherwise("failed").alias("status"), "error")

    def _index(self, docs: DataFrame, blocks: DataFrame | None = None, figures: bool = True) -> None:
        get = self.settings.get
        chunks = chunking.smart_chunks(docs, key="document_id", size=get("KB_CHUNK_SIZE"), overlap=get("KB_CHUNK_OVERLAP"))
        if blocks is not None:
            chunks = placement.paged(chunks, blocks)
        chunks = placement.prefixed(chunks, docs, self.contextualizer)
        if blocks is not None and figures:
            chunks = chunks.unionByName(placement.figures_as_chunks(chunks, blocks, self.key.tenant).drop("figure_type"), allowMissingColumns=True)
        titled = chunks.join(docs.select("document_id", "title"), "document_id")
        made = titled.withColumn("embedding", self.embedder.column(vector.embedding_text(F.col("title"), F.col("content"))))
        made = store.validated_chunks(made.withColumns({"embedding_model": F.lit(self.embedder.name), "tenant_id": F.lit(self.key.tenant)}), self.embedder.dimension)
        prose = docs.filter("policy.entities").select("document_id", "content")
        found = patterns.dedupe_entities(patterns.extract_entities(prose, key="document_id", text="content"), key="document_id")
        entities = found.withColumn("entity_id", T.entity_id(F.col("document_id"), F.col("name")))
        entities = store.upsert(entities.limit(0), entities, key="entity_id", order=("seq",))
        relations = patterns.extract_relations(prose, found, key="document_id", text="content")
        edges, _ = graph.link(relations, entities)
        self.tables.append("chunks", made)
        self.words.add(made.select("chunk_id", "content"))
        self.tables.append("entities", entities)
        self.tables.append("relations", edges.select("document_id", "src", "dst", T.relation_type(F.col("rel_type")).alias("rel_type"), "confidence", "context"))

    def require_read(self) -> None:
        self.key.require(READ)

    def require_write(self, kb_ids: list[str] | None) -> list[str] | None:
        """The groups that the key may write to."""
        self.key.require(WRITE)
        groups = self.key.narrowed(kb_ids)
        if kb_ids and not groups:
            raise PermissionError("no access to these knowledge bases")
        return groups

    def forget(self, ids: DataFrame) -> None:
        """Deletes what was made of documents (one column of the tenant's own ids), as far as there is anything."""
        chunks = self.tables.read("chunks").filter(F.col("tenant_id") == self.key.tenant)
        ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        self.words.remove(chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("chunk_id"))
        for name in ("chunks", "entities", "relations", "document_groups", "documents"):
            self.tables.delete(name, ids, "id" if name == "documents" else "document_id")

    def documents(self, kb_ids: list[str] | None = None, limit: int = 100) -> DataFrame:
        """Newest documents with their chunk counts; a request for groups that the key may not see lists nothing."""
        self.key.require(READ)
        groups = self.key.narrowed(kb_ids)
        rows = self._documents(groups)
        rows = rows.limit(0) if groups is not None and not groups else rows
        found = store.newest(store.chunk_counts(rows, self.tables.read("chunks")), limit)
        seen = self.tables.read("retrievals").groupBy(F.col("document_id").alias("id")).agg(F.countDistinct("retrieval_id").alias("_n"), F.max("at").alias("_at"))
        found = found.join(seen, "id", "left").withColumns({"retrieval_count": F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_retrieved_at": F.greatest("last_retrieved_at", "_at")})
        return found.drop("_n", "_at").orderBy(F.desc("created_at"), "id")

    def delete(self, document_id: str) -> bool:
        """Removes a document and all that was made of it."""
        self.key.require(WRITE)
        ids = self._documents(self.key.narrowed(None)).filter(F.col("id") == document_id).select("id")
        if not ids.take(1):
            return False
        self.forget(self.spark.createDataFrame([(document_id,)], "id string"))
        return True

    # -- search

    def search(self, query: str, *, max_chunks: int = 8, kb_ids: list[str] | None = None, document_ids: list[str] | None = None, category: str | None = None, hybrid: bool = False) -> retrieval.Result | DataFrame:
        """Searches documents by id, by hybrid retrieval, or by the default; each within the key's groups. Counts a hit for each document found."""
        self.key.require(READ)
        k, get = min(50, max(1, int(max_chunks))), self.settings.get
        groups = self.key.narrowed(kb_ids)
        meta = self._documents(groups, category)
        if groups is not None and not groups:
            meta = meta.limit(0)
        meta = meta.select(F.col("id").alias("document_id"), "title", "categories")
        chunks = self.tables.read("chunks").filter(F.col("tenant_id") == self.key.tenant).drop("tenant_id")
        if document_ids:
            found = retrieval.by_documents(chunks, meta, document_ids, query, embedder=self.embedder, k=k)
        elif hybrid:
            floor = self.settings.get("KB_FIGURE_MIN_RERANK") if self.settings.given("KB_FIGURE_MIN_RERANK") else retrieval.FIGURE_FLOOR
            found = retrieval.hybrid(
                chunks, meta, self.tables.read("entities"), query, embedder=self.embedder, max_chunks=k, window=get("KB_NEIGHBOR_WINDOW"), vector_weight=get("KB_VECTOR_WEIGHT"), entity_weight=get("KB_ENTITY_WEIGHT"),
                figures=chunks.filter("chunk_type = 'figure'"), figure_limit=get("KB_FIGURE_LIMIT"), figure_floor=floor, reranker=self._reranker(), judge=self.judge,
            )
        else:
            found = retrieval.retrieve(
                chunks, meta, query, embedder=self.embedder, max_chunks=k, expander=self.expander, reranker=self._reranker(), initial=get("KB_RERANK_INITIAL_K"), bm25=get("KB_BM25_ENABLED"),
                index=self.words, index_scope=groups is not None or category is not None, most_figures=get("KB_FIGURE_LIMIT"), figure_floor=get("KB_FIGURE_MIN_RERANK"),
            )

        hits = found.hits if isinstance(found, retrieval.Result) else found
        # one row for each document found, 50 at most, beside what is stored
        ids = hits.select("document_id").distinct().withColumns({"retrieval_id": F.lit(uuid.uuid4().hex), "tenant_id": F.lit(self.key.tenant), "at": F.lit(datetime.now(UTC))})
        self.tables.append("retrievals", ids)
        return found

    def _reranker(self) -> Reranker | None:
        return self.reranker or (RERANKERS.make(self.settings.get("KB_RERANKER")) if self.settings.get("KB_RERANK_ENABLED") else None)

    def clear(self) -> None:
        """Removes all that the tenant has but its keys."""
        self.key.require(WRITE)
        ids = self.tables.read("documents").filter(F.col("tenant_id") == self.key.tenant).select("id")
        groups = self.tables.read("knowledge_bases").filter(F.col("tenant_id") == self.key.tenant).select("id")
        tenant = self.spark.createDataFrame([(self.key.tenant,)], "id string")
        self.words.clear()
        self.tables.delete("document_groups", groups, "knowledge_base_id")
        for name in ("entities", "relations", "document_groups"):
            self.tables.delete(name, ids, "document_id")
        for name in ("chunks", "knowledge_bases", "ingest_jobs", "retrievals", "documents"):
            self.tables.delete(name, tenant, "tenant_id")

    def events(self, since: datetime | None = None) -> DataFrame:
        """Frames of the tenant's jobs, oldest first: what each reported last, its percentage and the name of its step."""
        self.key.require(READ)
        rows = self.jobs() if since is None else self.jobs().filter(F.col("updated_at") > F.lit(since))
        return rows.select("id", "document_id", "status", "step", T.step_name(F.col("step")).alias("label"), "progress", "error", "updated_at").orderBy("updated_at", "id")

    def record(self, hits: DataFrame) -> None:
        """Adds one to the counter of every document among the hits."""
        marked = hits.select("document_id").distinct().withColumn("retrieval_id", F.lit(uuid.uuid4().hex))
        self.tables.update("documents", lambda rows: store.record_hits(rows, marked, datetime.now(UTC)))

    # -- groups, jobs, the rest

    def create_kb(self, name: str) -> str:
        self.key.require(WRITE)
        mine = self.tables.read("knowledge_bases").filter(F.col("tenant_id") == self.key.tenant)
        if mine.filter(F.col("name") == name).take(1):
            raise ValueError(f"{name} exists")
        kb = str(uuid.uuid4())
        self.tables.append("knowledge_bases", self.spark.createDataFrame([(kb, self.key.tenant, name)], "id string, tenant_id string, name string").withColumn("created_at", F.current_timestamp()))
        return kb

    def knowledge_bases(self) -> DataFrame:
        self.key.require(READ)
        mine = self.tables.read("knowledge_bases").filter(F.col("tenant_id") == self.key.tenant)
        if self.key.knowledge_bases:
            mine = mine.filter(F.col("id").isin(self.key.knowledge_bases))
        return store.knowledge_bases(mine, self.tables.read("document_groups"))

    def job(self, job_id: str) -> DataFrame:
        self.key.require(READ)
        return self._jobs(F.col("id") == job_id)

    def jobs(self) -> DataFrame:
        """The tenant's jobs as each was reported last."""
        return self._jobs(F.lit(True))

    def _jobs(self, which: F.Column) -> DataFrame:
        rows = self.tables.read("ingest_jobs").filter((F.col("tenant_id") == self.key.tenant) & which)
        rest = [c for c in rows.columns if c != "id"]
        done = F.col("status").isin("success", "failed").cast("int")
        last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "attempt", done, "progress")).alias("r"))
        return last.select("id", "r.*").select(*rows.columns)

    def drift(self) -> DataFrame:
        return vector.drift(self.tables.read("chunks").filter(F.col("tenant_id") == self.key.tenant), self.embedder.name)

    def re_embed(self, document_ids: list[str] | None = None, *, done: Accumulator | None = None, failed: Accumulator | None = None) -> DataFrame:
        """Embeds stale chunks, and those of the given documents, again; one row with the outcome.

        A document with a text that the endpoint refuses is failed and keeps all vectors that it has; the others are done. Accumulators show the progress in texts.
        """
        chunks = self.tables.read("chunks")
        ids = vector.stale_documents(chunks.filter(F.col("tenant_id") == self.key.tenant), self.embedder.name)
        if document_ids:
            ids = ids.union(self.spark.createDataFrame([(i,) for i in document_ids], "document_id string")).distinct()
        ids = ids.join(self._documents().select(F.col("id").alias("document_id")), "document_id", "left_semi")
        todo = chunks.join(ids, "document_id", "left_semi").join(self.tables.read("documents").select(F.col("id").alias("document_id"), "title"), "document_id")
        todo = todo.select("chunk_id", "document_id", vector.embedding_text(F.col("title"), F.col("content")).alias("_text"))
        new = calls.embedded(todo, "_text", self.embedder, concurrent=self.settings.get("KB_STORE_CONCURRENCY"), done=done, failed=failed).drop("_text")
        staged = f"{self.tables.root}/staged/{uuid.uuid4().hex}"
        new.write.parquet(staged)
        new = self.spark.read.parquet(staged)
        bad = new.filter("embedding_error IS NOT NULL").select("document_id").distinct()
        good = new.join(bad, "document_id", "left_anti")
        self.tables.update("chunks", lambda rows: store.re_embed(rows, good, self.embedder.name))
        per = ids.join(new.groupBy("document_id").agg(F.count("embedding").alias("chunks"), F.count("embedding_error").alias("errors")), "document_id", "left")
        status = F.when(F.col("errors") > 0, "failed").when(F.col("chunks") > 0, "ok").otherwise("skipped")
        return store.re_embed_summary(per.select(status.alias("status"), F.when(status == "ok", F.col("chunks")).otherwise(F.lit(0)).alias("chunks")))

    def related(self, entity_id: str, **options) -> DataFrame:
        mine = self.tables.read("relations").join(self._documents().select(F.col("id").alias("document_id")), "document_id", "left_semi")
        return graph.related(mine, entity_id, **options)

    def grounding(self, answer: DataFrame, titles: list[str], *, text: str = "text") -> DataFrame:
        """Adds citations (each with supported) and grounded, their supported share, to answers."""
        marked = T.grounded(T.citations(F.col(text)), F.array(*map(F.lit, titles)).cast("array<string>"))
        return answer.withColumn("citations", marked).withColumn("grounded", T.grounded_ratio(F.col("citations")))

    @staticmethod
    def formats() -> list[str]:
        return list(files.ACCEPTED)

    def health(self) -> dict:
        return {"ok": True, "documents": self.tables.read("documents").limit(1).count() >= 0}


__all__ = ["RERANKERS", "Key", "KnowledgeBase", "Tables", "hash_key", "mint_key"]
