"""Tables of documents, chunks and entities: contracts, upserts, deletes, counters, scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_FIELDS = ("document_title", "category", "subcategory", "section", "asset_key")


def validated_chunks(chunks: DataFrame, dimension: int) -> DataFrame:
    """Chunks ready to be stored: ids ``{document}_{i}``, empty optional fields null; a missing vector or one of another length is an error."""
    rows = chunks
    for c in (*CHUNK_FIELDS, "embedding_model", "contextual_prefix"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.nullif(F.col(c), F.lit("")))
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    message = F.concat(F.lit("chunk "), F.col("chunk_index").cast("string"), F.lit(f" needs a vector of {dimension}, has "), size.cast("string"))
    ok = F.when((size == dimension) & ~F.exists("embedding", lambda x: x.isNull()), F.concat_ws("_", F.col("document_id"), F.col("chunk_index").cast("string"))).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("chunk_id", ok)


def store_chunks(chunks: DataFrame, path: str, dimension: int, *, partition: str = "document_bucket", buckets: int = 64) -> None:
    """Replaces the stored chunks of the documents at hand; those of others stay. Indexing a document again changes nothing.

    Chunks lie in buckets by a hash of the document, so the number of folders doesn't grow with the documents. Only the buckets at hand are rewritten: what
    stays in them is written beside and swapped in by Spark's dynamic overwrite.
    """
    spark = chunks.sparkSession
    new = validated_chunks(chunks, dimension).withColumn(partition, F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        touched = [r[0] for r in new.select(partition).distinct().collect()]
        old = spark.read.parquet(path).filter(F.col(partition).isin(touched)).join(new.select("document_id").distinct(), "document_id", "left_anti")
        new = old.select(*new.columns).unionByName(new, allowMissingColumns=True)
    staged = f"{path.rstrip('/')}__staged"
    new.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_rows(rows: DataFrame, ids: DataFrame, *, key: str = "document_id") -> DataFrame:
    """The rows that stay."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_anti")


def delete_document(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents: chunks, entities, relations and groups go with them."""
    return {name: delete_rows(t, ids, key="id" if name == "documents" else "document_id") for name, t in tables.items()}


def upsert(old: DataFrame, new: DataFrame, *, key: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each key: the last of the new ones by ``order``, or else the old one. Reduced before it is shuffled."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_new")]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("r")).select(key, "r.*")


def merge_metadata(documents: DataFrame, patch: DataFrame, *, key: str = "id") -> DataFrame:
    """Shallow merge of maps; the patch wins."""
    p = patch.select(key, F.col("metadata").alias("_p"))
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys("_p"), k)), F.col("_p"))
    return documents.join(p, key, "left").withColumn("metadata", F.when(F.col("_p").isNotNull(), merged).otherwise(F.col("metadata"))).drop("_p")


def set_flag(documents: DataFrame, ids: list, name: str, value: str, *, key: str = "id") -> DataFrame:
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    made = F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value)))
    return documents.withColumn("metadata", F.when(F.col(key).isin(ids), made).otherwise(F.col("metadata")))


def count_hits(hits: DataFrame, *, key: str = "document_id", retrieval: str = "retrieval_id") -> DataFrame:
    """(key, retrieval_hits): each retrieval counts once for a document."""
    return hits.select(key, retrieval).distinct().groupBy(key).agg(F.count("*").alias("retrieval_hits"))


def record_hits(documents: DataFrame, hits: DataFrame, now, *, key: str = "id") -> DataFrame:
    counts = count_hits(hits).withColumnsRenamed({"document_id": key, "retrieval_hits": "_h"})
    rows = documents.join(counts, key, "left")
    return rows.withColumns({"retrieval_count": F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_h", F.lit(0)), "last_retrieved_at": F.when(F.col("_h").isNotNull(), F.lit(now)).otherwise(F.col("last_retrieved_at"))}).drop("_h")


# -- scoping ---------------------------------------------------------------------------------------------


def tenant_rows(rows: DataFrame, tenant: str | None) -> DataFrame:
    if not tenant:
        raise PermissionError("no tenant in scope")
    return rows.filter(F.col("tenant_id") == tenant)


def alive(documents: DataFrame, tenant: str, *, category: str | None = None, groups: list[str] | None = None, document_groups: DataFrame | None = None) -> DataFrame:
    """The tenant's documents that aren't deleted, of a category, and in any of the groups; an empty list of groups is no limit."""
    rows = tenant_rows(documents, tenant).filter(F.col("deleted_at").isNull())
    if category is not None:
        rows = rows.filter(F.array_contains("categories", category))
    if groups:
        member = document_groups.filter(F.col("knowledge_base_id").isin(groups)).select(F.col("document_id").alias("id"))
        rows = rows.join(member, "id", "left_semi")
    return rows


def matching(rows: DataFrame, **wanted) -> DataFrame:
    """Rows equal to all given values; a list takes any of its values, None only nulls. Conditions reach the scan."""
    for name, value in wanted.items():
        c = F.col(f"`{name}`")
        rows = rows.filter(c.isNull() if value is None else c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == F.lit(value))
    return rows


def without_tenant(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """All tables without what belongs to a tenant; rows that name no tenant go with their documents."""
    mine = tenant_rows(tables["documents"], tenant).select(F.col("id").alias("document_id"))
    out = {}
    for name, t in tables.items():
        out[name] = t.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant))) if "tenant_id" in t.columns else delete_rows(t, mine)
    return out


def visible(ids: DataFrame, documents: DataFrame, tenant: str) -> DataFrame:
    return ids.join(alive(documents, tenant).select(F.col("id").alias(ids.columns[0])), ids.columns[0], "left_semi")


def knowledge_bases(bases: DataFrame, document_groups: DataFrame) -> DataFrame:
    """Groups with the number of their documents, by name; deleted documents count as long as they are listed."""
    n = document_groups.groupBy(F.col("knowledge_base_id").alias("id")).agg(F.count("document_id").alias("documents"))
    return bases.join(n, "id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)).cast("long")).orderBy("name")


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    return documents.join(n, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)).cast("long"))


def newest(documents: DataFrame, limit: int = 100) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "id").limit(min(500, max(1, int(limit))))


def reindex(chunks: DataFrame, *order: str, doc: str = "document_id") -> DataFrame:
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def re_embed(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks with new vectors (chunk_id, embedding) and their model's name; others as they are."""
    new = vectors.select("chunk_id", F.col("embedding").alias("_e"))
    rows = chunks.join(new, "chunk_id", "left")
    got = F.col("_e").isNotNull()
    return rows.withColumns({"embedding": F.when(got, F.col("_e")).otherwise(F.col("embedding")), "embedding_model": F.when(got, F.lit(model)).otherwise(F.col("embedding_model"))}).drop("_e")


def re_embed_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: documents by outcome (status ok, skipped or failed) and chunks."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(s)
    return results.groupBy(*by).agg(F.count("*").alias("documents"), n("ok"), n("skipped"), n("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
