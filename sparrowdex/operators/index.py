"""A stored word index for BM25: postings by term bucket, ranges of documents with bounds, deltas and deletions merged on read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fulltext
from .fulltext import K1, B
from .snapshots import Entry, Tables, new_folder

BUCKETS = 64
#: Documents of one range: a term's postings in a range are one row, with the bounds that let a search leave it out.
RANGE = 1024
#: Words of the ranges that one task makes lists of.
WORDS = 1 << 20
#: Ranges that are scored first, for the bound on all others.
FIRST = 4
POSTINGS = "segment string, bucket int, term string, range long, n long, most_tf long, least_len long, keys array<string>, tfs array<long>, lens array<long>"
TABLES = {
    "postings": POSTINGS,
    "sizes": "segment string, range long, key string, len long",
    "gone": "segment string, range long, key string, len long",
}


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _parts(ranges: int, words: int | None) -> int:
    """Tasks that make the lists: each has whole ranges, of some WORDS words together."""
    return max(1, min(ranges, -(-(words or 0) // WORDS)))


def _lists(rows: DataFrame, segment: Column) -> DataFrame:
    """Rows of ``postings`` of (range, key, len, term, tf). A range lies in one partition, so its lists are made where its postings are, and only lists move to their buckets."""
    lists = rows.groupBy("range", "term").agg(F.sort_array(F.collect_list(F.struct("key", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len")))).alias("l"))
    return lists.select(segment.alias("segment"), "term", "range", F.col("l.key").alias("keys"), F.col("l.tf").alias("tfs"), F.col("l.len").alias("lens"))


class WordIndex:
    """BM25 over chunks that were added, without reading any text again.

    ``add`` takes texts apart once and moves them as words to the task of their range, which counts them and makes the lists, so no postings move by themselves. It writes a delta: its postings, partitioned by a hash of the term, one row for each term and range of documents with the greatest count and the least length in it,
    and a narrow table of lengths. ``remove`` writes keys. ``search`` reads the buckets of the query's terms alone: first the rows' bounds without their lists, then the lists of the ranges with the
    highest bounds, then those of the ranges whose bound reaches the k-th score found so far. Its results are those of ``fulltext.bm25`` over all chunks that the index holds, stemmed by default.
    """

    def __init__(self, spark: SparkSession, root: str, *, stem: bool = True):
        self.spark, self.stem = spark, stem
        self.tables = _Bucketed(spark, root, TABLES)

    # -- writing

    def add(self, chunks: DataFrame, *, key: str = "chunk_id", content: str = "content") -> None:
        """Adds chunks; their keys must be new to the index, or removed before. Null and empty texts have no words and don't count as documents."""
        spark = self.spark
        segment = F.lit(_new())
        staged = f"{self.tables.root}/staged/{_new()}"
        # texts are read and taken apart once, so whatever the chunks are made of, lengths and postings agree
        texts = chunks.select(F.col(key).cast("string").alias("key"), fulltext.tokens(F.coalesce(content, F.lit(""))).alias("words"))
        # no word holds a blank, and words with blanks between take half the room of an array
        texts.select("key", F.size("words").cast("long").alias("len"), F.array_join("words", " ").alias("words")).write.parquet(staged)
        texts = spark.read.parquet(staged).filter("len > 0")
        sizes = texts.groupBy("key").agg(F.first("len").alias("len"))
        # documents of a range share the hash's remainder; their number follows from the rows, so ranges of any delta are alike in size
        docs, words = sizes.agg(F.count("*"), F.sum("len")).first()
        ranges = max(1, -(-docs // RANGE))
        at = F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range")
        rows = texts.select(at, "key", "len", "words").repartition(_parts(ranges, words), "range").select("range", "key", "len", F.explode(F.split("words", " ")).alias("term"))
        one = ["range", "key", "len", "term"]
        if self.stem:
            rows = fulltext.stemmed(rows.groupBy(*one).agg(F.count("*").alias("n"))).repartition(_parts(ranges, words), "range").groupBy(*one).agg(F.sum("n").alias("tf"))
        else:
            rows = rows.groupBy(*one).agg(F.count("*").alias("tf"))
        self.tables.append("sizes", sizes.select(segment.alias("segment"), at, "key", "len"))
        self.tables.append("postings", _lists(rows, segment))
        self.tables.folder.remove(f"staged/{staged.rsplit('/', 1)[1]}")

    def remove(self, keys: DataFrame) -> None:
        """Removes chunks by key (one column); only their keys, ranges and lengths are written."""
        keys = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct()
        held = self._alive().join(keys, "key", "left_semi")
        self.tables.append("gone", held.select("segment", "range", "key", "len"))

    def clear(self) -> None:
        for name in TABLES:
            self.tables.replace(name, self.tables.read(name).limit(0), self.tables.listed(name)[0])

    def compact(self) -> None:
        """Writes what is left as one delta, without the removed keys. A crash in between leaves the old deltas."""
        alive = self._alive()
        rows = self.tables.read("postings").select("segment", "term", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p")).select("segment", "term", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
        rows = rows.join(alive.select("segment", "key"), ["segment", "key"], "left_semi")
        docs, words = alive.agg(F.count("*"), F.sum("len")).first()
        ranges = max(1, -(-docs // RANGE))
        segment, at = F.lit(_new()), F.pmod(F.xxhash64("key"), F.lit(ranges)).alias("range")
        lists = _lists(rows.select(at, "key", "len", "term", "tf").repartition(_parts(ranges, words), "range"), segment)
        numbers = {name: self.tables.listed(name)[0] for name in TABLES}
        self.tables.replace("postings", lists, numbers["postings"])
        self.tables.replace("sizes", alive.select(segment.alias("segment"), at, "key", "len"), numbers["sizes"])
        self.tables.replace("gone", self.tables.read("gone").limit(0), numbers["gone"])

    # -- reading

    def _alive(self) -> DataFrame:
        return self.tables.read("sizes").join(self.tables.read("gone").select("segment", "key"), ["segment", "key"], "left_anti")

    def _rows(self, terms: Sequence[str]) -> DataFrame:
        """Rows of the terms; only their buckets' files are read."""
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"))).distinct().collect()]
        return self.tables.read("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))

    def search(self, query: str, k: int = 10, *, operator: str = "or", scope: DataFrame | None = None, digits: int = 10) -> DataFrame:
        """(key, score) of the k best chunks, ties by key; none for a blank query. ``scope`` (one column of keys) limits what is returned; counts are those of the whole index.

        The statistics are one row, and bounds a row for each term and range; neither texts nor lists of other terms are read.
        """
        k = max(1, int(k))
        terms = fulltext.query_terms(query, self.stem)
        none = self.spark.createDataFrame([], "key string, score double")
        if not terms or not query.strip():
            return none
        rows = self._rows(terms)
        gone = self.tables.read("gone")
        has_gone = bool(self.tables.listed("gone")[1]) and not gone.isEmpty()
        whole = self.tables.read("sizes").agg(F.count("*").alias("n"), F.sum("len").alias("s")).first()
        lost = gone.agg(F.count("*").alias("n"), F.sum("len").alias("s")).first() if has_gone else {"n": 0, "s": 0}
        total = whole["n"] - lost["n"]
        if not total:
            return none
        mean = F.lit(((whole["s"] or 0) - (lost["s"] or 0)) / total)

        def flat(of: DataFrame) -> DataFrame:
            each = of.select("segment", "term", F.explode(F.arrays_zip("keys", "tfs", "lens")).alias("p"))
            return each.select("segment", "term", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))

        counts = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        if has_gone:  # the removed ones' postings lie in their own ranges
            touched = flat(rows.join(gone.select("segment", "range").distinct(), ["segment", "range"], "left_semi")).join(gone.select("segment", "key"), ["segment", "key"], "left_semi")
            for r in touched.groupBy("term").agg(F.count("*").alias("n")).collect():
                counts[r["term"]] -= r["n"]
        counts = {t: n for t, n in counts.items() if n > 0}
        if not counts or (operator == "and" and len(counts) < len(terms)):
            return none
        idf = reduce(lambda c, t: c.when(F.col("term") == t, F.log(F.lit(1 + (total - counts[t] + 0.5) / (counts[t] + 0.5)))), counts, F.when(F.lit(False), 0.0))
        part = idf * _part(F.col("tf"), F.col("len"), mean)

        def scored(ranges: DataFrame) -> DataFrame:
            alive = flat(rows.join(ranges, ["segment", "range"], "left_semi"))
            if has_gone:
                alive = alive.join(gone.select("segment", "key"), ["segment", "key"], "left_anti")
            if scope is not None:
                alive = alive.join(scope.select(F.col(scope.columns[0]).cast("string").alias("key")).distinct(), "key", "left_semi")
            out = alive.groupBy("key").agg(F.round(F.sum(part), digits).alias("score"), F.count("*").alias("met"))
            out = out.filter(F.col("met") == len(terms)) if operator == "and" else out
            return out.select("key", "score").orderBy(F.desc("score"), "key").limit(k)

        bounds = rows.groupBy("segment", "range").agg(F.sum(idf * _part(F.col("most_tf"), F.col("least_len"), mean)).alias("bound"), F.count("*").alias("met"))
        bounds = bounds.filter(F.col("met") == len(terms)) if operator == "and" else bounds
        begin = bounds.orderBy(F.desc("bound"), "segment", "range").limit(FIRST).select("segment", "range")
        least = [r["score"] for r in scored(F.broadcast(begin)).collect()]  # FIRST ranges at most are small enough to travel
        if len(least) == k:  # a range below the k-th score can hold none of the best; the margin is that of rounding
            bounds = bounds.filter(F.col("bound") >= least[-1] - 10.0 ** (1 - digits))
        return scored(bounds.select("segment", "range"))


class _Bucketed(Tables):
    """Tables whose postings lie in folders by bucket, which a filter on the bucket prunes."""

    def _put(self, name: str, rows: DataFrame) -> Entry:
        if name != "postings":
            return super()._put(name, rows)
        at = new_folder()
        # lists alone move; what follows from them is worked out afterwards
        rows = rows.select("segment", "term", "range", "keys", "tfs", "lens").repartition(bucket_of(F.col("term")))
        rows = rows.withColumns({"bucket": bucket_of(F.col("term")), "n": F.size("keys"), "most_tf": F.array_max("tfs"), "least_len": F.array_min("lens")})
        schema = self.spark.createDataFrame([], POSTINGS).schema
        rows = rows.sortWithinPartitions("bucket", "term", "range").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{at}")
        return Entry(at, bytes=self.folder.size(f"{name}/{at}"))


def _new() -> str:
    return uuid.uuid4().hex


__all__ = ["WordIndex", "bucket_of"]
