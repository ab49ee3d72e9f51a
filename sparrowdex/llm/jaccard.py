"""N-gram Jaccard self-join by chosen paths."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999999
#: Coordinates of the embedding, a bucket's size up to which it isn't split further, splits at most, rows of a block of a large leaf.
COORDINATES, BUCKET, DEPTH, BLOCK = 40, 96, 4, 1024
_M = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold has been in a common leaf with probability ``recall``.

    A node of the path tree goes on with two coordinates, so a pair goes on together from it with probability
    q = 1 - (1 - s q')^2 where q' is that of the next level; the last level has q = 1.
    """
    q = 1.0
    for _ in range(DEPTH - 1):
        q = 1 - (1 - similarity * q) ** 2
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * q)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _spaces() -> np.ndarray:
    """For each code point up to the last white space whether ``str.split`` splits there; one more for all others."""
    return np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's words, in order: for each word the sum over its letters of a hash of letter and place, mixed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _spaces()[np.minimum(codes, 0x3001)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    begun = np.zeros(len(codes), np.int64)
    begun[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(codes)) - np.cumsum(begun)
    letters = _mix((codes.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32))) * _M + _M)
    letters[space] = 0
    return _mix(np.add.reduceat(letters, starts))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words, if it has fewer; none, if it has none."""
    w = _word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h * _M + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _M)


def embed(grams: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The set's embedding: for each coordinate the least of its hashes (32 bits of it). Two sets agree in one with the probability of their similarity."""
    seeds = _seeds(coordinates)
    out = np.empty(coordinates, np.uint32)
    for at in range(0, coordinates, 8):
        part = (grams[None, :] ^ seeds[at : at + 8, None]) * np.uint64(0xD6E8FEB86659FD93)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        out[at : at + 8] = (part.min(axis=1) >> np.uint64(32)).astype(np.uint32)
    return out


def _signature(grams: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """For each row its key, the hash of its text, its set's signature (s1, s2), size and embedding."""
    schema = "_k long, _th long, s1 long, s2 long, n int, sketch array<int>"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                s1, s2, n, sketch = [], [], [], []
                for t in batch.column("_text").to_pylist():
                    g = shingles(t, words)
                    a, b = _signature(g)
                    s1.append(a)
                    s2.append(b)
                    n.append(len(g))
                    sketch.append(embed(g).view(np.int32) if len(g) else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k"), batch.column("_th"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int32()), pa.array(sketch, pa.list_(pa.int32()))],
                    names=["_k", "_th", "s1", "s2", "n", "sketch"],
                )

    return docs.select("_k", "_th", F.col(text).alias("_text")).mapInArrow(run, schema)


def _drawn(nodes: DataFrame, count: int, coordinates: int) -> DataFrame:
    """Two coordinates of the embedding, drawn by the node, split its sets: rows (node, c, s1, s2, x1, x2) with the child of each coordinate."""
    pick = lambda i: (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(coordinates - count)) + count).cast("int")
    second = F.when(pick(1) == pick(2), count + F.pmod(pick(1) - count + 1, F.lit(coordinates - count))).otherwise(pick(2)).cast("int")
    nodes = nodes.withColumns({"_j1": pick(1), "_j2": second})
    child = lambda j: F.xxhash64("node", j, F.get("sketch", F.col(j)))
    return nodes.select("node", "c", "s1", "s2", child("_j1").alias("x1"), child("_j2").alias("x2"))


def _children(drawn: DataFrame) -> DataFrame:
    """A row (node, s1, s2) for each set and child."""
    return drawn.select(F.explode(F.array("x1", "x2")).alias("node"), "s1", "s2")


def _leaves(sets: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """Leaves of the path trees: small ones as (leaf, members), large ones as rows (leaf, c, s1, s2).

    The first level has one bucket for each run and value. A bucket of up to BUCKET sets is a leaf. A larger one is split on two
    coordinates that it draws itself; if a child keeps half of it, its sets are alike and splitting is over: it is a leaf, cut into blocks later.
    """
    level = sets.filter("n > 0").select("s1", "s2", "sketch", F.posexplode(F.slice("sketch", 1, runs)).alias("_j", "_v"))
    level = level.select(F.xxhash64("_j", "_v").alias("node"), "s1", "s2")
    counts = level.groupBy("node").agg(F.count("*").alias("c")).filter("c > 1")
    level = common.written(level.join(counts, "node"), "paths")
    small = [level.filter(F.col("c") <= BUCKET).select("node", "s1", "s2")]
    large = []
    big = level.filter(F.col("c") > BUCKET)
    for depth in range(2, DEPTH + 1):
        if not big.take(1):
            break
        drawn = common.written(_drawn(big.join(sets.select("s1", "s2", "sketch"), ["s1", "s2"]), runs, COORDINATES), "drawn")
        # children are counted by the columns; sets of alike ones have no rows for theirs
        each = [drawn.groupBy(F.col(x).alias("node")).agg(F.count("*").alias("c"), F.first("node").alias("parent"), F.first("c").alias("pc")) for x in ("x1", "x2")]
        sizes = common.written(each[0].unionByName(each[1]), "sizes")
        stop = common.written(sizes.filter(F.col("c") >= 0.5 * F.col("pc")).select(F.col("parent").alias("node")).distinct(), "dense")
        large.append(big.join(stop, "node", "left_semi"))
        go = sizes.filter("c > 1").join(stop.withColumnRenamed("node", "parent"), "parent", "left_anti").select("node", "c")
        child = _children(drawn.join(stop, "node", "left_anti"))
        level = common.written(child.join(go, "node").select("node", "s1", "s2", "c"), "paths")
        small.append(level.filter(F.col("c") <= BUCKET).select("node", "s1", "s2"))
        big = level.filter(F.col("c") > BUCKET)
    large.append(big)
    few = small[0]
    for x in small[1:]:
        few = few.unionByName(x)
    many = large[0]
    for x in large[1:]:
        many = many.unionByName(x)
    members = few.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("s1", "s2"))).alias("ids"))
    # most leaves of a group hold the same sets: one of them is enough
    return common.written(members.groupBy("ids").agg(F.min("node").alias("leaf")), "leaves"), common.written(many.select(F.col("node").alias("leaf"), "c", "s1", "s2"), "large-leaves")


def similar_in(sets: list[np.ndarray], similarity: float, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted pairs (a matrix, True at a, b) those of sets with at least that similarity, by exact counts of shared elements.

    Elements that only one of the sets has can't be shared; the others are bits, and a pair's count is that of the bits of both.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    rows = np.repeat(np.arange(n), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[code] > 1
    rows, code = rows[keep], code[keep]
    if not len(code):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, code = np.unique(code, return_inverse=True)
    bits = np.zeros((n, int(code.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (rows, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    able = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    # the smaller one's shareable elements must do
    fair = wanted & (np.minimum(able[:, None], able[None, :]) >= similarity * np.maximum(sizes[:, None], sizes[None, :]) - 1e-6)
    a, b = np.nonzero(fair)
    ok = np.zeros(len(a), bool)
    step = max(256, (1 << 21) // bits.shape[1])
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        ok[at : at + step] = (both >= similarity * (sizes[x] + sizes[y] - both) - 1e-6) & (both > 0)
    return a[ok], b[ok]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def join_within(leaf: int, weights: np.ndarray, sets: list[np.ndarray], lists: list, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that this leaf counts for each member, and each member's root here.

    A pair that meets in several leaves is compared in the least of them: the members' lists of leaves tell which. side parts the members if
    this is a pair of blocks of one leaf (0 and 1); the pairs within a block are another task's.
    """
    n = len(sets)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if (side == 1).any():
        wanted &= side[:, None] != side[None, :]
    known = [np.asarray(x, np.int64) for x in lists]
    flat, rows = np.concatenate(known), np.repeat(np.arange(n), [len(x) for x in known])
    flat, rows = flat[flat < leaf], rows[flat < leaf]
    if len(flat):
        _, code, held = np.unique(flat, return_inverse=True, return_counts=True)
        rows, code = rows[held[code] > 1], code[held[code] > 1]
        _, code = np.unique(code, return_inverse=True)
        member = np.zeros((n, int(code.max(initial=-1)) + 1), np.float32)
        member[rows, code] = 1
        wanted &= (member @ member.T) == 0
    a, b = similar_in(sets, similarity, wanted)
    links = np.zeros(n, np.int64)
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    return links, _roots(n, a, b)


def _verified(docs: DataFrame, text: str, words: int, sets: DataFrame, small: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """(s1, s2, links, r1, r2): for each member of each leaf of several the links counted there and its root there."""
    few = small.select("leaf", F.explode("ids").alias("i")).select("leaf", "i.s1", "i.s2", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("s1", "s2", "leaf"), blocks).cast("int")
    cut = large.select("leaf", "s1", "s2", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    many = cut.select("leaf", "s1", "s2", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    members = common.written(few.unionByName(many), "members")
    lists = members.groupBy("s1", "s2").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"), F.collect_list(F.struct("leaf", "p", "q", "side")).alias("parts"))
    wanted = sets.join(lists, ["s1", "s2"]).select(F.col("first._k").alias("_k"), F.col("first._th").alias("_th"), "s1", "s2", "texts", "leaves", "parts")
    wanted = common.written(wanted, "wanted")
    columns = ["s1", "s2", "texts", "leaves", "parts"]

    # the sets themselves, made again for the texts that have met another
    def grams(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t, words).tobytes() for t in batch.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.binary())], names=[*columns, "grams"])

    # merged at every size: what is wanted grows with the input
    texts = docs.select("_k", "_th", F.col(text).alias("_text")).join(wanted.hint("merge"), ["_k", "_th"]).select(*columns, "_text")
    schema = "s1 long, s2 long, texts long, leaves array<long>, parts array<struct<leaf:long,p:int,q:int,side:int>>, grams binary"
    full = texts.mapInArrow(grams, schema).withColumn("part", F.explode("parts")).select("part.leaf", "part.p", "part.q", "part.side", "s1", "s2", "texts", "leaves", "grams")

    schema = "s1 long, s2 long, links long, r1 long, r2 long"
    # rows of a group follow one another, so a task takes its groups as they come; calls for each small group would cost more than its pairs
    dealt = full.repartition("leaf", "p", "q").sortWithinPartitions("leaf", "p", "q", "s1", "s2")
    return common.written(dealt.mapInArrow(lambda batches: _joined(batches, similarity), schema), "verified")


def _joined(batches, similarity: float):
    """For batches of rows sorted by (leaf, p, q, s1, s2), a group's rows perhaps in several: each member's links and root in its group."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        ends = _ends(rows, "leaf", "p", "q")
        last = ends[-2] if len(ends) > 1 else 0
        if last:
            yield from _groups(rows.slice(0, last), ends[:-1], similarity)
        held = rows.slice(last)
    if held is not None and held.num_rows:
        yield from _groups(held, np.array([held.num_rows]), similarity)


def _ends(rows: pa.Table, *columns: str) -> np.ndarray:
    """Where runs of rows that are equal in these columns end."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for c in columns:
        x = rows.column(c).to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([np.flatnonzero(new) + 1, [rows.num_rows][: rows.num_rows]]).astype(np.int64)


def _groups(rows: pa.Table, ends: np.ndarray, similarity: float):
    leaf, s1, s2, texts, side = (rows.column(c).to_numpy() for c in ("leaf", "s1", "s2", "texts", "side"))
    leaves, grams = rows.column("leaves").combine_chunks(), rows.column("grams").combine_chunks()
    again = np.zeros(len(leaf), bool)  # equal rows of documents give their set twice
    again[1:] = (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])
    out, begin = [], 0
    for end in ends.tolist():
        again[begin] = False
        kept = begin + np.flatnonzero(~again[begin:end])
        begin = end
        if len(kept) < 2:
            continue
        sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in kept.tolist()]
        links, root = join_within(leaf[kept[0]], texts[kept], sets, [leaves[i].values.to_numpy() for i in kept.tolist()], side[kept], similarity)
        out.append((s1[kept], s2[kept], links, s1[kept][root], s2[kept][root]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["s1", "s2", "links", "r1", "r2"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component, for edges (v, w) between comparable values.

    Each round maps every vertex to its least neighbour (or itself), jumps twice along these maps, and goes on with the edges between what is left; so
    a star is one vertex after a round, and a chain a quarter of its length. A vertex without smaller neighbours stays, so a component ends as its least one. Labels follow the
    rounds' maps. Every round is written, so lineage stays short. Without edges the result is empty.
    """

    def among(pairs: DataFrame) -> DataFrame:
        ends = pairs.filter("v != w").select(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w"))
        return common.written(ends.distinct(), "edges")

    live, labels = among(edges), None
    while labels is None or live.take(1):
        down = live.select(F.col("w").alias("v"), F.col("v").alias("to")).unionByName(live.select("v", F.col("v").alias("to")))
        to = common.written(down.groupBy("v").agg(F.min("to").alias("to")), "nearest")
        for _ in range(2):
            to = common.written(to.join(to.select(F.col("v").alias("to"), F.col("to").alias("far")), "to").select("v", F.col("far").alias("to")), "nearest")
        move = lambda c, t=to: t.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))
        live = among(live.join(move("v"), "v").join(move("w"), "w").select(F.col("v_to").alias("v"), F.col("w_to").alias("w")))
        if labels is None:
            labels = to.withColumnRenamed("to", "label")
        else:
            after = labels.join(to.select(F.col("v").alias("label"), F.col("to").alias("far")), "label", "left")
            labels = common.written(after.select("v", F.coalesce("far", "label").alias("label")), "labels")
    return labels


_ADDED = ("class_id", "class_text", "text_id", "links")
#: Stands for a null key.
_LOW = -(1 << 63)


def _key(key: str) -> F.Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_LOW))


def _text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Adds class_id, class_text, text_id and links to every row.

    Sets are the distinct word 5-grams of whole texts (words as split by white space; a text of fewer words is one gram). Rows with equal sets
    are one set from the start. Chosen paths over embeddings of the sets (``_leaves``) bring similar sets into common leaves, with
    probability ``recall`` at the threshold; within a leaf all pairs are compared by exact counts, block by block, and none is ever a row.

    links: how many other texts are at least ``similarity`` similar (equal sets included). class_id: least key among all rows connected by links.
    class_text: hash of the text of the class's first row, by (key, hash of the text); classes whose first rows share a key, or have none, differ in it.
    text_id: least key of the rows with the same set. Nulls: null, empty and blank texts have the empty set, and are one another's
    copies; a null key counts as the least, so its class has a null id. Equal rows are copies. An empty table gives an empty result.
    Other columns pass through; columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_ADDED)
    keyed = docs.withColumns({"_k": _key(key), "_th": _text_hash(text)})
    rows = common.written(_sets(keyed, text, words), "sets")
    by_text = rows.groupBy("s1", "s2", "_th").agg(F.min("_k").alias("_k"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = by_text.groupBy("s1", "s2").agg(F.min(F.struct("_k", "_th")).alias("first"), F.count("*").alias("texts"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = common.written(sets, "distinct-sets")
    small, large = _leaves(sets, runs_for(recall, similarity))
    verified = _verified(keyed, text, words, sets, small, large, similarity)
    links = verified.groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    edges = verified.filter("s1 != r1 or s2 != r2").select(F.struct("s1", "s2").alias("v"), F.struct(F.col("r1").alias("s1"), F.col("r2").alias("s2")).alias("w"))
    labels = components(spark, edges).select("v.s1", "v.s2", F.col("label.s1").alias("r1"), F.col("label.s2").alias("r2"))
    known = sets.select("s1", "s2", "first", F.col("first._k").alias("text_id"), "texts").join(labels, ["s1", "s2"], "left").join(links, ["s1", "s2"], "left")
    known = known.withColumns({"r1": F.coalesce("r1", "s1"), "r2": F.coalesce("r2", "s2"), "links": (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).cast("long")})
    roots = known.groupBy("r1", "r2").agg(F.min("first").alias("least")).select("r1", "r2", F.col("least._k").alias("class_id"), F.col("least._th").alias("class_text"))
    known = common.written(known.join(roots, ["r1", "r2"]).select("s1", "s2", "text_id", "class_id", "class_text", "links"), "classes")
    found = rows.select("_k", "_th", "s1", "s2").dropDuplicates(["_k", "_th"]).join(known, ["s1", "s2"]).drop("s1", "s2")
    real = lambda c: F.when(F.col(c) != _LOW, F.col(c)).alias(c)
    out = keyed.join(found, ["_k", "_th"])
    return out.select(*docs.columns, real("class_id"), "class_text", real("text_id"), "links")


def join_rows(docs: DataFrame) -> DataFrame:
    """Every document's class, text class and number of links; a class is told by class_id and class_text."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", *_ADDED)


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: that with the least (key, hash of the text); of equal rows, one. A null key comes first."""
    found = near_duplicates(docs, text=text, key=key).withColumns({"_k": _key(key), "_th": _text_hash(text)})
    first = found.filter((F.col("_k") == F.coalesce("class_id", F.lit(_LOW))) & (F.col("_th") == F.col("class_text")))
    # a pair of key and text is of one class only
    return first.dropDuplicates(["_k", "_th"]).drop(*_ADDED, "_k", "_th")
