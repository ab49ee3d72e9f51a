"""Copies among images by local descriptors: multiscale corners, turned binary tests, Hamming tables and geometric consensus."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .jaccard import components

#: Half width of a patch, binary tests, least distance of two corners, ratio of two scales, side below which an image has no further scale.
PATCH, TESTS, SPACE, STEP, LEAST = 12, 256, 6, 2**0.125, 30
#: For each Hamming table the bits that it reads of a point, whatever the input's size, and the near points of its scale that a point makes keys with.
#: Bits were chosen one by one, on 800 edited copies and 5,000 images of vectors of check_l: those that tell points of other images apart and stay in copies.
READS = (
    (55, 178, 49, 59, 57, 180, 139, 196, 171, 189, 191, 3, 167, 201, 212, 96, 251, 88, 60, 77, 173, 130, 66, 172),
    (51, 55, 178, 49, 59, 180, 57, 139, 107, 171, 7, 201, 13, 105, 93, 48, 71, 102, 244, 215, 243, 134, 239, 204),
)
BESIDE = 4
#: Rows of a block of a bucket, pixels that are described at once, images that are compared with one that has moved, images for each pair of a round.
BLOCK, PIXELS, CHUNK, SHARE = 256, 1 << 19, 64, 4
#: Bits that may differ in a match, matches that must agree, distance in pixels up to which a match agrees.
DIFFER, AGREE, NEAR = 48, 6, 3.0
_WORD = np.dtype("<u8")


@functools.cache
def _tests() -> np.ndarray:
    """Pairs of points of a patch's disc, apart from one another; drawn once, from a fixed seed."""
    t = np.random.default_rng(11).uniform(1 - PATCH, PATCH - 1, (16 * TESTS, 2, 2))
    t = t[((t**2).sum(axis=2) <= (PATCH - 1) ** 2).all(axis=1)]
    return t[((t[:, 0] - t[:, 1]) ** 2).sum(axis=1) >= (0.3 * PATCH) ** 2][:TESTS].astype(np.float32)


def _smooth(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Means by the weights 1 4 6 4 1 along both axes, so many times."""
    for _ in range(times):
        p = np.pad(a, ((0, 0), (2, 2), (2, 2)), mode="edge")
        for _ in range(4):
            p = p[:, :-1] + p[:, 1:]
        for _ in range(4):
            p = p[:, :, :-1] + p[:, :, 1:]
        a = p * np.float32(1 / 256)
    return a


@functools.lru_cache(64)
def _weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights (a row for each of the m new values) that resample n values by triangles, as wide as a new value at least."""
    wide = max(1.0, n / m)
    at = (np.arange(m) + 0.5) * n / m - 0.5
    place = np.ceil(at - wide).astype(np.int64)[:, None] + np.arange(math.floor(2 * wide) + 1)[None, :]
    w = np.maximum(0, 1 - np.abs(place - at[:, None]) / wide) * ((place >= 0) & (place < n))
    return np.clip(place, 0, n - 1), (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


@functools.lru_cache(64)
def _matrix(n: int, m: int) -> np.ndarray:
    place, weight = _weights(n, m)
    out = np.zeros((m, n), np.float32)
    np.add.at(out, (np.arange(m)[:, None], place), weight)
    return out


def _sized(a: np.ndarray, h: int, w: int) -> np.ndarray:
    if max(*a.shape[1:], h, w) <= 256:  # the same sums as a product, which is faster for small images
        return _matrix(a.shape[1], h) @ a @ _matrix(a.shape[2], w).T
    for axis, m in ((1, h), (2, w)):
        place, weight = _weights(a.shape[axis], m)
        weight = weight[:, None, :] if axis == 1 else weight[None]
        a = sum(a.take(place[:, k], axis=axis) * weight[..., k] for k in range(place.shape[1]))
    return a


def _highest(r: np.ndarray, reach: int) -> np.ndarray:
    """Maximum over the square of that reach around each pixel, by doubling."""
    for axis in (1, 2):
        n, whole = r.shape[axis], 2 * reach + 1
        p = np.moveaxis(np.pad(r, [(reach if k == axis else 0,) * 2 for k in range(3)], constant_values=-np.inf), axis, 0)
        width = 1
        while 2 * width <= whole:
            p = np.maximum(p[: len(p) - width], p[width:])
            width *= 2
        r = np.moveaxis(np.maximum(p[:n], p[whole - width : whole - width + n]), 0, axis)
    return r


def _corners(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Harris corners (image, y, x): highest within SPACE pixels, to parts of a pixel. So their number grows with the area."""
    gy, gx = np.zeros_like(a), np.zeros_like(a)
    gy[:, 1:-1] = a[:, 2:] - a[:, :-2]
    gx[:, :, 1:-1] = a[:, :, 2:] - a[:, :, :-2]
    xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    r = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    top = (r >= _highest(r, SPACE)) & (r > 1e-3 * r.max(axis=(1, 2), keepdims=True)) & (r > 1e-4)
    top[:, :SPACE] = top[:, -SPACE:] = False
    top[:, :, :SPACE] = top[:, :, -SPACE:] = False
    i, y, x = np.nonzero(top)
    here = r[i, y, x]

    def part(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = low - 2 * here + high
        return np.where(bend < 0, np.clip(0.5 * (low - high) / np.where(bend < 0, bend, -1), -0.5, 0.5), 0)

    return i, y + part(r[i, y - 1, x], r[i, y + 1, x]), x + part(r[i, y, x - 1], r[i, y, x + 1])


def describe_many(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the grey images (one array, equal sizes) its points (x, y in its own pixels), TESTS bits for each point, and each point's scale by number.

    Corners are found on every scale of a pyramid, down to LEAST pixels. A patch is turned to the direction of its intensity's centre, and
    the bits tell which of two points of each test is brighter. Linear changes of brightness change none of it.
    """
    a = np.asarray(images, np.float32)
    (count, high, wide), scale, made, level = a.shape, 1.0, [], 0
    dy, dx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    disc = dy**2 + dx**2 <= PATCH**2
    oy, ox = dy[disc], dx[disc]
    t, margin = _tests(), 4 * PATCH
    while min(h := round(high / scale), w := round(wide / scale)) >= LEAST:
        a = _sized(a, h, w)
        b = _smooth(a)
        i, y, x = _corners(b)
        if len(i):
            # patches are read from an image of twice the size, so places are right to a quarter of a pixel
            p = np.pad(_sized(_smooth(b), 2 * h, 2 * w), ((0, 0), (margin, margin), (margin, margin)), mode="edge")
            row = p.shape[2]
            base = i * (p.shape[1] * row) + np.rint(2 * y + 0.5 + margin).astype(np.int64) * row + np.rint(2 * x + 0.5 + margin).astype(np.int64)
            p = p.reshape(-1)
            near = p.take(base[:, None] + 2 * (oy * row + ox)[None, :])
            angle = np.arctan2(near @ oy.astype(np.float32), near @ ox.astype(np.float32))
            cos, sin = 2 * np.cos(angle)[:, None, None], 2 * np.sin(angle)[:, None, None]
            place = np.rint(sin * t[..., 0] + cos * t[..., 1]).astype(np.int32) * row + np.rint(cos * t[..., 0] - sin * t[..., 1]).astype(np.int32)
            v = p.take(base[:, None, None] + place)
            places = np.stack([(x + 0.5) * wide / w - 0.5, (y + 0.5) * high / h - 0.5], axis=1).astype(np.float32)
            made.append((i, places, np.packbits(v[:, :, 0] < v[:, :, 1] - 1e-4, axis=1), np.full(len(i), level, np.uint8)))
        scale, level = scale * STEP, level + 1
    if not made:
        return [(np.empty((0, 2), np.float32), np.empty((0, TESTS // 8), np.uint8), np.empty(0, np.uint8))] * count
    i, *found = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.argsort(i, kind="stable")
    cuts = np.searchsorted(i[order], np.arange(1, count))
    return list(zip(*(np.split(x[order], cuts) for x in found), strict=True))


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return describe_many(np.asarray(image)[None])[0][:2]


def agreeing(p1: np.ndarray, d1: np.ndarray, p2: np.ndarray, d2: np.ndarray, enough: int | None = None) -> int:
    """Most matches that one similarity transform (turn, scale, shift) explains; it stops at ``enough`` of them.

    Each point goes with its nearest descriptor of the other image if that goes with it as well. Every two matches that are apart give a transform, and
    no chance is involved.
    """
    if not len(d1) or not len(d2):
        return 0
    w1, w2 = (np.ascontiguousarray(d).view(_WORD) for d in (d1, d2))
    differ = np.empty((len(d1), len(d2)), np.int16)
    for at in range(0, len(d1), 512):
        differ[at : at + 512] = np.bitwise_count(w1[at : at + 512, None, :] ^ w2[None, :, :]).sum(axis=2, dtype=np.int16)
    j = differ.argmin(axis=1)
    i = np.flatnonzero((differ.argmin(axis=0)[j] == np.arange(len(d1))) & (differ[np.arange(len(d1)), j] <= DIFFER))
    if len(i) < (enough or 2):
        return min(len(i), 1) if enough is None else 0
    a, b = p1[i, 0] + 1j * p1[i, 1], p2[j[i], 0] + 1j * p2[j[i], 1]
    best = 0
    for u in range(len(a) - 1):
        v = np.flatnonzero(np.abs(a[u + 1 :] - a[u]) >= 8) + u + 1
        turn = (b[u] - b[v]) / (a[u] - a[v])
        turn = turn[(np.abs(turn) > 0.4) & (np.abs(turn) < 2.5)]
        if len(turn):
            error = np.abs(turn[:, None] * (a - a[u])[None, :] - (b - b[u])[None, :])
            # points of several scales at one place are one
            for ok in error[np.argsort(-(error <= NEAR).sum(axis=1), kind="stable")[:2]] <= NEAR:
                spots = np.unique(np.rint(np.stack([a[ok].real, a[ok].imag], axis=1) / 4), axis=0)
                best = max(best, len(spots))
            if enough and best >= enough:
                return best
    return best


# -- tables of images ------------------------------------------------------------------------------


def describe_images(images: DataFrame) -> DataFrame:
    """(image_id, digest, n, points, descriptors, levels) of images (image_id, width, height, pixels: grey bytes by rows); no points for null or broken ones.

    The digest is that of size and pixels; null pixels have that of the id, so they equal no other image. Images of one size are described together, up to PIXELS at once;
    a larger one alone takes some 100 bytes a pixel.
    """
    import hashlib

    schema = pa.schema([("image_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("points", pa.binary()), ("descriptors", pa.binary()), ("levels", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                rows = whole.slice(at, 64).to_pylist()
                out = [{"image_id": r["image_id"], "digest": None, "n": 0, "points": b"", "descriptors": b"", "levels": b""} for r in rows]
                sizes: dict[tuple[int, int], list[int]] = {}
                for k, r in enumerate(rows):
                    w, h, raw = r["width"], r["height"], r["pixels"]
                    name = f"none {r['image_id']}".encode() if raw is None else f"{w} {h} ".encode() + raw
                    out[k]["digest"] = hashlib.blake2b(name, digest_size=16).digest()
                    if raw is not None and w and h and w > 0 and h > 0 and len(raw) == w * h:
                        sizes.setdefault((h, w), []).append(k)
                for (h, w), ks in sizes.items():
                    step = max(1, PIXELS // (h * w))
                    for s in range(0, len(ks), step):
                        part = ks[s : s + step]
                        stack = np.stack([np.frombuffer(rows[k]["pixels"], np.uint8).reshape(h, w) for k in part])
                        for k, (p, d, v) in zip(part, describe_many(stack), strict=True):
                            out[k] |= {"n": len(p), "points": p.astype("<f4").tobytes(), "descriptors": d.tobytes(), "levels": v.tobytes()}
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id long, digest binary, n int, points binary, descriptors binary, levels binary")


def _beside(points: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of an image's points of which one is among the BESIDE nearest of the other; those of other scales come after those of its own."""
    place = points[:, 0] + 1j * points[:, 1]
    away = np.abs(place[:, None] - place[None, :]) + np.where(levels[:, None] != levels[None, :], np.float32(1e7), np.float32(0))
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1, kind="stable")[:, : min(BESIDE, len(place) - 1)]
    i, j = np.repeat(np.arange(len(place)), near.shape[1]), near.ravel()
    both = np.unique(np.minimum(i, j) * len(place) + np.maximum(i, j))
    return both // len(place), both % len(place)


def _keys(described: DataFrame) -> DataFrame:
    """(key, image, point): for each table and each two points that lie side by side the bits of both that the table reads. They follow from these two points alone.

    Two points of one image rarely have the bits of two of an unlike one, so chance meetings are some thousandths of those by as many bits of one point.
    A key stands for two points: point is 0, and images that share a key have met by two.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                keys, each = [], []
                images, *columns = (whole.slice(at, 256).column(c) for c in ("image_id", "points", "descriptors", "levels"))
                for points, bits, levels in zip(*(c.to_pylist() for c in columns), strict=True):
                    i, j = _beside(np.frombuffer(points, "<f4").reshape(-1, 2), np.frombuffer(levels, np.uint8))
                    every = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, TESTS // 8), axis=1)
                    own = []
                    for t, read in enumerate(READS):
                        one = every[:, read].astype(np.int64) @ (1 << np.arange(len(read), dtype=np.int64))
                        own.append(np.minimum(one[i], one[j]) << 24 | np.maximum(one[i], one[j]) | t << 48)
                    keys.append(np.unique(np.concatenate(own)))
                    each.append(len(keys[-1]))
                image = np.repeat(images.to_numpy(), each).astype(np.int64)
                cols = [pa.array(np.concatenate([*keys, np.empty(0, np.int64)])), pa.array(image), pa.array(np.zeros(len(image), np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "image", "point"])

    return described.filter("n > 1").select("image_id", "points", "descriptors", "levels").mapInArrow(run, "key long, image long, point int")


def _verified(pairs: DataFrame, described: DataFrame, agree: int) -> DataFrame:
    """Of the pairs (a, b), a written table, those with ``agree`` matches under one transform.

    Only descriptors of images in pairs are dealt out: those of b once for each pair, those of a once for CHUNK pairs. Pairs go in rounds
    by their a and chunk, about a pair for SHARE images in each, so what is on disk at once follows the images, whatever the number of pairs.
    """
    ids = common.written(pairs.select(F.explode(F.array("a", "b")).alias("image_id")).distinct(), "paired")
    own = common.written(described.select("image_id", "points", "descriptors").join(ids, "image_id", "left_semi"), "paired-images")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    rounds = max(1, -(-SHARE * pairs.count() // max(1, described.count())))

    def run(batches):
        here, mine = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                alike = []
                for a, chunk, b, points, bits in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b", "points", "descriptors")), strict=True):
                    one = np.frombuffer(points, "<f4").reshape(-1, 2), np.frombuffer(bits, np.uint8).reshape(-1, TESTS // 8)
                    if b is None:  # a itself comes before those that it is compared with
                        here, mine = (a, chunk), one
                    elif here == (a, chunk) and agreeing(*mine, *one, enough=agree) >= agree:
                        alike.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in alike], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = []
    for k in range(rounds):
        chunked = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk")).filter(F.pmod(F.xxhash64("a", "chunk"), F.lit(rounds)) == k)
        ends = chunked.select("a", "chunk", "b", F.col("b").alias("image_id"))
        ends = ends.unionByName(chunked.select("a", "chunk", F.lit(None).cast("long").alias("b"), F.col("a").alias("image_id")).distinct())
        dealt = ends.join(own, "image_id").select("a", "chunk", "b", "points", "descriptors").repartition("a", "chunk")
        found.append(common.written(dealt.sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long"), "verified"))
    common.dropped(own)
    return functools.reduce(DataFrame.unionByName, found)


def _ordered(x: F.Column, y: F.Column) -> F.Column:
    pair = lambda u, v: F.struct(u["image"].alias("a"), u["point"].alias("pa"), v["image"].alias("b"), v["point"].alias("pb"))
    return F.when(x["image"] < y["image"], pair(x, y)).otherwise(pair(y, x))


def _met(keys: DataFrame) -> DataFrame:
    """The rows (key, image, point) whose key several images have, with the least (image, point) of the key: head. Rows move once."""
    own = Window.partitionBy("key")
    rows = keys.withColumns({"head": F.min(F.struct("image", "point")).over(own), "last": F.max("image").over(own)})
    return rows.filter("head.image != last").drop("last")


def _across(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, pa, b, pb) of images that share a key and have different labels, block by block; a bucket of one label has none.

    Of two such images one at least doesn't have the label of the bucket's first image. So the others' blocks meet all blocks, and
    a bucket that is one class but for a few images costs its size times these few. A bucket that is one block moves once.
    """
    own = Window.partitionBy("key")
    rows = met.select("key", "image", "point").join(labels, "image", "left").withColumn("label", F.coalesce("label", "image"))
    of = {"first": F.min(F.struct("image", "label")).over(own)["label"], "lo": F.min("label").over(own), "hi": F.max("label").over(own), "c": F.count("*").over(own)}
    rows = rows.withColumns(of).filter("lo != hi").withColumn("other", F.col("label") != F.col("first"))
    rows = rows.withColumn("o", F.count(F.when(F.col("other"), 1)).over(own)).drop("first", "lo", "hi")
    rows = common.written(rows, "unresolved")
    block = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    part = lambda c: F.pmod(F.xxhash64("image", "point"), block(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), block(c) - 1))
    # left and right tell on which side of its block's pairs a row stands
    dealt = lambda t, p, q, left, right: t.select("key", p.alias("p"), q.alias("q"), "image", "point", "label", "other", left.alias("left"), right.alias("right"))
    yes, no = F.lit(True), F.lit(False)
    large = rows.filter(F.col("c") > BLOCK)
    every = dealt(rows.filter(F.col("c") <= BLOCK), F.lit(0), F.lit(0), yes, F.col("other"))
    every = every.unionByName(dealt(large, part("c"), spread("o"), yes, no)).unionByName(dealt(large.filter("other"), spread("c"), part("o"), no, yes))
    group = every.repartition("key", "p", "q").groupBy("key", "p", "q").agg(F.collect_list(F.struct("image", "point", "label", "other", "left", "right")).alias("rows"))
    # of two others each is left of the other once: one of these counts
    fits = lambda x, y: y["right"] & (y["label"] != x["label"]) & (~x["other"] | (x["image"] < y["image"]))
    pairs = F.flatten(F.transform(F.filter("rows", lambda x: x["left"]), lambda x: F.transform(F.filter("rows", lambda y: fits(x, y)), lambda y: _ordered(x, y))))
    return group.select(F.explode(pairs).alias("m")).select("m.*")


def find_copies(images: DataFrame, *, agree: int = AGREE) -> DataFrame:
    """(image_id, class_id, images) for every image: the least id of its class, and how many images the class has.

    Images of equal bytes and size are one image from the start. Of the others, each two points side by side of which both descriptors are equal in the bits that a table reads share a bucket. Tables and bits
    are fixed, so whether two images meet depends on these two alone, not on the table around them. Images that meet, and so by two points, are compared point by point, and are copies if ``agree`` matches fit one similarity transform. Classes are what copies connect. First every image meets
    the first one of its buckets; then, in the buckets that aren't of one class, all images of different classes meet. So each pair that shares two
    such points is compared unless it is in one class already, and a group of copies costs its size, not its square.

    Null or broken images, and those without corners, are classes of their own (with their equals). Rows that share an id count once, as the one with the least digest.
    A null id is left out. An empty table gives an empty result. Other columns are not read.
    """
    spark = images.sparkSession
    everything = common.written(describe_images(images.filter(F.col("image_id").isNotNull())), "described")
    same = everything.groupBy("image_id").agg(F.min("digest").alias("digest"))
    first = same.groupBy("digest").agg(F.min("image_id").alias("rep"))
    members = common.written(same.join(first, "digest").select("image_id", "rep", "digest"), "images")
    # one row for each image that stands for its equals
    if members.count() == everything.count():
        described = everything.join(common.written(members.filter("image_id != rep").select("image_id"), "equals"), "image_id", "left_anti")
    else:
        described = everything.join(members.filter("image_id = rep").select("image_id", "digest"), ["image_id", "digest"], "left_semi").dropDuplicates(["image_id"])
    met = common.written(_met(_keys(described)), "buckets")
    star = met.filter("image != head.image").select(F.col("head.image").alias("a"), F.col("image").alias("b"))
    tried = common.written(star.select("a", "b").distinct(), "tried")
    copies = _verified(tried, described, agree)
    labels = components(spark, copies.select(F.col("a").alias("v"), F.col("b").alias("w"))).select(F.col("v").alias("image"), "label")
    rest = common.written(_across(met, labels).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    common.dropped(met)
    more = copies.unionByName(_verified(rest, described, agree))
    labels = components(spark, more.select(F.col("a").alias("v"), F.col("b").alias("w"))).select(F.col("v").alias("rep"), "label")
    out = members.join(labels, "rep", "left").select("image_id", F.coalesce("label", "rep").alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count("*").alias("images"))
    return out.join(sizes, "class_id").select("image_id", "class_id", "images")


# -- images of the embeddings ----------------------------------------------------------------------

SIDE, TURNS = 96, 3


@functools.cache
def _waves(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sines and cosines over the image: a wave for each component, of its own direction and length (8 to 28 pixels)."""
    k = np.arange(count)
    way, pace = k * 2.39996, 0.035 + 0.085 * ((k * 0.618034) % 1)
    y, x = np.mgrid[:SIDE, :SIDE]
    at = 2 * np.pi * pace[:, None, None] * (np.cos(way)[:, None, None] * x + np.sin(way)[:, None, None] * y)
    return np.sin(at).reshape(count, -1).astype(np.float32), np.cos(at).reshape(count, -1).astype(np.float32)


def render(vector) -> np.ndarray | None:
    """A texture: the sum of a wave for each component, which tells its phase. So near vectors have like images. None without usable components."""
    v = np.asarray([np.nan if x is None else x for x in vector] if vector is not None else [], np.float64)
    if len(v) < 2 or not np.isfinite(v).all() or v.max() == v.min():
        return None
    sines, cosines = _waves(len(v))
    phase = 2 * np.pi * TURNS * v
    grey = np.cos(phase).astype(np.float32) @ sines + np.sin(phase).astype(np.float32) @ cosines
    return np.clip(np.rint(128 + grey * (56 / np.sqrt(len(v)))), 0, 255).astype(np.uint8).reshape(SIDE, SIDE)


def warped(image: np.ndarray, *, crop: float = 1.0, turn: float = 0.0, scale: float = 1.0, gain: float = 1.0, lift: float = 0.0, at: tuple[float, float] = (0.5, 0.5)) -> np.ndarray:
    """The part of the image that a crop leaves, turned about its centre, scaled, and brightened."""
    h, w = image.shape
    high, wide = max(1, round(h * crop * scale)), max(1, round(w * crop * scale))
    cy, cx = (h - 1) * (crop / 2 + (1 - crop) * at[0]), (w - 1) * (crop / 2 + (1 - crop) * at[1])
    y, x = np.mgrid[:high, :wide].astype(np.float64)
    y, x = (y - (high - 1) / 2) / scale, (x - (wide - 1) / 2) / scale
    sy = np.clip(cy + np.cos(turn) * y + np.sin(turn) * x, 0, h - 1.001)
    sx = np.clip(cx - np.sin(turn) * y + np.cos(turn) * x, 0, w - 1.001)
    iy, ix = sy.astype(int), sx.astype(int)
    fy, fx, a = sy - iy, sx - ix, image.astype(np.float64)
    out = (a[iy, ix] * (1 - fx) + a[iy, ix + 1] * fx) * (1 - fy) + (a[iy + 1, ix] * (1 - fx) + a[iy + 1, ix + 1] * fx) * fy
    return np.clip(np.rint(out * gain + lift), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, key: int) -> np.ndarray:
    """A copy that the key chooses: a crop of three quarters of each side, a turn, another size, less contrast, or a crop with a turn and less contrast."""
    kind, part = key // 10 % 5, (key // 50 % 11) / 10
    return warped(image, **[
        {"crop": 0.75, "at": (part, 1 - part / 2), "gain": 0.8, "lift": 10},
        {"turn": 0.2 + part},
        {"scale": 0.7 + 0.6 * part},
        {"gain": 0.5 + 0.2 * part, "lift": 40},
        {"crop": 0.75, "turn": 0.5 * part, "gain": 0.8, "lift": 20},
    ][kind])


def images_of(vectors: DataFrame, every: int = 10) -> DataFrame:
    """Images of a table of vectors: 2 * vec_id is the vector's; of each ``every``-th vector, -(2 * vec_id + 1) is an edited copy of it."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["vec_id"] is None:
                    continue
                image = render(r["embedding"])
                made = [(2 * r["vec_id"], image)]
                if r["vec_id"] % every == 0:
                    made.append((-(2 * r["vec_id"] + 1), None if image is None else edited(image, r["vec_id"])))
                out += [{"image_id": i, "width": None if x is None else x.shape[1], "height": None if x is None else x.shape[0], "pixels": None if x is None else x.tobytes()} for i, x in made]
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema=_IMAGE)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_IMAGE)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "image_id long, width int, height int, pixels binary")


_IMAGE = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])


def copy_rows(vectors: DataFrame) -> DataFrame:
    """Classes of the images of all vectors and of their edited copies."""
    return find_copies(images_of(vectors))
