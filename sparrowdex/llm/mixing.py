"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Rows that one group of the flight phase holds, and groups whose open rows meet in the next round.
GROUP_ROWS, FAN_IN = 16384, 64
#: Rows of each source, of falling sizes, that the flight leaves to the landing, so that its rounding costs next to nothing.
HELD = 10
EPS = 1e-9


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of the sources: (source, source_size) gets a target and its place.

    Weights repeat over the sources in the order of code points, null last. The targets share ``share`` times all
    sizes by weight; a target stops at ``cap`` times its source's size, and the excess is shared again. The end of
    that is a level x with target = min(cap * size, x * weight), found from running sums over the sources by
    the ratio at which each one fills up. One row for each source is all that meets in one place.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    listed = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    listed = listed.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")))
    listed = listed.withColumn("_full", cap * F.col("source_size")).withColumn("_r", F.col("_full") / F.col("_w"))
    up = Window.orderBy("_r", "_i")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ran = listed.withColumns(
        {
            "_goal": share * F.sum("source_size").over(everything),
            "_before": F.coalesce(F.sum("_full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("_w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    ran = ran.withColumn("_x", (F.col("_goal") - F.col("_before")) / F.col("_rest"))
    # the first source, from the emptiest, that the level does not fill up
    level = F.min(F.when(F.col("_x") <= F.col("_r"), F.struct("_r", "_i", "_x"))).over(everything)["_x"]
    return (
        ran.withColumn("_level", level)
        .withColumn("target", F.coalesce(F.least(F.col("_full"), F.col("_level") * F.col("_w")), F.col("_full")))
        .select(source, "source_size", "target", F.col("_i").alias("place"))
    )


def flight(pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Flight phase: moves probabilities of one source until two at most are neither 0 nor 1.

    Balanced on the number of rows and on their sizes: with three open rows there is a direction that changes
    neither total (it lies in the null space of the constraints); the walk goes one of its two ways, by
    a choice that keeps the expectation, until a row reaches 0 or 1. Deterministic: the choices come from a generator
    seeded by the rows themselves.
    """
    p = pi.astype(float).copy()
    rng = np.random.default_rng([len(p), int(sizes.sum()) & 0xFFFFFFFF])
    toss = rng.random(len(p) + 1)
    open_rows: list[int] = []
    t = 0
    for nxt in range(len(p)):
        if p[nxt] <= EPS or p[nxt] >= 1 - EPS:
            p[nxt] = 0.0 if p[nxt] <= EPS else 1.0
            continue
        open_rows.append(nxt)
        while len(open_rows) == 3:
            a, b, c = open_rows
            sa, sb, sc = float(sizes[a]), float(sizes[b]), float(sizes[c])
            u = (sb - sc, sc - sa, sa - sb)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = np.inf
            for x, v in zip((p[a], p[b], p[c]), u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - x) / v), min(down, x / v)
                elif v < 0:
                    up, down = min(up, x / -v), min(down, (1 - x) / -v)
            step = up if toss[t % len(toss)] * (up + down) < down else -down
            t += 1
            for i, v in zip((a, b, c), u, strict=True):
                p[i] += step * v
                if p[i] <= EPS or p[i] >= 1 - EPS:
                    p[i] = 0.0 if p[i] <= EPS else 1.0
            open_rows = [i for i in open_rows if 0.0 < p[i] < 1.0]
    return p


def landing(pi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Landing phase over the few rows still open (``HELD`` + 2 at most): of all choices, the one whose size is nearest to what
    was expected, then its count."""
    p = pi.copy()
    rows = np.flatnonzero((p > 0) & (p < 1))
    want, number = float((p[rows] * sizes[rows]).sum()), float(p[rows].sum())
    picks = (np.arange(1 << len(rows))[:, None] >> np.arange(len(rows))) & 1
    off = np.abs(picks @ sizes[rows].astype(float) - want)
    best = np.lexsort((np.abs(picks.sum(axis=1) - number), off))[0]
    p[rows] = picks[best].astype(float)
    return p


def _held(ascending: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to ``HELD`` of the rows, each about half as large as the one before: sums of them come near any rest."""
    left = list(ascending)
    out, goal = [], float(sizes[ascending[-1]]) / 2 if len(ascending) else 0.0
    while left and len(out) < HELD:
        at = min(int(np.searchsorted(sizes[left], goal)), len(left) - 1)
        if at and goal - sizes[left[at - 1]] < sizes[left[at]] - goal:
            at -= 1
        out.append(left.pop(at))
        goal /= 2
    return np.array(out, dtype=np.int64)


def settle(pi: np.ndarray, sizes: np.ndarray, last: bool) -> np.ndarray:
    """One round for one source: the flight of all rows but a few, of falling sizes, which are kept for the landing."""
    p = pi.copy()
    rows = np.flatnonzero((p > 0) & (p < 1))
    rest = np.setdiff1d(rows, _held(rows[np.argsort(sizes[rows], kind="stable")], sizes))
    p[rest] = flight(p[rest], sizes[rest])
    return landing(p, sizes) if last else p


def decide(sized: DataFrame, *, source: str = "source", key: str = "doc_id", group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Adds to rows with a size their source_size, target and copies, the number of times that the mix takes them.

    A source with rate r = target / source_size takes each row floor(r) times, and once more by balanced
    sampling with probability r - floor(r). The flight phase runs in groups dealt by a hash of the rows, so a
    large source is spread over all groups; the few rows that a group leaves open for each source meet in the next round,
    until one group for each source is left and lands. ``copies`` never exceeds ``CAP``.

    A null source is a source of its own, last in order. Reruns agree, as groups, order and tosses follow from the rows alone. The rows
    pass through Python, so they should be narrow.
    """
    sized = common.written(sized, "sized")  # texts are read and counted once
    sizes = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    targets = common.written(source_targets(sizes, source=source), "targets")
    matched = sized.alias("d").join(targets.withColumnRenamed(source, "_s").alias("t"), F.col(f"d.{source}").eqNullSafe(F.col("t._s")), "left").drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ready = (
        matched.withColumn("_rate", rate)
        .withColumn("copies", F.floor(F.col("_rate") + EPS).cast("long"))
        .withColumn("_pi", F.greatest(F.col("_rate") - F.col("copies"), F.lit(0.0)))
        .drop("_rate")
    )
    rows = sized.count()
    groups = max(1, -(-rows // group_rows))
    ready = ready.withColumn("_k", F.xxhash64(F.col(key), F.col("size"), F.lit("flight"))).withColumn("_g", F.pmod(F.col("_k"), F.lit(groups)).cast("long"))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "_k", key, "size"], kind="stable", na_position="first").reset_index(drop=True)
        p, s = pdf["_pi"].to_numpy().copy(), pdf["size"].to_numpy()
        for at in pdf.groupby("place", sort=False, dropna=False).indices.values():
            p[at] = settle(p[at], s[at], last)
        pdf["_pi"] = p
        return pdf

    last = groups == 1
    state = common.written(ready.groupBy("_g").applyInPandas(fly, ready.schema), "flight")
    settled = [state.filter("_pi = 0 or _pi = 1")]
    while not last:
        groups = -(-groups // fan_in)
        last = groups == 1
        step = state.filter("_pi > 0 and _pi < 1").withColumn("_g", F.floor(F.col("_g") / fan_in))
        state = common.written(step.groupBy("_g", "place").applyInPandas(fly, ready.schema), "flight")
        settled.append(state.filter("_pi = 0 or _pi = 1"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("copies") + F.col("_pi").cast("long")).drop("_pi", "_k", "_g", "place")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", group_rows: int = GROUP_ROWS, keep_rows: bool = False) -> DataFrame:
    """Adds size, source_size, target and copies (see ``decide``) to documents; only keys and sizes pass through the sampling.

    A null text has size 0 and is taken at its source's rate. Rows equal in key, source and text are separate rows, told apart by a hash of their other columns. An empty
    table, or one without words, takes nothing: targets are 0. Other columns pass through; columns named like the added ones are replaced, and
    with ``keep_rows`` the whole row stands beside them in ``_docs``.
    """
    added = ("size", "source_size", "target", "copies")
    columns = [c for c in docs.columns if c not in added]
    row = F.xxhash64(F.col(key), F.col(source), F.col(source).isNull(), F.col(text))
    # a hash alone may be that of two rows in a large corpus
    narrow = docs.select(F.col(key).cast("long").alias("_key"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), row.alias("_row"))
    decided = decide(narrow, source="_source", key="_row", group_rows=group_rows).withColumn("_key", F.coalesce("_key", F.lit(-(1 << 63))))
    by_row = decided.groupBy("_key", "_row").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("size").alias("size"), F.sort_array(F.collect_list("copies")).alias("_copies"))
    by_row = common.written(by_row, "copies")
    # the user's columns stand apart, so names can't clash
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_docs"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("_key"), row.alias("_row"))
    out = wide.join(by_row.hint("merge"), ["_key", "_row"])  # the same plan at every size
    if by_row.filter(F.size("_copies") > 1).take(1):
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_row").orderBy(F.xxhash64(F.to_json("_docs")))))
    else:
        out = out.withColumn("_n", F.lit(1))
    out = out.withColumn("copies", F.get("_copies", F.col("_n") - 1))
    return out.select(*(F.col(f"_docs.`{c}`").alias(c) for c in columns), *added, *([F.col("_docs").alias("_docs")] if keep_rows else []))


def take(docs: DataFrame, **names: str) -> DataFrame:
    """The mix itself: every row as many times as it is taken."""
    mixed = mix(docs, keep_rows=True, **names).select("_docs", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return mixed.select(*(F.col(f"_docs.`{c}`").alias(c) for c in docs.columns))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The digest of ``decide``: what the mix takes of each document, in words."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return decide(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
