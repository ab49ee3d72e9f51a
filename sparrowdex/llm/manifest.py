"""Merkle manifest of a dataset by superblock reduction: roots per group, one root over the groups, a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 16
#: Levels that one superblock collapses: FANOUT ** LEVELS nodes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place: int, siblings: string>>"


def leaf_of(fields: list[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def _ranged(df: DataFrame, group: list[str], order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of (group, order), and for each range and group what turns a row's number into its place in the group.

    One exchange by ranges, so that a group of any size spreads. ``_at`` of a row is its number in the sorted table, ``_range`` its range; the spans have
    ``_range``, the group, ``_shift`` (to add to ``_at`` for the place from 0) and ``_n``, the group's rows. Rows equal in all keys keep the order in which they were written. Nulls come first.
    """
    rows = common.written(df.withColumn("_tie", F.monotonically_increasing_id()), f"{tag}-rows")
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    rows = common.written(rows, f"{tag}-ranges").withColumn("_range", F.shiftright("_at", 33))
    by = Window.partitionBy(*(group or [F.lit(0)]))
    spans = rows.groupBy("_range", *group).agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    shift = F.sum("_rows").over(by.orderBy("_range")) - F.col("_rows") - F.col("_low")
    spans = spans.select("_range", *group, shift.alias("_shift"), F.sum("_rows").over(by).alias("_n"))
    return rows, common.written(spans, f"{tag}-spans")


def _placed(rows: DataFrame, spans: DataFrame, group: list[str]) -> DataFrame:
    """The rows with ``_i``, their place, and what else the spans have."""
    named = spans.withColumnsRenamed({c: f"_span_{c}" for c in ("_range", *group)})
    same = F.col("_range") == F.col("_span__range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_span_{c}"))
    return rows.join(named, same).withColumn("_i", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift", *(f"_span_{c}" for c in ("_range", *group)))


# -- one superblock -------------------------------------------------------------------------------


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def collapse(nodes: list[str], levels: int, total: int) -> list[list[str]]:
    """Nodes of each level of one superblock, the given ones first: ``levels`` levels up, or to a single node if these are all ``total`` nodes of the group."""
    out = [nodes]
    whole = total == len(nodes)
    while len(out) <= levels and not (whole and len(out[-1]) == 1):
        last = out[-1]
        out.append([_digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _hex(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _blocks(nodes: DataFrame, levels: int, tag: str) -> DataFrame:
    """A row for each superblock of (``_g``, ``_i``, ``_n``, ``_node``): ``_g``, ``_b``, ``_n``, ``_root``, ``_nodes`` (binary digests in order), and of every other column an array.

    Arrow groups in place of pandas ones: a null in a column of whole numbers stays what it is.
    """
    carried = [c for c in nodes.columns if c not in ("_g", "_i", "_n", "_node")]
    kinds = dict(nodes.dtypes)
    schema = "_g long, _b long, _n long, _root string, _nodes binary" + "".join(f", `{c}` array<{kinds[c]}>" for c in carried)
    names = ["_g", "_b", "_n", "_root", "_nodes", *carried]

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        total = rows.column("_n")[0].as_py()
        raw = b"".join(rows.column("_node").to_pylist())
        up = collapse(_hex(raw), levels, total)
        ends = pa.array([0, rows.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in carried]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([total]), pa.array([up[-1][0]]), pa.array([raw]), *lists], names=names)

    block = F.expr(f"_i div {FANOUT**levels}").alias("_b")
    return common.written(nodes.select("*", block).groupBy("_g", "_b").applyInArrow(reduce, schema), tag)


def _opened(blocks: DataFrame, levels: int, carried: list[str], constant: list[str]) -> DataFrame:
    """A row for each node of the superblocks, which have ``_upper``, the path of their roots: ``_g``, ``_i``, ``_node``, ``_path`` up to the very top, the columns carried, the block's own ``constant`` ones."""
    kinds = {f.name: f.dataType for f in blocks.schema}
    schema = f"_g long, _i long, _node string, _path {PATH}" + "".join(f", `{c}` {kinds[c].elementType.simpleString()}" for c in carried) + "".join(f", `{c}` string" for c in constant)
    names = ["_g", "_i", "_node", "_path", *carried, *constant]
    wide = FANOUT**levels

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g, b, n, raw, upper = (batch.column(c)[r].as_py() for c in ("_g", "_b", "_n", "_nodes", "_upper"))
                up = collapse(_hex(raw), levels, n)
                count = len(up[0])
                siblings, ids = [], []  # distinct strings, and for each level those of every node
                place = []
                for level, nodes in enumerate(up[:-1]):
                    base = len(siblings)
                    for at in range(0, len(nodes), FANOUT):
                        run = "".join(nodes[at : at + FANOUT])
                        siblings += [run[: 64 * k] + run[64 * (k + 1) :] for k in range(len(run) // 64)]
                    own = np.arange(count) // FANOUT**level
                    ids.append(base + own)
                    place.append(own % FANOUT)
                for step in upper or []:
                    ids.append(np.full(count, len(siblings)))
                    place.append(np.full(count, step["place"]))
                    siblings.append(step["siblings"])
                depth = len(ids)
                words = pa.array(siblings, pa.string())
                every = np.stack(ids, 1) if depth else np.zeros((count, 0), np.int64)
                places = np.stack(place, 1) if depth else every
                for lo in range(0, count, 512):
                    hi = min(count, lo + 512)
                    steps = pa.StructArray.from_arrays([pa.array(places[lo:hi].ravel().astype(np.int32)), words.take(pa.array(every[lo:hi].ravel()))], names=["place", "siblings"])
                    path = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * depth), steps)
                    cols = [pa.array(np.full(hi - lo, g)), pa.array(np.arange(b * wide + lo, b * wide + hi)), pa.array(up[0][lo:hi]), path]
                    cols += [batch.column(c)[r].values.slice(lo, hi - lo) for c in carried]
                    cols += [pa.array([batch.column(c)[r].as_py()] * (hi - lo), pa.string()) for c in constant]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    body = blocks.select("_g", "_b", "_n", "_nodes", "_upper", *carried, *constant)
    return body.mapInArrow(expand, schema)


def _tree(nodes: DataFrame, levels: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Superblocks of every pass, and (``_g``, ``_root``) of each group.

    A pass turns the superblocks' roots into the nodes of the next one, with FANOUT ** levels times fewer rows, until every group is one superblock.
    """
    wide = FANOUT**levels
    passes = [_blocks(nodes, levels, f"{tag}-0")]
    roots = passes[0].filter(F.col("_n") <= wide).select("_g", "_root")
    while not (more := passes[-1].filter(F.col("_n") > wide)).isEmpty():
        nodes = more.select("_g", F.col("_b").alias("_i"), F.expr(f"(_n + {wide - 1}) div {wide}").alias("_n"), F.unhex("_root").alias("_node"))
        passes.append(_blocks(nodes, levels, f"{tag}-{len(passes)}"))
        roots = roots.unionByName(passes[-1].filter(F.col("_n") <= wide).select("_g", "_root"))
    return passes, roots


def _descended(passes: list[DataFrame], tops: DataFrame, levels: int, carried: list[str], constant: list[str]) -> DataFrame:
    """The first pass's nodes with their whole paths. ``tops``: ``_g``, ``_path`` of each group's root, and the constant columns.

    From the last pass down, each superblock gets its root's path from the superblock above it, one row for each superblock.
    """
    above = None
    for p in reversed(range(len(passes))):
        upper = tops.select("_g", F.lit(0).cast("long").alias("_b"), F.lit(True).alias("_top"), F.col("_path").alias("_upper"), *constant)
        if above is not None:
            upper = upper.unionByName(above.select("_g", F.col("_i").alias("_b"), F.lit(False).alias("_top"), F.col("_path").alias("_upper"), *constant))
        blocks = passes[p].withColumn("_top", F.col("_n") <= FANOUT**levels).join(upper, ["_g", "_b", "_top"])
        above = _opened(blocks, levels, [] if p else carried, constant)
    return above


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root and path of every row: the columns ``order``, ``group``, those of ``carry``, ``leaf``, ``subroot``, ``root`` and ``path``.

    Leaves of a group ascend by ``order``. Every FANOUT nodes become one, level by level, to the group's subroot; the subroots, in the order of the groups, likewise become the root.
    ``path`` has for each level from the leaf to the root the node's place in its run and the run's other digests.

    Nulls: a null field is ``-``; a null ``order`` comes first, a null ``group`` is a group and the first. Rows with one ``order`` ascend by leaf; equal rows are separate leaves beside each
    other. Empty and long texts are whole. An empty table gives an empty result. Other columns, whatever their names, take no part; names of ``carry`` begin with no underscore.
    The driver holds one digest, the root.
    """
    carry = carry or {}
    names = {f"_c_{c}": c for c in carry}
    leaves = docs.select(
        F.col(f"`{group}`").alias("_s"),
        F.col(f"`{order}`").alias("_o"),
        F.unhex(leaf_of([F.col(f"`{c}`") for c in fields])).alias("_node"),
        *(col.alias(f"_c_{c}") for c, col in carry.items()),
    )
    rows, spans = _ranged(leaves, ["_s"], ["_o", "_node"], "leaves")
    groups = spans.select("_s", F.col("_n").alias("_size")).distinct()
    groups = _placed(*_ranged(groups, [], ["_s"], "groups"), []).select(F.col("_s").alias("_own"), F.col("_i").alias("_g"), F.col("_n").alias("_groups"))
    groups = common.written(groups, "group-places")
    spans = spans.join(groups, F.col("_s").eqNullSafe(F.col("_own"))).drop("_own", "_groups")
    nodes = _placed(rows, spans, ["_s"])
    passes, subroots = _tree(nodes, levels, "superblocks")
    tops = subroots.join(groups.select("_g", "_groups"), "_g")
    tops = tops.select(F.lit(0).cast("long").alias("_g"), F.col("_g").alias("_i"), F.col("_groups").alias("_n"), F.unhex("_root").alias("_node"))
    over, top = _tree(tops, levels, "roots")
    root = top.first()
    begin = top.select("_g", F.array().cast(PATH).alias("_path"))
    tops = _descended(over, begin, levels, [], []).select(F.col("_i").alias("_g"), "_path", F.col("_node").alias("_subroot"))
    found = _descended(passes, tops, levels, ["_o", "_s", *names], ["_subroot"])
    return found.select(
        F.col("_o").alias(order),
        F.col("_s").alias(group),
        *(F.col(c).alias(name) for c, name in names.items()),
        F.col("_node").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.lit(root["_root"] if root else None).cast("string").alias("root"),
        F.col("_path").alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""

    def step(node: Column, at: Column) -> Column:
        before = at["place"] * 64
        return F.sha2(F.concat(F.substring(at["siblings"], F.lit(1), before), node, F.substring(at["siblings"], before + 1, F.length(at["siblings"]))), 256)

    return F.aggregate(path, leaf, step)


def manifest_rows(docs: DataFrame) -> DataFrame:
    """Each document's leaf, roots and digest of its proof, and whether a row that was tampered with in one of five cases still leads to the root."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, leaf_of([small if c == "text" else F.col(c) for c in FIELDS]))
    rows = manifest(docs, carry={"tampered": F.unhex(tampered)})
    start = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path.siblings", ""), 256).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
