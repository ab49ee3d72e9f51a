"""Approximate nearest neighbours: a small-world graph for each shard, and their merged answers."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a shard, links of a node (twice as many on the ground level), breadth while building and while searching, queries of a block, blocks of a task.
SHARD_ROWS, LINKS, BUILD, SEARCH, BLOCK, BLOCKS = 4096, 12, 48, 96, 256, 16


class Graph:
    """Hierarchical navigable small world over unit vectors (by scalar product).

    Neighbours are flat integer arrays, one for each level, with a row of fixed width for each node of that level (-1: none); ``rows`` gives a node's row.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 1):
        self.v, self.links = vectors, links
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 8)
        top = int(self.level.max()) if n else -1
        self.rows, self.near = [], []
        for l in range(top + 1):
            members = np.flatnonzero(self.level >= l)
            row = np.full(n, -1, np.int32)
            row[members] = np.arange(len(members))
            self.rows.append(row)
            self.near.append(np.full((len(members), self.width(l)), -1, np.int32))
        self.entry = -1
        for i in range(n):
            self._insert(i, build)

    def width(self, level: int) -> int:
        return 2 * self.links if level == 0 else self.links

    def _layer(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """Nodes nearest to q on a level, found from the starts: (similarity, node), best first."""
        row, near, v = self.rows[level], self.near[level], self.v
        seen = {i for _, i in starts}
        open_ = [(-s, i) for s, i in starts]
        best = list(starts)
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= breadth and -s < best[0][0]:
                break
            new = [j for j in near[row[i]].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            for t, j in zip((v[new] @ q).tolist(), new, strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (t, j))
                    heapq.heappush(open_, (-t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                    heapq.heappush(open_, (-t, j))
        return sorted(best, reverse=True)

    def _select(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of the candidates, best first, those that are nearer to the node than to one chosen before; then the nearest of the rest."""
        if len(found) <= most:
            return [j for _, j in found]
        ids = [j for _, j in found]
        among = (self.v[ids] @ self.v[ids].T).tolist()
        chosen: list[int] = []
        spare: list[int] = []
        for a, (s, _) in enumerate(found):
            if len(chosen) >= most:
                break
            line = among[a]
            (spare if any(line[b] > s for b in chosen) else chosen).append(a)
        return [ids[a] for a in (chosen + spare)[:most]]

    def _insert(self, i: int, build: int) -> None:
        q, top = self.v[i], int(self.level[i])
        if self.entry < 0:
            self.entry = i
            return
        high = int(self.level[self.entry])
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for l in range(high, top, -1):
            at = self._layer(q, at[:1], 1, l)
        for l in range(min(high, top), -1, -1):
            at = self._layer(q, at, build, l)
            chosen = self._select(at, self.links)
            mine = self.near[l][self.rows[l][i]]
            mine[: len(chosen)] = chosen
            for j in chosen:
                theirs = self.near[l][self.rows[l][j]]
                free = np.flatnonzero(theirs < 0)
                if len(free):
                    theirs[free[0]] = i
                    continue
                ids = [*theirs.tolist(), i]
                ranked = sorted(zip((self.v[ids] @ self.v[j]).tolist(), ids, strict=True), reverse=True)
                kept = self._select(ranked, len(theirs))
                theirs[:] = -1
                theirs[: len(kept)] = kept
        if top > high:
            self.entry = i

    def search(self, q: np.ndarray, breadth: int = SEARCH) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [(float(self.v[self.entry] @ q), self.entry)]
        for l in range(int(self.level[self.entry]), 0, -1):
            at = self._layer(q, at[:1], 1, l)
        return self._layer(q, at, breadth, 0)

    # flat form

    def dump(self) -> dict:
        return {
            "entry": int(self.entry),
            "levels": self.level.astype(np.int8).tobytes(),
            "neighbours": [x.tobytes() for x in self.near],
        }

    @classmethod
    def load(cls, vectors: np.ndarray, entry: int, levels: bytes, neighbours: list[bytes], links: int = LINKS) -> Graph:
        self = cls.__new__(cls)
        self.v, self.links, self.entry = vectors, links, entry
        self.level = np.frombuffer(levels, np.int8)
        self.rows, self.near = [], []
        for l, raw in enumerate(neighbours):
            members = np.flatnonzero(self.level >= l)
            row = np.full(len(vectors), -1, np.int32)
            row[members] = np.arange(len(members))
            self.rows.append(row)
            self.near.append(np.frombuffer(raw, np.int32).reshape(len(members), self.width(l)))
        return self


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, v): rows whose vectors are neither null nor zero and hold finite numbers only, in double precision."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _tame(v: np.ndarray) -> np.ndarray:
    """Vectors (rows) times powers of two, so that their squares neither overflow nor vanish; cosines stay what they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) + 0.0  # -0 is 0


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of equal rows, and which of these each row is."""
    flat = np.ascontiguousarray(rows)
    _, first, which = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, which


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: its distinct vectors, the distinct ids of each, the distinct directions with their vectors, and the graph over these in flat arrays.

    Shards are dealt by a hash of the id, so no vector and no region of the space gathers in one. Vectors of one direction (in single precision) are one node.
    """
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    schema = "dim int, shard int, vectors binary, nodes binary, starts binary, ids binary, entry int, levels binary, neighbours array<binary>"

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = _tame(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        first, which = _distinct(v)
        unit = v[first] / np.sqrt((v[first] ** 2).sum(axis=1))[:, None]
        heads, node = _distinct(unit.astype(np.float32) + np.float32(0))
        by_node = np.argsort(node, kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_node] = np.arange(len(first))
        ids = pdf["id"].to_numpy(np.int64)
        order = np.lexsort((ids, place[which]))
        at, each = place[which][order], ids[order]
        once = np.ones(len(order), bool)  # an id of several equal rows is at its vector once
        once[1:] = (at[1:] != at[:-1]) | (each[1:] != each[:-1])
        at, each = at[once], each[once]
        made = {
            "vectors": v[first][by_node].tobytes(),
            "nodes": np.searchsorted(node[by_node], np.arange(len(heads) + 1)).astype(np.int32).tobytes(),
            "starts": np.searchsorted(at, np.arange(len(first) + 1)).astype(np.int32).tobytes(),
            "ids": each.tobytes(),
        }
        return pd.DataFrame([{"dim": key[0], "shard": key[1], **made, **Graph(unit[heads].astype(np.float32)).dump()}])

    return common.written(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graphs")


def search(queries: DataFrame, index: DataFrame, k: int = 5, breadth: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the shards' graphs find for each query (id, dim, v), nearest first.

    Queries go to every shard in blocks; a task has one shard and some blocks. Scores are cosines in double precision of the vectors as given; ties go to the
    smaller id, among all vectors of the directions found. A row with the query's id is not its own neighbour. Rows that share an id count once, by their best score.
    """
    spread = index.select("dim", "shard")
    count = queries.count()
    blocks = max(1, -(-count // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("q"))
    asked = asked.join(spread, "dim").withColumn("part", F.floor(F.col("block") / BLOCKS).cast("int"))  # queries against all shards, in blocks
    parts = index.join(asked.select("dim", "shard", "part").distinct(), ["dim", "shard"])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            s = left.iloc[0]
            vectors = np.frombuffer(s["vectors"], np.float64).reshape(-1, key[0])
            length = np.sqrt((vectors**2).sum(axis=1))
            nodes, starts, ids = np.frombuffer(s["nodes"], np.int32), np.frombuffer(s["starts"], np.int32), np.frombuffer(s["ids"], np.int64)
            heads = nodes[:-1]
            graph = Graph.load((vectors[heads] / length[heads][:, None]).astype(np.float32), int(s["entry"]), s["levels"], list(s["neighbours"]))
            for block in right["q"]:
                for q in block:
                    v = _tame(np.asarray(q["v"], np.float64))
                    at = np.concatenate([np.arange(nodes[j], nodes[j + 1]) for _, j in graph.search((v / np.sqrt((v**2).sum())).astype(np.float32), breadth)])
                    score = (vectors[at] * v).sum(axis=1) / (length[at] * np.sqrt((v**2).sum()))
                    best = np.argsort(-score, kind="stable")
                    # k + 1 vectors hold k ids but the query's own, if ids are distinct; more are looked at where they are not, and through ties
                    found: dict[int, float] = {}
                    last = -2.0
                    for j in best.tolist():
                        if len(found) >= k and score[j] < last:
                            break
                        last = float(score[j])
                        mine = ids[starts[at[j]] : starts[at[j] + 1]]
                        for i in [x for x in mine[: k + 1].tolist() if x != q["id"]][:k]:
                            found.setdefault(i, last)
                    for i, sc in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]:
                        out["query_id"].append(q["id"])
                        out["vec_id"].append(i)
                        out["score"].append(sc)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    by = ["dim", "shard", "part"]
    parts = parts.withColumnsRenamed({c: f"_{c}" for c in by})  # the two sides share columns otherwise
    each = parts.groupBy(*(f"_{c}" for c in by)).cogroup(asked.select(*by, "q").groupBy(*by)).applyInPandas(run, "query_id long, vec_id long, score double")
    once = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(vectors: DataFrame, *, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose key is divisible by ``every``, among all other rows.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null key; vectors are compared with
    those of the same length. An empty table gives an empty result; with fewer than k candidates all are returned. Other columns are not read.
    """
    rows = common.written(usable(vectors, key, vector), "vectors")
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    return search(queries, build_index(rows), k)
