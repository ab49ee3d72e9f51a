"""A stored vector index: cells as partitions, residual product codes, exact scores for what they let through."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector as exact
from .snapshots import Folder, new_folder

#: Vectors of each partition, and centres of all, that the cells are fitted on; vectors that the codes are fitted on.
PART_SAMPLE, MERGE_SAMPLE, CODE_SAMPLE = 2_048, 16_384, 8_192
#: Values of one subspace, and code words of it.
SUBSPACE, CODE_WORDS = 8, 256


def over_fetch(limit: int) -> int:
    """Candidates for so many results."""
    return min(2000, max(limit * 5, 100))


def fitted(x: np.ndarray, weights: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of weighted rows, from the rows that lie farthest from those chosen before; the same for the same rows in the same order."""
    first = int(weights.argmax())
    chosen, gap = [first], ((x - x[first]) ** 2).sum(axis=1) * weights
    while len(chosen) < min(k, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1) * weights)
    centres = x[chosen].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.bincount(near, weights, len(centres))
        for c in np.flatnonzero(total > 0):
            mine = near == c
            centres[c] = (x[mine] * weights[mine, None]).sum(axis=0) / total[c]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def _units(column: pa.Array, width: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


class VectorIndex:
    """Cosine search over vectors that were written cell by cell.

    ``build`` fits ``cells`` centres: each partition fits its own on a sample of its vectors, these are fitted again, weighted. Every vector goes to its nearest centre and gets a byte for each
    SUBSPACE values of what is left to the centre. ``search`` reads the codes of the cells nearest to the query, takes ``over_fetch`` candidates by code, and ranks these by their exact
    similarity. With a scope only candidates in it count. Should fewer than wanted be found, or the index not be there, the whole table is searched.
    An exact search reads the codes of all cells. Each vector's distance from what its code stands for is stored, so the code bounds its similarity; every one whose bound reaches the
    k-th similarity of the candidates is ranked as well, and none is lost.
    Vectors that are null, zero, of another width or not finite are not indexed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    # -- building

    def build(self, vectors: DataFrame, *, key: str = "chunk_id", vector: str = "embedding", cells: int = 16) -> None:
        """Writes the index anew; it counts from its last file on, so readers keep the one before until then."""
        spark = self.spark
        first = vectors.filter(F.size(vector) > 0).select(F.size(vector)).take(1)
        if not first:
            return
        width = first[0][0]
        good = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (exact.norm(F.col(vector)) > 0)
        rows = vectors.filter(good).select(F.col(key).alias("key"), exact.as_double(F.col(vector)).alias("v"))
        centres = self._centres(rows, width, cells)
        words = self._code_words(rows, width, centres)
        at = new_folder()
        sub = len(words)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _units(batch.column("v"), width)
                cell = nearest(x, centres)
                rest = _cut(x - centres[cell], sub)
                code = np.stack([nearest(rest[:, j], words[j]) for j in range(sub)], axis=1).astype(np.uint8)
                off = np.sqrt(sum(((rest[:, j] - words[j][code[:, j]]) ** 2).sum(axis=1) for j in range(sub)))
                raw = pa.array([r.tobytes() for r in code], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cell.astype(np.int32)), raw, pa.array(off)], names=["key", "v", "cell", "code", "off"])

        kind = dict(rows.dtypes)["key"]
        full = rows.mapInArrow(coded, f"key {kind}, v array<double>, cell int, code binary, off double")
        full.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("cell").parquet(f"{self.root}/{at}/rows")
        model = {"at": at, "width": width, "kind": kind, "off": True, "centres": centres.tolist(), "words": [w.tolist() for w in words]}
        while not self.folder.create(f"_lists/{len(self.folder.names('_lists')) + 1:012d}", json.dumps(model)):
            pass

    def _centres(self, rows: DataFrame, width: int, cells: int) -> np.ndarray:
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            kept, marks = np.zeros((0, width)), np.zeros(0, np.int64)
            for batch in batches:  # those with the least hashes, whatever the order
                kept, marks = np.concatenate([kept, _units(batch.column("v"), width)]), np.concatenate([marks, batch.column("h").to_numpy()])
                least = np.argsort(marks, kind="stable")[:PART_SAMPLE]
                kept, marks = kept[least], marks[least]
            if len(kept):
                found = fitted(kept, np.ones(len(kept)), cells)
                count = np.bincount(nearest(kept, found), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), pa.array(count.astype(np.float64))], names=["c", "w"])

        found = rows.select(F.xxhash64("v").alias("h"), "v").mapInArrow(local, "c array<double>, w double")
        some = found.filter("w > 0").orderBy(F.xxhash64("c"), "c").limit(MERGE_SAMPLE).toPandas()
        return fitted(np.stack(some["c"].to_numpy()), some["w"].to_numpy(), cells)

    def _code_words(self, rows: DataFrame, width: int, centres: np.ndarray) -> list[np.ndarray]:
        sub = -(-width // SUBSPACE)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate([_units(b.column("v"), width) for b in batches] or [np.zeros((0, width))])
            rest = _cut(x - centres[nearest(x, centres)], sub)
            for j in range(sub if len(x) else 0):
                w = fitted(rest[:, j], np.ones(len(x)), CODE_WORDS, 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), j)), pa.array(list(w), pa.list_(pa.float64()))], names=["j", "w"])

        some = rows.select(F.xxhash64("v").alias("h"), "v").orderBy("h", "v").limit(CODE_SAMPLE)
        found = some.select("v").coalesce(1).mapInArrow(train, "j long, w array<double>").toPandas()
        return [np.stack(found.loc[found["j"] == j, "w"].to_numpy()) for j in range(sub)]

    # -- searching

    def model(self) -> dict | None:
        for file in reversed(self.folder.names("_lists")):
            try:
                return json.loads(self.folder.text(f"_lists/{file}"))
            except ValueError:  # not written to its end yet
                continue
        return None

    def _rated(self, query: Sequence[float], model: dict, scope: DataFrame | None, probes: int | None = None) -> DataFrame:
        """The stored rows with ``r``, the similarity by code, of the cells nearest to the query (all cells, if no number of them is given) and in the scope."""
        centres, words = np.array(model["centres"]), [np.array(w) for w in model["words"]]
        q = np.asarray(query, np.float64)
        q = q / max(np.sqrt((q**2).sum()), 1e-300)
        base = centres @ q
        parts = _cut(q[None, :], len(words))[0]
        table = np.stack([np.pad(w @ p, (0, CODE_WORDS - len(w))) for w, p in zip(words, parts, strict=True)])

        @F.pandas_udf("double")
        def rated(cell: pd.Series, code: pd.Series) -> pd.Series:
            codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
            return pd.Series(base[cell.to_numpy()] + table[np.arange(len(table))[None, :], codes].sum(axis=1))

        more = ", off double" if model.get("off") else ""
        rows = self.spark.read.schema(f"key {model['kind']}, v array<double>, code binary{more}, cell int").parquet(f"{self.root}/{model['at']}/rows")
        if probes is not None:
            rows = rows.filter(F.col("cell").isin([int(c) for c in np.argsort(-base, kind="stable")[:probes]]))
        if scope is not None:
            rows = rows.join(scope.select(F.col(scope.columns[0]).alias("key")).distinct(), "key", "left_semi")
        return rows.withColumn("r", rated("cell", "code"))

    def candidates(self, query: Sequence[float], limit: int, *, probes: int = 8, scope: DataFrame | None = None, model: dict | None = None) -> DataFrame:
        """(key, cell, v) of the candidates by code; partition pruning reads the probed cells alone."""
        model = model or self.model()
        best = self._rated(query, model, scope, probes).select("key", "cell", "r").orderBy(F.desc("r"), "key").limit(over_fetch(limit)).select("key", "cell")
        return self._rated(query, model, None, probes).select("key", "cell", "v").join(F.broadcast(best), ["key", "cell"])  # over_fetch rows, 2,000 at most

    def search(
        self, query: Sequence[float], k: int = 5, *, probes: int = 8, scope: DataFrame | None = None, table: DataFrame | None = None, key: str = "chunk_id", vector: str = "embedding", whole: bool = False
    ) -> DataFrame:
        """(key, similarity) of the k nearest, ties by key. ``scope``: one column of keys. ``table``: what to search if the index falls short. ``whole``: exactly the k nearest of all that is indexed."""
        model = self.model()
        if model and len(query) == model["width"] and (model.get("off") or not whole):
            near = lambda rows: exact.top_k(rows, query, k, vector="v", key="key").select("key", "similarity").collect()
            found = near(self.candidates(query, k, probes=probes, scope=scope, model=model))
            if whole:  # the margin is that of rounding
                least = found[-1]["similarity"] if len(found) >= k else -2.0
                found = near(self._rated(query, model, scope).filter(F.col("r") + F.col("off") >= least - 1e-9).select("key", "v"))
            if len(found) >= k or table is None:
                return self.spark.createDataFrame(found, f"key {model['kind']}, similarity double")
        if table is None:
            raise ValueError("no index of this width, and no table to search in its place")
        named = table.select(F.col(key).alias("key"), F.col(vector).alias("v"))
        return exact.top_k(named, query, k, vector="v", key="key", scope=scope, scope_key="key").select("key", "similarity")


def _cut(x: np.ndarray, sub: int) -> np.ndarray:
    """Rows as (row, subspace, value), filled up with zeros."""
    return np.pad(x, ((0, 0), (0, sub * SUBSPACE - x.shape[1]))).reshape(len(x), sub, SUBSPACE)


__all__ = ["VectorIndex", "over_fetch"]
