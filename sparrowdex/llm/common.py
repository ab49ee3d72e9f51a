"""What the training-data operators share: tables, scratch space and exact splitters."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}
#: With it a query's shuffle files go when the query ends, not when the driver next collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: the one in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    key = spark.sparkContext.applicationId
    if key not in _SCRATCH:
        _SCRATCH[key] = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
    return _SCRATCH[key]


def new_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/sparrowdex-{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system; a stopped session has nothing to delete with."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - at exit the gateway may be gone
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor loses none of it. Its shuffle files end with the write."""
    spark = df.sparkSession
    path, before = new_dir(spark, tag), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes what ``written`` wrote, if nothing reads it any more; the driver's end would."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)


# -- composite integer keys -------------------------------------------------------------------

_HALF = 1 << 63
KEY_MIN, KEY_MAX = 0, (1 << 128)


def to_key(high: int, low: int) -> int:
    """Two signed longs as one unsigned integer of 128 bits that sorts as the pair does."""
    return ((int(high) + _HALF) << 64) | (int(low) + _HALF)


def split_key(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & ((1 << 64) - 1)) - _HALF


def bucket_of(high: np.ndarray, low: np.ndarray, splitters: list[int]) -> np.ndarray:
    """For each pair the number of splitters that are not above it."""
    pairs = [split_key(k) for k in splitters]
    sh = np.array([p[0] for p in pairs], dtype=np.int64)
    sl = np.array([p[1] for p in pairs], dtype=np.int64)
    first, last = np.searchsorted(sh, high, "left"), np.searchsorted(sh, high, "right")
    out = first.astype(np.int64)
    for a, b in set(zip(first[first < last].tolist(), last[first < last].tolist(), strict=True)):
        rows = (first == a) & (last == b)
        out[rows] = a + np.searchsorted(sl[a:b], low[rows], "right")
    return out


def bucket_column(high: str, low: str, splitters: list[int]) -> F.Column:
    @F.pandas_udf("long")
    def bucket(h: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(h.to_numpy(np.int64), l.to_numpy(np.int64), splitters))

    return bucket(F.col(high), F.col(low))


def histogram_splitters(
    keyed: DataFrame, high: str, low: str, weight: str, parts: int, tolerance: float = 0.005, probes: int = 64
) -> tuple[list[int], int, int]:
    """Splitters that cut the rows, in the order of the pair (high, low), into parts of near-equal weight.

    Histogram sort: each pass counts the exact weight below candidate boundaries in every partition
    (one partial aggregate, probes + 1 small rows), keeps for each target the interval that holds it,
    shrinks that interval to the keys that occur in it, and probes it again, until each splitter is within
    ``tolerance`` of a part of its target or a single key is left. Rows with the same pair are never parted.
    Returns the splitters (ascending, perhaps repeated), the total weight and the number of passes.
    """
    spark = keyed.sparkSession
    whole = keyed.agg(F.sum(weight), F.min(F.struct(high, low)), F.max(F.struct(high, low))).first()
    total = whole[0] or 0
    if not total or parts < 2:
        return [], total, 1
    bottom, top = to_key(*whole[1]), to_key(*whole[2]) + 1
    slack = tolerance * total / parts
    targets = [total * i / parts for i in range(1, parts)]
    # interval: keys lo..hi, with the weight below lo and below hi
    state = [[bottom, top, 0, total] for _ in targets]
    done: list[int | None] = [None] * len(targets)
    passes = 1
    while any(d is None for d in done):
        each = max(3, min(probes, 4096 // sum(d is None for d in done)))
        cuts: set[int] = set()
        for (lo, hi, _, _), d in zip(state, done, strict=True):
            if d is None:
                step = max(1, (hi - lo) // (each + 1))
                cuts.update(range(lo, hi, step) if (hi - lo) <= each + 1 else (lo + step * j for j in range(each + 2)))
                cuts.add(hi)
        probe = sorted(c for c in cuts if c < KEY_MAX)
        rows = (
            keyed.select(bucket_column(high, low, probe).alias("b"), F.col(high).alias("h"), F.col(low).alias("l"), F.col(weight).alias("w"))
            .groupBy("b")
            .agg(F.sum("w").alias("w"), F.min(F.struct("h", "l")).alias("first"), F.max(F.struct("h", "l")).alias("last"))
            .collect()
        )
        passes += 1
        below, spans, run = [], {}, 0
        by = {r["b"]: r for r in rows}
        for i in range(len(probe) + 1):
            if i:
                below.append(run)  # weight below probe[i - 1]
            if i in by:
                spans[i] = (to_key(*by[i]["first"]), to_key(*by[i]["last"]) + 1)
                run += by[i]["w"]
        edges = np.array(below, dtype=float)
        for t, target in enumerate(targets):
            if done[t] is not None:
                continue
            j = int(np.searchsorted(edges, target, "right"))  # probe[j - 1] is at or below the target
            near = min((c for c in (j - 1, j) if 0 <= c < len(probe)), key=lambda c: abs(below[c] - target))
            lo, hi = spans.get(j, (probe[min(j, len(probe) - 1)],) * 2)
            if abs(below[near] - target) <= slack or hi - lo <= 1:
                done[t] = probe[near]
            else:
                state[t] = [lo, hi, 0, 0]
    return sorted(d for d in done if d is not None), total, passes


def hadoop_uri(path: str) -> str:
    """A path with a scheme that pyarrow's file systems understand (file:/x becomes file:///x)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else "file://" + path
