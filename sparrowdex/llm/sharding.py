"""Sharding by histogram sort."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A sub-range of a shard that one task sorts holds about this many bytes.
RANGE_BYTES = 128 << 20


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    *,
    text: str = "text",
    key: str = "doc_id",
    tolerance: float = 0.005,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Cuts the rows, in the order of (hash of the text, key), into ``shards`` shards of near-equal bytes.

    A row weighs the UTF-8 bytes of its text plus 1. Splitters come from ``common.histogram_splitters``, so
    equal texts lie side by side and a group of any size is cut only where a splitter falls into it. The rows
    are then exchanged once. Each shard is made of several sub-ranges, cut the same way, so no task ever
    holds a whole shard; a row's slot is the exact count of rows in the sub-ranges before it plus its place.

    Nulls: a null text weighs 1 and has the crc of the empty text; a null key sorts first. Rows equal in text
    and key stay together and take neighbouring slots. An empty table gives an empty result. Other columns
    pass through; columns named like the added ones (size, text_crc32, shard, slot) are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    made = docs.withColumns(
        {
            "size": F.octet_length(body).cast("long") + 1,
            "text_crc32": F.crc32(body),
            "_h": F.xxhash64(body),
            "_l": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))),
        }
    )
    narrow = common.written(made.select("_h", "_l", "size"), "shard-keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    per = max(1, -(-total // (shards * range_bytes)))
    splitters, _, _ = common.histogram_splitters(narrow, "_h", "_l", "size", shards * per, tolerance)
    splitters += [common.KEY_MAX - 1] * (shards * per - 1 - len(splitters))
    counts = {r["p"]: r["count"] for r in narrow.groupBy(common.bucket_column("_h", "_l", splitters).alias("p")).count().collect()}
    base, run = [0] * (shards * per), 0
    for p in range(shards * per):
        run = 0 if p % per == 0 else run
        base[p] = run
        run += counts.get(p, 0)
    bases = np.array(base, dtype=np.int64)

    @F.pandas_udf("long")
    def rows_before(p: pd.Series) -> pd.Series:
        return pd.Series(bases[p.to_numpy(np.int64)])

    order = Window.partitionBy("_p").orderBy("_h", "_l")
    return (
        made.withColumn("_p", common.bucket_column("_h", "_l", splitters))
        .withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
        .withColumns({"shard": F.floor(F.col("_p") / per).cast("int"), "slot": F.col("slot") + rows_before(F.col("_p"))})
        .drop("_p", "_h", "_l")
    )


def shard_rows(docs: DataFrame) -> DataFrame:
    """The digest of ``shard_by_bytes`` over documents, under the law of near-equal bytes."""
    return shard_by_bytes(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
