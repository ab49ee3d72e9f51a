"""Many names sought in many texts at once: one pass over each text by an Aho-Corasick automaton."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of one automaton, texts of one group that meets it, and bytes of names up to which one automaton of all names travels to every task.
BLOCK_NAMES = 20_000
GROUP_TEXTS = 2_000
TRAVEL_BYTES = 16 << 20


def automaton(names: list[str]):
    """Finds all of the names, however they overlap; an empty name is left out."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, name in enumerate(names):
        if name:
            found.add_word(name, i)
    if len(found):
        found.make_automaton()
    return found


def met(found, text: str | None) -> set[int]:
    """Numbers of the names that a text holds."""
    return {i for _, i in found.iter(text)} if text and len(found) else set()


def _held(texts: DataFrame, sought: list[str], low: str) -> DataFrame:
    """Rows of texts with ``_s``, one for each of the names that ``low`` holds; the names travel to all tasks."""
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(sought))
    empty = "" in sought
    schema = T.StructType([*texts.schema.fields, T.StructField("_s", T.StringType())])
    stay = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pickle.loads(sent.value)  # noqa: S301 - our own bytes
        found = automaton(names)
        for batch in batches:
            row, name = [], []
            for i, text in enumerate(batch.column(low).to_pylist()):
                hits = [names[j] for j in met(found, text)]
                if empty and text is not None:
                    hits.append("")
                row += [i] * len(hits)
                name += hits
            yield pa.RecordBatch.from_arrays([*batch.select(stay).take(pa.array(row, pa.int64())).columns, pa.array(name, pa.string())], names=[*stay, "_s"])

    return texts.mapInArrow(run, schema)


def _held_own(texts: DataFrame, sought: DataFrame, key: str, low: str) -> DataFrame:
    """The same for names of the texts' own key alone; names and hashes of their keys travel to all tasks, so no text is moved and no key gathers its texts in one task."""
    own: dict[str, set[int]] = {}
    for name, at in sought.select("_s", F.xxhash64(key)).collect():
        own.setdefault(name, set()).add(at)
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(own))
    schema = T.StructType([*texts.schema.fields, T.StructField("_s", T.StringType())])
    stay = texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pickle.loads(sent.value)  # noqa: S301 - our own bytes
        names = list(keys)
        found, empty = automaton(names), keys.get("", set())
        for batch in batches:
            row, name = [], []
            for i, (text, at) in enumerate(zip(batch.column(low).to_pylist(), batch.column("_at").to_pylist(), strict=True)):
                hits = [names[j] for j in met(found, text) if at in keys[names[j]]]
                if at in empty and text is not None:
                    hits.append("")
                row += [i] * len(hits)
                name += hits
            yield pa.RecordBatch.from_arrays([*batch.select(stay).take(pa.array(row, pa.int64())).columns, pa.array(name, pa.string())], names=[*stay, "_s"])

    return texts.withColumn("_at", F.xxhash64(key)).mapInArrow(run, schema)


def _grouped(texts: DataFrame, sought: DataFrame, key: list[str], low: str) -> DataFrame:
    """The same where texts and names (``_s``) must share ``key`` as well, or names don't travel: texts of a key in groups, names in blocks, every group meets every block of its key once.

    A key with many texts has many groups, one with many names many blocks, so no task holds more than one of each.
    """
    stay = texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField("_s", T.StringType())])
    counts = texts.groupBy(*key).agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("_groups")) if key else texts.agg(F.ceil(F.count("*") / GROUP_TEXTS).alias("_groups"))
    blocks = sought.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("_blocks")) if key else sought.agg(F.ceil(F.count("*") / BLOCK_NAMES).alias("_blocks"))
    both = counts.join(blocks, key) if key else counts.join(F.broadcast(blocks))  # a row for each key
    names = [f"_k{i}" for i in range(len(key))]
    both = both.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True)), "_groups", "_blocks")
    same = [F.col(k) == F.col(n) for k, n in zip(key, names, strict=True)]
    with_counts = lambda df: (df.join(both, same) if key else df.join(F.broadcast(both))).filter("_groups > 0 AND _blocks > 0")
    of = F.concat_ws("\0", *(F.col(n).cast("string") for n in names)) if key else F.lit("")
    hashed = [F.col(f"`{f.name}`") for f in texts.schema if "map<" not in f.dataType.simpleString()]
    left = with_counts(texts).withColumns({"_of": of, "_g": F.pmod(F.xxhash64(*hashed), F.col("_groups")), "_b": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))})
    right = with_counts(sought.select("_s", *key)).withColumns({"_of": of, "_b": F.pmod(F.xxhash64("_s"), F.col("_blocks"))}).withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)))

    def run(_: tuple, some: pa.Table, named: pa.Table) -> pa.Table:
        names = list(dict.fromkeys(named.column("_s").to_pylist()))
        found, empty = automaton(names), "" in names
        row, name = [], []
        for i, text in enumerate(some.column(low).to_pylist()):
            hits = [names[j] for j in met(found, text)]
            if empty and text is not None:
                hits.append("")
            row += [i] * len(hits)
            name += hits
        return pa.table([*some.select(stay).take(pa.array(row, pa.int64())).columns, pa.array(name, pa.string())], names=[*stay, "_s"])

    by = ["_of", "_g", "_b"]
    left = left.select(*by, *(F.col(f"`{c}`") for c in stay))
    return left.groupBy(*by).cogroup(right.select(*by, "_s").groupBy(*by)).applyInArrow(run, schema)


def names_in_text(names: DataFrame, texts: DataFrame, *, name: str = "name", text: str = "text") -> DataFrame:
    """Pairs of names and texts that hold them, up to case: the columns of both. Work grows with the texts' length and the pairs found, not with texts times names.

    Each distinct name is sought once. Names of TRAVEL_BYTES at most travel to every task; more are sought in blocks by groups of texts, with the same pairs. A null name or text meets nothing, an
    empty name is in every text; repeated rows are separate pairs; no column of names may have the name of one of texts.
    """
    named = names.withColumn("_n", F.lower(F.col(name)))
    sought = named.select(F.col("_n").alias("_s")).filter("_s IS NOT NULL").distinct()
    size = sought.agg(F.coalesce(F.sum(F.octet_length("_s") + 64), F.lit(0))).first()[0]
    rows = texts.withColumn("_low", F.lower(F.col(text)))
    if size <= TRAVEL_BYTES:
        held = _held(rows, [r[0] for r in sought.collect()], "_low")
    else:
        held = _grouped(rows, sought, [], "_low")
    return held.drop("_low").join(named, F.col("_s") == F.col("_n")).drop("_s", "_n")


def names_in_own_text(names: DataFrame, texts: DataFrame, *, key: str, name: str = "name", text: str = "text") -> DataFrame:
    """Pairs of names and texts that hold them, of the same document; see ``names_in_text``. A null key meets nothing; the result has ``key`` once."""
    theirs = names.withColumn("_n", F.lower(F.col(name))).withColumnRenamed(key, "_key")
    sought = theirs.select(F.col("_key").alias(key), F.col("_n").alias("_s")).filter(F.col("_s").isNotNull() & F.col(key).isNotNull()).distinct()
    rows = texts.filter(F.col(key).isNotNull()).withColumn("_low", F.lower(F.col(text)))
    size = sought.agg(F.coalesce(F.sum(F.octet_length("_s") + 64), F.lit(0))).first()[0]
    alike = dict(sought.dtypes)[key] == dict(rows.dtypes)[key]  # equal keys of other types have other hashes
    held = (_held_own(rows, sought, key, "_low") if size <= TRAVEL_BYTES and alike else _grouped(rows, sought, [key], "_low")).drop("_low")
    return held.join(theirs, (F.col(key) == F.col("_key")) & (F.col("_s") == F.col("_n"))).drop("_s", "_n", "_key")
