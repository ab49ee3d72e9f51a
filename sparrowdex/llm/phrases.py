"""Phrase collocations by hierarchical pair naming."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST = 30
LONGEST = 4
TOP = 2000
#: Bytes of text whose words are numbered together; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Parts in which keys are counted, one after the other; each needs as much less disk for its exchange.
PASSES = 2
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts in which the best phrases of a language are found before these meet.
PARTS = (1024, 32)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))


def _word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts of one language as sequences of numbers. Of each block one row has ``seq`` (32-bit numbers of its words, -1 between pieces, deflated), and each distinct word has a row with its number ``idx``, ``word`` and count ``c``."""
    schema = "block long, lang string, seq binary, idx int, word string, c long"

    def block(number: int, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        text = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        coded = pc.split_pattern(pa.array([text.decode()], pa.large_string()), " ").flatten().dictionary_encode()
        words, seq = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(seq, minlength=len(words))
        real = ~np.isin(np.arange(len(words)), pc.index_in(pa.array(["", "\n"]), words).drop_null().to_numpy())
        number_of = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
        blank = pc.index_in(pa.scalar(""), words).as_py()
        seq = number_of[seq if blank is None else seq[seq != blank]]
        n = int(real.sum())
        yield _rows(schema_of, [number], [lang], [_squeezed(seq)], [None], [None], [None])
        kept = np.flatnonzero(real)
        for at in range(0, n, 65536):
            m = min(65536, n - at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), pa.array([lang] * m), pa.nulls(m, pa.binary()), pa.array(np.arange(at, at + m, dtype=np.int32)), words.take(pa.array(kept[at : at + m])), pa.array(counts[kept[at : at + m]].astype(np.int64))],
                schema=schema_of,
            )

    schema_of = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("idx", pa.int32()), ("word", pa.string()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 10
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            size.pop(lang)
            number += 1
            yield from block(number - 1, lang, held.pop(lang))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= BLOCK_BYTES:
                    yield from out(lang)
                elif len(size) > 1 and sum(size.values()) >= 2 * BLOCK_BYTES:  # many languages: the largest goes first
                    yield from out(max(size, key=size.get))
        for lang in list(held):
            yield from out(lang)

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)


def _squeezed(seq: np.ndarray) -> bytes:
    """Deflated, as it is written and exchanged; the low bytes of all numbers stand before the next ones."""
    return zlib.compress(np.ascontiguousarray(seq.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _spread(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).reshape(-1).view("<i4")


def _rows(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pair_blocks(seqs: DataFrame, named: DataFrame, last: bool) -> DataFrame:
    """Blocks one level up: each two names side by side become the number of their pair, all else -1.

    ``seqs``: ``block``, ``seq``; ``named``: ``block``, ``idx``, ``gid`` of what is frequent. Of each block one row has the new ``seq`` (not at the last level), and each distinct pair has a row with its number, the names ``left`` and ``right``, and its count.
    """
    schema_of = pa.schema([("block", pa.int64()), ("seq", pa.binary()), ("idx", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("c", pa.int64())])

    def pair(key: tuple, seq: pa.Table, names: pa.Table) -> pa.Table:
        none = schema_of.empty_table()
        if not seq.num_rows or not names.num_rows:
            return none
        was = _spread(seq.column("seq")[0].as_py())
        idx, gid = (names.column(c).to_numpy() for c in ("idx", "gid"))
        local = np.full(max(int(was.max(initial=-1)), int(idx.max())) + 2, -1, np.int64)  # the last entry is for -1
        local[idx] = np.arange(len(idx))
        now = local[was]
        at = np.flatnonzero((now[:-1] >= 0) & (now[1:] >= 0))
        if not len(at):
            return none
        code, number, count = np.unique(now[at] * len(idx) + now[at + 1], return_inverse=True, return_counts=True)
        out = []
        if not last:
            new = np.full(len(now) + 1, -1, np.int32)
            new[at] = number
            new = new[(new >= 0) | np.concatenate([[True], new[:-1] >= 0])]  # one -1 between names is enough
            out.append(pa.Table.from_batches([_rows(schema_of, [key[0].as_py()], [_squeezed(new)], [None], [None], [None], [None])]))
        n = len(code)
        cols = [pa.array(np.full(n, key[0].as_py())), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(gid[code // len(idx)]), pa.array(gid[code % len(idx)]), pa.array(count.astype(np.int64))]
        out.append(pa.table(cols, schema=schema_of))
        return pa.concat_tables(out)

    return seqs.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(pair, "block long, seq binary, idx int, left long, right long, c long")


def _frequent(entries: DataFrame, key: list[str], hashed: bool, least: int) -> DataFrame:
    """Entries of what occurs often enough in all blocks: ``block``, ``idx``, ``gid``, ``f``, and the key in the one row whose place names it.

    A name is the least place (block and number) at which its key stands, so it is unique and the same on every run. One exchange counts and brings the names back to the blocks.
    """
    place = F.shiftleft("block", 32).bitwiseOR(F.col("idx").cast("long"))
    rows = entries.filter("idx is not null").select(place.alias("_at"), "c", *key)
    by = [*(["_h"] if hashed else []), *key]
    if hashed:  # a number sorts faster than a word
        rows = rows.withColumn("_h", F.xxhash64(*key))
    over = Window.partitionBy(*by)
    rows = rows.select("_at", *key, F.sum("c").over(over).alias("f"), F.min("_at").over(over).alias("gid")).filter(F.col("f") >= least)
    own = F.col("_at") == F.col("gid")
    return rows.select(F.shiftright("_at", 32).alias("block"), F.col("_at").bitwiseAND(0xFFFFFFFF).cast("int").alias("idx"), "gid", "f", *(F.when(own, F.col(c)).alias(c) for c in key))


def _best(df: DataFrame, top: int) -> DataFrame:
    """The first rows of each language by score, count and phrase, with their rank; parts of a language are cut to as many rows before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in PARTS:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        df = df.withColumn("_p", salt).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).filter(F.col("_r") <= top).drop("_p", "_r")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def _stored(tag: str, *frames: DataFrame) -> tuple[DataFrame, str]:
    """The frames, one after the other, as one table; what each exchanged goes when it is written, so disk holds one exchange at a time."""
    spark = frames[0].sparkSession
    path, was = common.new_dir(spark, tag), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for df in frames:
            df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(frames[0].schema).parquet(path), path


def _names(entries: DataFrame, key: list[str], hashed: bool, least: int, tag: str) -> DataFrame:
    """See ``_frequent``; the keys are counted in PASSES parts."""
    part = F.pmod(F.xxhash64(F.lit(PASSES), *key), F.lit(PASSES))
    return _stored(tag, *(_frequent(entries.filter(part == p), key, hashed, least) for p in range(PASSES)))[0]


def _units(docs: DataFrame, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Frequent words (``gid``, ``lang``, ``word``, ``f``), then of two words and more (``gid``, ``left``, ``right``, ``f``: the names of their parents, all but the last word and all but the first); and ``lang``, ``n``."""
    spark = docs.sparkSession
    blocks, at = _stored("phrase-words", _word_blocks(docs))
    total = common.written(blocks.groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
    named = _names(blocks, ["lang", "word"], True, least, "phrase-names-1")
    units = [named.filter("word is not null").select("gid", "lang", "word", "f")]
    for k in range(2, LONGEST + 1):
        seqs = blocks.filter("seq is not null").select("block", "seq")
        blocks, now = _stored(f"phrase-pairs-{k}", _pair_blocks(seqs, named.select("block", "idx", "gid"), k == LONGEST))
        common.remove(spark, at)
        at = now
        if k < LONGEST:
            named = _names(blocks, ["left", "right"], False, least, f"phrase-names-{k}")
            units.append(named.filter("left is not null").select("gid", "left", "right", "f"))
        else:
            counts = blocks.groupBy("left", "right").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
            units.append(common.written(counts.select(F.lit(None).cast("long").alias("gid"), "left", "right", "f"), f"phrase-names-{k}"))
            common.remove(spark, at)
    return units, total


def mine_phrases(docs: DataFrame, *, least: int = LEAST, top: int = TOP, cover: int = 80) -> DataFrame:
    """The best phrases of two to four words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase counts wherever its words follow one another between marks and line ends, overlaps included; it is a candidate from ``least`` times on. The score is that of its worst
    cut in two, floor(2000000 a / (l + r)). Candidates that lie in a longer one with ``cover`` hundredths of their count or more are left out: the longer one's own parts of every length
    between count as often as it does at least, so it is enough to look one word further.

    Words become numbers within blocks of texts; what is frequent gets a name that all blocks share, and two names side by side are the next level's entries, so
    a phrase's name leads to both its parents. A null language is ``und``, a null or empty text has no words, equal rows count each, whole texts of any length are read, equal scores go by count and phrase, an empty table gives
    an empty result. Other columns take no part.
    """
    units, total = _units(docs.select("lang", "text"), least)
    known = units[0].select("gid", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    found = None
    for k in range(2, LONGEST + 1):
        left = known.select(*(F.col(c).alias(f"_l_{c}") for c in ("gid", "lang", "phrase", "heads")))
        right = known.select(*(F.col(c).alias(f"_r_{c}") for c in ("gid", "last", "tails")))
        both = units[k - 1].join(left, F.col("left") == F.col("_l_gid")).join(right, F.col("right") == F.col("_r_gid"))
        cuts = F.array(*(F.struct(F.col("_l_heads")[j - 1].alias("l"), F.col("_r_tails")[k - j - 1].alias("r"), F.lit(j).alias("j")) for j in range(1, k)))
        known = both.select(
            "gid",
            F.col("_l_lang").alias("lang"),
            "f",
            F.concat_ws(" ", "_l_phrase", "_r_last").alias("phrase"),
            F.col("_r_last").alias("last"),
            F.concat("_l_heads", F.array("f")).alias("heads"),
            F.concat("_r_tails", F.array("f")).alias("tails"),
            F.array_min(F.transform(cuts, lambda c: F.struct(_score(F.col("f"), c["l"], c["r"]).alias("score"), c["j"], c["l"], c["r"]))).alias("cut"),
        )
        known = common.written(known, f"phrase-known-{k}")
        rows = known.select("gid", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        if k < LONGEST:
            longer = units[k].select(F.explode(F.array("left", "right")).alias("gid"), "f").groupBy("gid").agg(F.max("f").alias("_longer"))
            rows = rows.join(longer, "gid", "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < cover * F.col("a")))
        rows = rows.select("lang", "phrase", "a", "l", "r", "score")
        found = rows if found is None else found.unionByName(rows)
    return _best(found, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)); the product may pass 64 bits, the quotient doesn't."""
    return F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), (left + right).cast("decimal(20,0)"))


def phrase_rows(docs: DataFrame) -> DataFrame:
    return mine_phrases(docs)
