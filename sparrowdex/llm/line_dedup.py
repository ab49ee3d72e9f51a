"""Removal of repeated runs of lines by winnowing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A run shorter than GRAM_WORDS is never removed; one of RUN_WORDS or more is always found.
GRAM_WORDS, RUN_WORDS = 30, 50

_RUNS = "array<struct<s:int,e:int>>"


def _lines(body: F.Column) -> F.Column:
    """Lines with words in them: number in the text, hash, words."""
    every = F.transform(
        F.split(body, "\n"),
        lambda x, i: F.struct(i.cast("int").alias("no"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"\S+")).cast("int").alias("n")),
    )
    return F.filter(every, lambda x: x["n"] > 0)


def _grams(lines: F.Column, gram_words: int) -> F.Column:
    """For each line the hash of the shortest run from it with at least that many words (null where the text ends before)."""
    state = lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("bigint").alias("h"))
    gram = lambda i: F.aggregate(
        F.slice(lines, i + 1, F.lit(gram_words)),
        state(F.lit(0), F.lit(0)),
        lambda a, x: F.when(a["w"] >= gram_words, a).otherwise(state(a["w"] + x["n"], F.xxhash64(a["h"], x["h"]))),
        lambda a: F.when(a["w"] >= gram_words, a["h"]),
    )
    return F.transform(lines, lambda _, i: gram(i))


def _selected(worded: str, gram_words: int, run_words: int) -> F.Column:
    """Fingerprints: the least gram (the last of equal ones) of each window of lines that start within run_words - gram_words words.

    Every gram of the window that starts at a run's first line ends within run_words words of that line. So two equal runs of run_words
    words hold the same window, and both select the same gram of it. Each is a struct of the gram g and minus its line, j.
    """
    reach = run_words - gram_words
    state = lambda w, j, best: F.struct(w.cast("int").alias("w"), j.cast("int").alias("j"), best.alias("best"))
    here = lambda x, j: F.when(x["g"].isNotNull(), F.struct(x["g"].alias("g"), (-j).cast("int").alias("j")))

    def least(i: F.Column) -> F.Column:
        return F.aggregate(
            F.slice(worded, i + 1, F.lit(reach + 1)),
            state(F.lit(0), i, F.lit(None).cast("struct<g:bigint,j:int>")),
            lambda a, x: F.when(a["w"] > reach, a).otherwise(state(a["w"] + x["n"], a["j"] + 1, F.least(a["best"], here(x, a["j"])))),
            lambda a: a["best"],
        )

    # numbers are made distinct by their hashes; structs would be laid each against each
    places = F.array_distinct(F.filter(F.transform(F.col(worded), lambda _, i: least(i)["j"]), lambda j: j.isNotNull()))
    return F.transform(places, lambda j: F.struct(F.get(worded, -j)["g"].alias("g"), j.alias("j")))


def _stretches(lines: F.Column, gram_words: int) -> F.Column:
    """Short runs that make up every run of at least gram_words words: the hash of the lines, the first one's place i, and s and e, the numbers of the first and last.

    From each line the shortest run with that many words, and up to each line the shortest one of two lines or more with that many. Those
    within a run cover it, each overlapping another if there are several; whether a run is one of them depends on its lines alone.
    """
    state = lambda w, at: F.struct(w.cast("int").alias("w"), at.cast("int").alias("at"))
    # one number: a long hashes to its halves' difference, so the upper one is the length, which is small
    run = lambda s, e: F.shiftleft((e - s).cast("bigint"), 32) + s

    def onward(i: F.Column) -> F.Column:
        return F.aggregate(
            F.slice(lines, i + 1, F.lit(gram_words)),
            state(F.lit(0), i - 1),
            lambda a, x: F.when(a["w"] >= gram_words, a).otherwise(state(a["w"] + x["n"], a["at"] + 1)),
            lambda a: F.when(a["w"] >= gram_words, run(i, a["at"])),
        )

    def back(i: F.Column) -> F.Column:
        first = F.greatest(i + 1 - max(2, gram_words), F.lit(0))
        return F.aggregate(
            F.reverse(F.slice(lines, first + 1, i + 1 - first)),
            state(F.lit(0), i + 1),
            lambda a, x: F.when((a["w"] >= gram_words) & (a["at"] < i), a).otherwise(state(a["w"] + x["n"], a["at"] - 1)),
            lambda a: F.when((a["w"] >= gram_words) & (a["at"] < i), run(a["at"], i)),
        )

    every = F.concat(F.transform(lines, lambda _, i: onward(i)), F.transform(lines, lambda _, i: back(i)))
    s = lambda r: r.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    e = lambda r: s(r) + F.shiftright(r, 32).cast("int")
    hashed = lambda r: F.aggregate(F.slice(lines, s(r) + 1, e(r) - s(r) + 1), F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x["h"]))
    return F.transform(F.array_distinct(F.filter(every, lambda r: r.isNotNull())), lambda r: F.struct(hashed(r).alias("h"), s(r).alias("i"), F.get(lines, s(r))["no"].alias("s"), F.get(lines, e(r))["no"].alias("e")))


def _joined(runs: DataFrame, row: list[str]) -> DataFrame:
    """Runs (s, e) of each text, sorted, those that overlap as one."""
    before = Window.partitionBy(*row).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*row).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce(F.col("s") > F.max("e").over(before), F.lit(True))
    parts = runs.withColumn("_new", new.cast("int")).withColumn("_part", F.sum("_new").over(upto))
    merged = parts.groupBy(*row, "_part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def _order(docs: DataFrame) -> F.Column:
    """Hash of the whole row, which orders rows that are equal in key and text. Maps are left out, as they have no hash."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))


def repeated_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> tuple[DataFrame, bool]:
    """Runs of lines (s to e, both included, as line numbers) that occur earlier, for each row (_k, _th, _inst); and whether rows recur.

    Texts are ordered by (key, hash of the text, number among equal rows); a null key comes first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row = ["_k", "_th", "_inst"]
    base = common.written(docs.select(_key(key).alias("_k"), F.xxhash64(body).alias("_th"), _order(docs).alias("_o"), _lines(body).alias("lines")), "lines")
    # only rows that agree in _k and _th need numbers
    again = common.written(base.groupBy("_k", "_th").agg(F.count("*").alias("m")).filter("m > 1").select("_k", "_th"), "equal-rows")
    recur = bool(again.take(1))
    if recur:
        several = base.join(again, ["_k", "_th"], "left_semi").withColumn("_inst", F.row_number().over(Window.partitionBy("_k", "_th").orderBy("_o")))
        base = base.join(again, ["_k", "_th"], "left_anti").withColumn("_inst", F.lit(1)).unionByName(several)
    else:
        base = base.withColumn("_inst", F.lit(1))

    worded = base.filter(F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]) >= run_words)
    prints = worded.withColumn("_grams", F.zip_with("lines", _grams(F.col("lines"), gram_words), lambda x, g: F.struct(x["n"].alias("n"), g.alias("g"))))
    prints = prints.select(*row, F.explode(_selected("_grams", gram_words, run_words)).alias("f"))
    prints = common.written(prints.select(*row, F.col("f.g").alias("h"), (-F.col("f.j")).alias("i")), "fingerprints")
    # a run of run_words words has a fingerprint in both texts, so texts without a recurring one are out of it
    shared = prints.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h")
    held = prints.join(shared, "h").select(*row).distinct()
    # the same plan at every size; no row carries more than its stretch
    cut = worded.join(held.hint("merge"), row, "left_semi").select(*row, F.explode(_stretches(F.col("lines"), gram_words)).alias("r")).select(*row, "r.*")
    cut = common.written(cut, "stretches")
    # a stretch goes if it stands anywhere before, which its earliest place tells; so no text needs to meet another
    first = cut.groupBy("h").agg(F.min(F.struct(*row, "i")).alias("f"), F.count("*").alias("m")).filter("m > 1").drop("m")
    later = cut.join(first, "h").filter(F.struct(*row, "i") > F.col("f")).select(*row, "s", "e")
    # overlapping stretches extend a match both ways
    return common.written(_joined(later, row), "runs"), recur


def _key(key: str) -> F.Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))


def drop_repeated_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """Removes from every text the runs of lines that occur earlier, in another text or in itself.

    Lines are compared by hash and whole; blank lines do not count, and go with the run that encloses them. Recurring fingerprints (see ``_selected``)
    tell the texts that repeat something. Of these every stretch (see ``_stretches``) that occurs earlier goes, in whatever text that is. A run
    that is removed has ``gram_words`` words or more; of two equal runs of ``run_words`` words or more the later one is always found. Each line that is removed
    still stands at its earliest place.

    Returns the input's columns with the text cut, and removed_lines (array of struct s, e: first and last line of each removed run). A null text
    stays null, an empty one empty; a text whose every line is repeated becomes empty. Equal rows count as several texts: all but one lose what they
    repeat. Other columns pass through; columns named like removed_lines are replaced.
    """
    runs, recur = repeated_runs(docs, text=text, key=key, gram_words=gram_words, run_words=run_words)
    by = runs.groupBy("_k", "_th").agg(F.collect_list(F.struct("_inst", "runs")).alias("_all"))
    body = F.coalesce(F.col(text), F.lit(""))
    columns = [c for c in docs.columns if c != "removed_lines"]
    # the user's columns stand apart, so names can't clash
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col(text).alias("_text"), _key(key).alias("_k"), F.xxhash64(body).alias("_th"), _order(docs).alias("_o"))
    wide = wide.join(by.hint("merge"), ["_k", "_th"], "left")  # the same plan at every size
    if recur:
        number = F.row_number().over(Window.partitionBy("_k", "_th").orderBy("_o"))
        wide = wide.withColumn("_inst", F.when(F.size("_all") > 0, number).otherwise(F.lit(1)))
    else:
        wide = wide.withColumn("_inst", F.lit(1))
    mine = F.get(F.filter("_all", lambda x: x["_inst"] == F.col("_inst")), 0)["runs"]
    out = wide.withColumn("_runs", F.coalesce(F.when(F.size("_all") > 0, mine), F.array().cast(_RUNS)))

    def kept(lines: F.Column, runs: F.Column) -> F.Column:
        """What stands before each run, and after the last one."""
        until = lambda r: F.coalesce(F.get(runs, r)["s"], F.size(lines))
        since = lambda r: F.when(r == 0, 0).otherwise(F.get(runs, r - 1)["e"] + 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda r: F.slice(lines, since(r) + 1, until(r) - since(r))))

    # through a lambda, so that the text is split once and not for each run
    both = F.transform(F.array(F.struct(F.split("_text", "\n").alias("l"), F.col("_runs").alias("r"))), lambda x: F.array_join(kept(x["l"], x["r"]), "\n"))
    cut = F.when(F.size("_runs") > 0, F.get(both, F.lit(0))).otherwise(F.col("_text"))
    return out.select(*(cut.alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns), F.col("_runs").alias("removed_lines"))


def dedup_rows(docs: DataFrame) -> DataFrame:
    """Every document with its text as it stays and the number of lines that went."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    gone = F.aggregate("removed_lines", F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"] + 1)
    return out.select("doc_id", "text", F.size("removed_lines").alias("removed_runs"), gone.alias("removed_lines"))
