"""The corpus pipeline: toxic documents out, repeated lines out, one document of each near-duplicate group, a mix by source, packed windows.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm import common, jaccard, line_dedup, mixing, packing, toxicity
from sparrowdex.session import ship


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one, so that no name of a user's column clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _widened(out: DataFrame, docs: DataFrame, **made: F.Column) -> DataFrame:
    """The columns of docs again, in their order."""
    return out.select(*(made.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject.

    Null and empty texts have the score of a text without words and stay; equal rows have one score, so all stay or go; a null id is unlabelled; an empty table stays empty.
    Whole texts are scored, however long. All other columns pass through, whatever their names.
    """
    ship(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return _widened(toxicity.score_toxicity(_narrow(docs), model).filter("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that occur earlier; n_chars follows the text.

    A null text stays null; a text whose every line is repeated becomes empty; of rows equal in id and text all but one lose what they repeat, the first by a
    hash of the row; a null id comes first; an empty table stays empty. All other columns pass through, whatever their names.
    """
    ship(spark)
    out = line_dedup.drop_repeated_lines(_narrow(docs))
    if "n_chars" not in docs.columns:
        return _widened(out, docs)
    cut = F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return _widened(out, docs, n_chars=cut)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least (id, hash of the text).

    Null, empty and blank texts are one group; of equal rows one stays; a null id is the least, and rows with null ids or a shared id are grouped by
    their texts alone; an empty table stays empty. All other columns pass through, whatever their names.
    """
    ship(spark)
    return _widened(jaccard.keep_one(_narrow(docs)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them.

    A null text has no words and is taken at its source's rate; a null source is a source; equal rows are separate rows; an empty table stays empty. All
    columns pass through, whatever their names.
    """
    ship(spark)
    return mixing.take(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of tokens.

    A null text is the end id alone; equal rows are packed separately; long texts are cut; an empty table stays empty. Other columns end here.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
#: SQL can't express the classifier, the sampling or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
