"""Full-text search by BM25 over postings."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import EXCEPTIONS
from ..functions.stemmer import stem as stem_word

K1, B = 1.2, 0.75
#: Runs of letters, of digits and of punctuation are tokens each.
CLASSES = r"\p{L}+|\p{Nd}+|\p{P}+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CLASSES), F.lit(0))


def _with_stem(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, _stem) of the distinct terms."""

    @F.pandas_udf("string")
    def stems(t: pd.Series) -> pd.Series:
        return t.map(stem_word)

    # a filter on the stems must not be pushed below the distinct, else every token goes through Python
    return terms.select(term).distinct().withColumn("_stem", stems.asNondeterministic()(F.col(term)))


def stemmed(terms: DataFrame, term: str = "term") -> DataFrame:
    """Stems the distinct terms only; text itself never passes through Python."""
    return terms.join(_with_stem(terms, term), term).withColumn(term, F.col("_stem")).drop("_stem")


def _may_stem_to(token: Column, terms: list[str]) -> Column:
    """False only for tokens whose stem is none of the terms: but for the stemmer's exceptional forms, a stem's first two letters are those of the word.

    Apostrophes at the start go, and letters beyond ASCII may have another lower case in Python, so these tokens all pass.
    """
    begins = sorted({t[:2] for t in terms} | {w[:2] for w, form in EXCEPTIONS.items() if form in terms})
    return F.substring(token, 1, 2).isin(begins) | reduce(lambda c, b: c | token.startswith(b), [b for b in begins if len(b) == 1], F.lit(False)) | token.startswith("'") | (token > "\x7f")


def postings(chunks: DataFrame, *, key: str = "id", content: str = "content", stem: bool = False) -> DataFrame:
    """(key, term, tf, doc_len): the index to keep; one aggregate over the exploded tokens."""
    toks = chunks.select(key, tokens(F.col(content)).alias("_t")).withColumn("doc_len", F.size("_t"))
    rows = toks.select(key, "doc_len", F.explode("_t").alias("term"))
    if stem:
        rows = stemmed(rows.groupBy(key, "doc_len", "term").agg(F.count("*").alias("n"))).groupBy(key, "doc_len", "term").agg(F.sum("n").alias("tf"))
        return rows.select(key, "term", F.col("tf").cast("long"), F.col("doc_len").cast("long"))
    return rows.groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", F.col("doc_len").cast("long"))


def query_terms(query: str, stem: bool = False) -> list[str]:
    import regex

    found = regex.findall(CLASSES, query.lower())
    return list(dict.fromkeys(stem_word(t) if stem else t for t in found))


def bm25(
    chunks: DataFrame, query: str, k: int = 10, *, key: str = "id", content: str = "content", operator: str = "and", stem: bool = False, index: DataFrame | None = None, digits: int = 10
) -> DataFrame:
    """(key, score) of the k best chunks; a blank query has none. Ties by key.

    score = sum over terms of ln(1 + (N - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)). With "and" a chunk needs every term.
    Without an index only chunks that hold a query term are counted in full; lengths and N come from one narrow pass over all.
    """
    k = max(1, int(k))
    terms = query_terms(query, stem)
    if not terms or not query.strip():
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    if index is None:
        # filters on what is made of the tokens would be pushed down and take every text apart again, so blank texts and those without a hit go afterwards
        toks = chunks.select(key, tokens(F.col(content)).alias("_t"))
        stats = toks.select(F.nullif(F.size("_t"), F.lit(0)).cast("long").alias("doc_len"))
        hit = F.filter("_t", lambda t: _may_stem_to(t, terms) if stem else t.isin(terms))
        hits = toks.select(key, F.size("_t").cast("long").alias("doc_len"), hit.alias("_hit"))  # so that rows of terms don't carry all tokens of their text
        index = hits.select(key, "doc_len", F.explode_outer("_hit").alias("term")).filter("term IS NOT NULL")
        if stem:
            forms = _with_stem(index).filter(F.col("_stem").isin(terms))
            index = index.join(F.broadcast(forms), "term").withColumn("term", F.col("_stem"))  # the query terms' own forms: a few words
        index = index.groupBy(key, "doc_len", "term").agg(F.count("*").alias("tf"))
    else:
        stats = index.groupBy(key).agg(F.first("doc_len").alias("doc_len"))
    whole = stats.agg(F.count("doc_len").alias("n_docs"), F.avg("doc_len").alias("mean"))
    found = index.filter(F.col("term").isin(terms))
    df = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("n"))  # reads all that the other arm reads, so both share one exchange
    rated = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))  # one row for each query term, and one row
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean")))
    scores = rated.groupBy(key).agg(F.round(F.sum(part), digits).alias("score"), F.count("*").alias("met"))
    if operator == "and":
        scores = scores.filter(F.col("met") == len(terms))
    return scores.select(key, "score").orderBy(F.desc("score"), key).limit(k)


def is_blank(query: str) -> bool:
    return not re.search(r"\S", query or "")
