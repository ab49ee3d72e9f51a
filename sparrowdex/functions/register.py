"""The engine's functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..sources import parsers
from .stemmer import stem


def register(spark: SparkSession) -> list[str]:
    """Registers kb_stem, kb_strip_html, kb_merge_structural and the table functions kb_chunks, kb_recursive_chunks and kb_blocks."""

    @F.pandas_udf("string")
    def kb_stem(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem(w))

    @F.pandas_udf("string")
    def kb_strip_html(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else parsers.strip_html(h))

    @F.pandas_udf("string")
    def kb_merge_structural(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([parsers.merge_structural(x or "", y or "") for x, y in zip(a, b, strict=True)])

    @udtf(returnType="chunk_index int, content string, chunk_type string, section string")
    class KbChunks:
        def eval(self, text: str, size: int, overlap: int):
            from sparrowdex.operators import chunking

            for c in chunking.smart(text or "", size, overlap):
                yield c["chunk_index"], c["content"], c["chunk_type"], c["section"]

    @udtf(returnType="chunk_index int, content string, section string")
    class KbRecursiveChunks:
        def eval(self, text: str, size: int, overlap: int):
            from sparrowdex.operators import chunking

            for c in chunking.recursive(text or "", size, overlap):
                yield c["chunk_index"], c["content"], c["section"]

    @udtf(returnType="kind string, id string, text string")
    class KbBlocks:
        def eval(self, markdown: str, page: int):
            from sparrowdex.sources import parsers as p

            for b in p.blocks_from_markdown(markdown or "", page):
                yield b["kind"], b["id"], b["text"]

    for name, f in (("kb_stem", kb_stem), ("kb_strip_html", kb_strip_html), ("kb_merge_structural", kb_merge_structural)):
        spark.udf.register(name, f)
    for name, f in (("kb_chunks", KbChunks), ("kb_recursive_chunks", KbRecursiveChunks), ("kb_blocks", KbBlocks)):
        spark.udtf.register(name, f)
    return ["kb_stem", "kb_strip_html", "kb_merge_structural", "kb_chunks", "kb_recursive_chunks", "kb_blocks"]
