"""Files as rows: types, scans and text extraction."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import parsers

MOST_BYTES = 50 * 1024 * 1024

#: Media type of each accepted extension.
MIME = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".heic": "image/heic",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".xml": "application/xml",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".json": "application/json",
    ".jsonl": "application/x-ndjson",
    ".yaml": "text/yaml",
    ".yml": "text/yaml",
    ".toml": "application/toml",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".rtf": "application/rtf",
    ".epub": "application/epub+zip",
    ".doc": "application/msword",
    ".xls": "application/vnd.ms-excel",
    ".ppt": "application/vnd.ms-powerpoint",
    ".odt": "application/vnd.oasis.opendocument.text",
    ".ods": "application/vnd.oasis.opendocument.spreadsheet",
    ".gltf": "model/gltf+json",
    ".glb": "model/gltf-binary",
    ".log": "text/plain",
    ".ini": "text/plain",
    ".env": "text/plain",
    ".py": "text/x-python",
    ".ts": "text/typescript",
    ".tsx": "text/typescript",
    ".js": "text/javascript",
    ".jsx": "text/javascript",
    **dict.fromkeys([".go", ".rs", ".java", ".c", ".cpp", ".h", ".rb", ".php", ".sh", ".sql", ".r", ".swift", ".kt"], "text/plain"),
}
#: The first extension of each media type.
EXTENSION = {m: e for e, m in reversed(MIME.items())}
ACCEPTED = list(MIME)
CHAT_MIMES = sorted(set(MIME.values()) - {"image/heic"})


def is_document_mime(mime: str) -> bool:
    return mime in EXTENSION or mime == "text/xml"


def is_chat_mime(mime: str) -> bool:
    return mime in CHAT_MIMES



def mime_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), T.extension(name))


def file_type(name: Column) -> Column:
    """markdown, pdf, image, document or text; null if it isn't supported."""
    ext = T.extension(name)
    return (
        F.when(ext.isin(".md", ".markdown"), "markdown")
        .when(ext == ".pdf", "pdf")
        .when(ext.isin(T.IMAGES), "image")
        .when(ext.isin(".docx", ".xlsx", ".pptx", ".rtf", ".epub", ".doc", ".xls", ".ppt", ".odt", ".ods", ".gltf", ".glb"), "document")
        .when(ext.isin(ACCEPTED), "text")
    )


def scan_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all supported files below a folder; a missing folder has none. Bytes are read only where they are used."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "path string, modificationTime timestamp, length long, content binary"
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(T.extension(F.col("path")).isin(ACCEPTED))


def accepted(files: DataFrame) -> DataFrame:
    """Adds rejection: why a file is not taken, null if it is."""
    ext = T.extension(F.col("path"))
    why = F.when(~ext.isin(ACCEPTED), "unsupported type").when(F.col("length") > MOST_BYTES, "too large")
    return files.withColumn("rejection", why)


_EXTRACTED = "path string, text string, pages array<struct<page:int,text:string>>, error string"


def extract(files: DataFrame, *, ocr: Callable[[bytes, str], str] | None = None) -> DataFrame:
    """(path, text, pages, error) of files (path, content). A file that can't be read has an error and no text, and stops no other.

    A column ``mime``, if there is one, decides on the reader before the extension does, whatever its case and parameters; plain text, types that are not known and nulls leave it to the extension.
    Markup is stripped natively elsewhere (``functions.text``); here every format is decoded file by file. Images and scans go to ``ocr``.
    """
    kinds = {m: e for m, e in EXTENSION.items() if m != "text/plain"} | {"text/xml": ".xml"}

    def run(frames):
        for pdf in frames:
            rows = [parsers.extract_one(str(p), bytes(c) if c is not None else b"", ocr, kinds.get(m)) for p, c, m in zip(pdf["path"], pdf["content"], pdf["mime"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"])

    mime = F.trim(F.lower(F.substring_index("mime", ";", 1))) if "mime" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", mime.alias("mime")).mapInPandas(run, _EXTRACTED)


def process_files(files: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Texts, and the files that failed."""
    rows = extract(files, **options)
    return rows.filter("error IS NULL"), rows.filter("error IS NOT NULL").select("path", "error")


def with_fallback(first: DataFrame, second: DataFrame, *, key: str = "path", sufficient: Column | None = None) -> DataFrame:
    """The first extraction where it worked (and is ``sufficient``), else the second; if both failed, both errors."""
    a = first.select(key, F.col("text").alias("_a"), F.col("error").alias("_ea"), (F.lit(True) if sufficient is None else sufficient).alias("_ok"))
    b = second.select(key, F.col("text").alias("_b"), F.col("error").alias("_eb"))
    rows = a.join(b, key, "full_outer")
    good = F.col("_a").isNotNull() & F.col("_ea").isNull() & F.col("_ok")
    text = F.when(good, F.col("_a")).when(F.col("_eb").isNull() & F.col("_b").isNotNull(), F.col("_b"))
    error = F.when(text.isNull(), F.concat_ws("; ", F.coalesce("_ea", F.lit("text layer not sufficient")), F.coalesce("_eb", F.lit("no fallback"))))
    used = F.when(good, "first").when(text.isNotNull(), "second")
    return rows.select(key, text.alias("text"), error.alias("error"), used.alias("used"))


def first_text(rows: DataFrame, providers: list[str]) -> DataFrame:
    """text: the first non-blank column of the providers, in order; provider tells which."""
    text = F.coalesce(*[F.when(T.trim(F.col(p)) != "", F.col(p)) for p in providers])
    name = F.coalesce(*[F.when(T.trim(F.col(p)) != "", F.lit(p)) for p in providers])
    return rows.withColumns({"text": text, "provider": name})


def merge_extractions(structural: DataFrame, text_layer: DataFrame, *, key: str = "path") -> DataFrame:
    """Both extractions of a file merged (``parsers.merge_structural``); where only one worked, that one."""

    @F.pandas_udf("string")
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([parsers.merge_structural(x or "", y or "") for x, y in zip(a, b, strict=True)])

    a, b = structural.select(key, F.col("text").alias("_a"), F.col("error").alias("_ea")), text_layer.select(key, F.col("text").alias("_b"), F.col("error").alias("_eb"))
    rows = a.join(b, key, "full_outer")
    neither = F.col("_a").isNull() & F.col("_b").isNull()
    return rows.select(key, F.when(~neither, merged(F.coalesce("_a", F.lit("")), F.coalesce("_b", F.lit("")))).alias("text"), F.when(neither, F.concat_ws("; ", "_ea", "_eb")).alias("error"))


def join_segments(segments: DataFrame, *, key: str = "path", glue: str = "\n\n") -> DataFrame:
    """Texts of a file's segments in order, whatever order they came in; usage summed."""
    listed = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("l"), *([F.sum("tokens").alias("tokens")] if "tokens" in segments.columns else []))
    return listed.withColumn("text", F.array_join(F.transform("l", lambda x: x["text"]), glue)).drop("l")


#: What a table or figure is asked of a reader model.
OCR_COMMANDS = {"table": "Table Recognition:", "form": "Table Recognition:", "figure": "Figure Recognition:"}


def ocr_command(document_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OCR_COMMANDS.items() for x in kv]), document_type), F.lit("Text Recognition:"))


def ocr_model(document_type: Column, routes: dict[str, str]) -> Column:
    """Model for a type of document: handwritten, table (and form), figure; else the default."""
    return F.when(document_type == "handwritten", routes["handwritten"]).when(document_type.isin("table", "form"), routes["table"]).when(document_type == "figure", routes["figure"]).otherwise(routes["default"])
