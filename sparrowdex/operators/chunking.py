"""Chunkers: fixed windows natively; recursive and structure-aware ones as scans of each document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " ")


def fixed_chunks(docs: DataFrame, *, key: str = "document_id", content: str = "content", size: int = 800, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` characters, each ``overlap`` into the one before; an empty text is one empty chunk."""
    step = size - overlap
    last = F.floor(F.greatest(F.lit(0), F.length(content) - 1) / step).cast("int")
    rows = docs.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(*[c for c in docs.columns if c != content], "chunk_index", F.substring(F.col(content), F.col("chunk_index") * step + 1, F.lit(size)).alias("content"))


def _mapped(docs: DataFrame, key: str, content: str, fields: dict[str, tuple[str, pa.DataType]], make: Callable[[str], Iterator[dict]]) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{key}` {kinds[key]}", *(f"{n} {t}" for n, (t, _) in fields.items())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, cols = [], {n: [] for n in fields}
                for i, text in enumerate(batch.column("_text").to_pylist()):
                    for chunk in make(text or ""):
                        row.append(i)
                        for n in fields:
                            cols[n].append(chunk[n])
                ids = batch.column("_key").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(cols[n], t) for n, (_, t) in fields.items())], names=[key, *fields])

    return docs.select(F.col(key).alias("_key"), F.col(content).alias("_text")).mapInArrow(run, schema)


# -- recursive separators ----------------------------------------------------------------------------


def split_recursive(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of up to ``size`` characters, cut at the coarsest separator that does; the separator at a cut is lost."""
    if len(text) <= size or not separators:
        return [text]
    sep, rest = separators[0], separators[1:]
    out, held = [], ""
    for piece in text.split(sep):
        joined = held + sep + piece if held else piece
        if len(joined) <= size:
            held = joined
            continue
        if held:
            out.append(held)
        if len(piece) > size:
            out += split_recursive(piece, size, rest)
            held = ""
        else:
            held = piece
    if held:
        out.append(held)
    return out


def _header(text: str) -> str | None:
    m = re.search(r"(?m)^#+\s+(.+)$", text)
    return m.group(1).strip() if m else None


def recursive(text: str, size: int = 1000, overlap: int = 200) -> Iterator[dict]:
    raw = split_recursive(text, size)
    for i, part in enumerate(raw):
        body = (raw[i - 1][-overlap:] if i and overlap else "") + part
        if body.strip():
            yield {"chunk_index": i, "content": body.strip(), "section": _header(body)}


def recursive_chunks(docs: DataFrame, *, key: str = "document_id", content: str = "content", size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, content, section). Indexes are given before blank chunks go."""
    fields = {"chunk_index": ("int", pa.int32()), "content": ("string", pa.string()), "section": ("string", pa.string())}
    return _mapped(docs, key, content, fields, lambda t: recursive(t, size, overlap))


# -- structure -----------------------------------------------------------------------------------------

_HEADING = re.compile(r"^(#{1,6})\s+([^\n]*)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def blocks_of(text: str, keep_code: bool = True) -> list[str]:
    """Blocks of a markdown text: fenced code, tables (a table ends with the first line without a pipe, which stays in it), paragraphs."""
    out, held, mode = [], [], None

    def close():
        nonlocal held
        if "\n".join(held).strip():
            out.append("\n".join(held).strip())
        held = []

    for line in text.split("\n"):
        if keep_code and line.strip().startswith("```"):
            held.append(line)
            if mode == "code":
                close()
                mode = None
            else:
                mode = "code"
        elif mode == "code":
            held.append(line)
        elif mode == "table":
            held.append(line)
            if "|" not in line:
                close()
                mode = None
        elif "|" in line and "---" in line:
            mode = "table"
            held.append(line)
        elif not line.strip():
            close()
        else:
            held.append(line)
    close()
    return out


def classify(block: str) -> tuple[str, str | None, int]:
    """(type, section, level) of a block, the first that fits: heading, table, code, list, text."""
    m = _HEADING.match(block)
    if m:
        return "heading", m.group(2).strip(), len(m.group(1))
    if "|" in block and "---" in block:
        return "table", None, 0
    if block.startswith("```") and block.endswith("```"):
        return "code", None, 0
    if re.match(r"[\d*+.-]\s", block):
        return "list", None, 0
    return "text", None, 0


def fixed_words(text: str, size: int) -> list[str]:
    """Parts of at most ``size`` characters, cut at the last blank up to there if it lies in the second half; trimmed after they are measured."""
    cuts = [0]
    while cuts[-1] + size < len(text):
        at = cuts[-1]
        blank = text.rfind(" ", at, at + size + 1)
        cuts.append(blank if blank - at > size / 2 else at + size)
    parts = (text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))
    return [p for p in parts if p]


def sentence_groups(text: str, size: int) -> list[str]:
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    if len(sentences) < 2:
        return fixed_words(text, size)
    out, held = [], ""
    for s in sentences:
        if held and len(held) + len(s) > size:  # the blank between them isn't counted
            out.append(held.strip())
            held = s
        else:
            held = f"{held} {s}" if held else s
    return [*out, held.strip()] if held.strip() else out


def smart(text: str, size: int = 800, overlap: int = 200) -> Iterator[dict]:
    """Structure-aware chunks: tables and code stay whole, headings and sections begin anew, full chunks carry an overlap on."""
    blocks = blocks_of(text)
    total = sum(map(len, blocks))
    if blocks and total > size and total / len(blocks) > 2 * size:
        cut = []
        for b in blocks:
            prose = classify(b)[0] not in ("table", "code")
            cut += sentence_groups(b, size) if prose and len(b) > 2 * size else [b]
        blocks = cut
    held, path, index = "", [], 0
    meta = {"chunk_type": "text", "section": None, "path": []}

    def emit(body: str, m: dict) -> dict:
        nonlocal index
        section = m["section"] or " > ".join(m["path"]) or None
        index += 1
        return {"chunk_index": index - 1, "content": body.strip(), "chunk_type": m["chunk_type"], "section": section}

    for block in blocks:
        kind, section, level = classify(block)
        if kind == "heading":
            path = [*path[: level - 1], section if "\n" not in block else block.lstrip("#").strip()]
        own = {"chunk_type": kind, "section": section, "path": list(path)}
        if kind in ("table", "code"):
            if held.strip():
                yield emit(held, meta)
            held = ""
            yield emit(block, own)
            continue
        if held and (kind == "heading" or (section and section != meta["section"])):
            yield emit(held, meta)
            held = ""
        if held and len(held) + len(block) > size:
            yield emit(held, meta)
            tail = held
            if len(held) > overlap:
                tail = held[-overlap:]
                at = tail.rfind(". ")
                tail = tail[at + 2 :] if at >= 0 else tail
            held = tail
        held = f"{held}\n\n{block}" if held else block
        meta = own
    if held.strip():
        yield emit(held, meta)


def smart_chunks(docs: DataFrame, *, key: str = "document_id", content: str = "content", size: int = 800, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, content, chunk_type, section)."""
    fields = {n: ("int", pa.int32()) if n == "chunk_index" else ("string", pa.string()) for n in ("chunk_index", "content", "chunk_type", "section")}
    return _mapped(docs, key, content, fields, lambda t: smart(t, size, overlap))


def for_model(text: str, most: int) -> Iterator[dict]:
    """Parts of a text for a model's prompt: whole paragraphs, else sentences, else cut off at ``most``."""
    if len(text) <= most:
        if text.strip():
            yield {"chunk_index": 0, "content": text}
        return
    parts, held = [], ""
    for p in re.split(r"\n\n+", text):
        for s in [p] if len(p) <= most else re.split(r"(?<=[.!?])\s+", p):
            s = s[:most]
            glue = "\n\n" if s == p else " "
            if held and len(held) + len(glue) + len(s) > most:
                parts.append(held)
                held = s
            else:
                held = held + glue + s if held else s
    parts.append(held)
    yield from ({"chunk_index": i, "content": p.strip()} for i, p in enumerate(x for x in parts if x.strip()))


def model_chunks(docs: DataFrame, *, key: str = "document_id", content: str = "content", max_chars: int = 5000) -> DataFrame:
    fields = {"chunk_index": ("int", pa.int32()), "content": ("string", pa.string())}
    return _mapped(docs, key, content, fields, lambda t: for_model(t, max_chars))
