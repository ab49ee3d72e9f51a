"""Packing token sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END_ID = 1
#: Rows whose remainders one packing group holds; a group wastes one window at most.
GROUP_ROWS = 16384
#: Entries that a worker's cache of encoded words holds before it starts anew.
CACHE_WORDS = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    If the same vocabulary lies beside the tokenizer's file as ranks, texts of Latin letters are merged by those, which gives the
    same ids several times faster. Other texts go to the tokenizer itself, word by word through a cache: the vocabulary splits text by a
    pattern in which a space that stands before a non-space always begins a new piece, so a text cut at such spaces encodes to
    the concatenation of its parts. Texts that hold a special token's string are encoded whole. Texts with 1,000 characters of white space
    on end go to the tokenizer in any case, as the ranks' pattern is slow there or runs out of stack; the ids are the same.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.ranks = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _encode(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def parts(self, text: str) -> list[str]:
        return _BEFORE_WORD.split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        split: dict[int, list[str]] = {}
        for t in texts:
            if any(s in t for s in self.special):
                out.append(self._encode([t])[0])
            elif self.ranks is not None and _latin(t) and not _LONG_BLANK.search(t):
                out.append(array("I", self.ranks.encode_ordinary(t)).tobytes())
            else:
                split[len(out)] = self.parts(t)
                out.append(None)
        if split:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            miss = list({p: None for ps in split.values() for p in ps if p not in self.cache})
            if miss:
                self.cache.update(zip(miss, self._encode(miss), strict=True))
            for i, ps in split.items():
                out[i] = b"".join(map(self.cache.__getitem__, ps))
        return out


#: A space before what is no space begins a part.
_BEFORE_WORD = re.compile(r"(?= \S)")
#: White space so long that the ranks' pattern, which goes back from its end, takes its square in time, or runs out of stack.
_LONG_BLANK = re.compile(r"\s{1000}")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _free(name: str, taken: list[str]) -> str:
    """A column's name that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def tokenize_pieces(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, adds the end id, and cuts it into full windows and one remainder.

    Returns the input's columns but the text, and start, length, ids_crc32 and doc_tokens of each piece (and
    its ids, if asked for); columns of these names are replaced. A null text counts as empty: it is the end id alone.
    """
    path = tokenizer or default_tokenizer()
    keep = [c for c in docs.columns if c not in (text, "start", "length", "ids_crc32", "doc_tokens", "ids")]
    kept = [F.col(f"`{c}`") for c in keep]
    whole_text = _free("_text", keep)
    body = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(whole_text))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in body.select(*kept).dtypes), "start long, length long, ids_crc32 long, doc_tokens long"])
    schema += ", ids array<int>" if with_ids else ""
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                row, start, length, crc, tokens, ids = [], [], [], [], [], []
                for i, raw in enumerate(enc.encode(batch.column(whole_text).to_pylist())):
                    raw = memoryview(raw + end)
                    for s in range(0, len(raw), width):
                        piece = raw[s : s + width]
                        row.append(i)
                        start.append(s // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        tokens.append(len(raw) // 4)
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                out = batch.select(keep).take(pa.array(row, pa.int64()))
                cols = [*out.columns, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
                names = [*keep, "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names)

    return body.mapInArrow(run, schema)


def fill_windows(counts: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Multisets of lengths, one for each window, that use every given length up.

    Minimum bin slack: each window takes the longest remaining length; a bitset of reachable sums over the
    remaining lengths, longest first and with their counts in binary portions, then tells the sum nearest to
    what is left of the capacity, and backtracking tells how many of each length make it.
    """
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    windows = []
    while left:
        while order and order[0] not in left:
            order.pop(0)
        seed = order[0]
        window = {seed: 1}
        left[seed] -= 1
        if not left[seed]:
            del left[seed]
        room = capacity - seed
        mask = (1 << (room + 1)) - 1
        reach, steps = 1, []
        for n in order:
            c = min(left.get(n, 0), room // n)
            k = 1
            while c > 0:
                k = min(k, c)
                steps.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                c -= k
                k *= 2
            if reach >> room:
                break
        total = reach.bit_length() - 1
        for n, k, before in reversed(steps):
            if not (before >> total) & 1:
                total -= n * k
                window[n] = window.get(n, 0) + k
                left[n] -= k
                if not left[n]:
                    del left[n]
        windows.append(window)
    return windows


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, order: str = "doc_id") -> DataFrame:
    """Gives each piece a sequence and an offset in it.

    Full pieces are sequences of their own. Remainders are dealt into groups by a hash of (order, start, crc),
    so no key or source gathers in a group, and each group is filled by ``fill_windows``. Adds sequence_id (unique, not gapless) and offset.

    Nulls: a null ``order`` comes first. Ties: pieces of one length are taken by (order, start, crc); equal rows are separate pieces, and either may stand first.
    An empty table gives an empty result. Other columns pass through; columns named sequence_id or offset are replaced. Padding: the last windows of each group of ``group_rows`` remainders may be short.
    """
    taken = ("sequence_id", "offset")
    if order.lower() in taken:
        raise ValueError(f"pieces can't be ordered by {order}, which is a result")
    pieces = common.written(pieces.drop(*taken), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_rows))
    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    number = _free("_g", names)

    # Arrow and not pandas, where a null among whole numbers makes fractions of them
    def fill(key: tuple, table: pa.Table) -> pa.Table:
        keys = [("length", "descending"), (order, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.select(names).take(pc.sort_indices(table.select([k for k, _ in keys]), sort_keys=keys, null_placement="at_start"))
        lengths = table.column("length").to_numpy()
        rows = {int(n): list(np.flatnonzero(lengths == n)[::-1]) for n in np.unique(lengths)}
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for w, window in enumerate(fill_windows({n: len(r) for n, r in rows.items()}, capacity)):
            at = 0
            for n in sorted(window, reverse=True):
                for _ in range(window[n]):
                    i = rows[n].pop()
                    seq[i], off[i] = (int(key[0].as_py()) << 32) | w, at
                    at += n
        return table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    packed = short.withColumn(number, F.pmod(F.xxhash64(order, "start", "ids_crc32"), F.lit(groups))).groupBy(number).applyInArrow(fill, schema)
    # above every group's numbers
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 60) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens; see ``tokenize_pieces`` and ``pack``."""
    pieces = tokenize_pieces(docs.select("doc_id", "text"))
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
