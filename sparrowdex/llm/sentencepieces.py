"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Bytes of text that are encoded at a time, and rows that are decoded at a time.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1024
#: Characters from which on a word is looked through for places that no piece reaches across.
LONG = 64
#: Rounds after which the segments left, long ones, are merged one pair at a time.
ROUNDS = 100
_NEVER = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    """One model's tables: symbols, ranks of pairs, surfaces.

    For BPE models with byte fallback, the identity normaliser, a dummy prefix and no pieces of the user's own; others raise ValueError.
    A symbol is a piece's id, or a number above all ids for a character that is no piece but part of one, or the code point below zero.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, train = model.normalizer_spec, model.trainer_spec
        odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or odd:
            raise ValueError("only BPE models with byte fallback, the identity normaliser, a dummy prefix and normal pieces")
        self.size = len(model.pieces)
        self.normal = np.array([p.type == kinds.NORMAL for p in model.pieces])
        self.control = [p.type == kinds.CONTROL for p in model.pieces]
        self.controls = {i for i, c in enumerate(self.control) if c}
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = np.array([byte[b] for b in range(256)], np.int32)
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        symbol = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        words = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
        for c in sorted({c for w in words for c in w} - symbol.keys()):
            symbol[c] = self.size + len(symbol)
        self.chars = {s: i for s, i in symbol.items() if len(s) == 1}
        self.span = max([self.size, *symbol.values()]) + 1
        # pairs of symbols that make a piece; equal scores have equal ranks
        place = {s: r for r, s in enumerate(sorted(set(words.values()), reverse=True))}
        pairs = [(symbol[w[:k]] * self.span + symbol[w[k:]], place[s], symbol[w]) for w, s in words.items() for k in range(1, len(w)) if w[:k] in symbol and w[k:] in symbol]
        self._fill(pairs)
        # characters that stand side by side in some piece; between others no merge can reach
        self.beside = np.array(sorted({(ord(a) << 21) | ord(b) for w in words for a, b in zip(w, w[1:], strict=False)}) or [-1], np.int64)
        # no piece has a space after another character, so words are independent
        self.words_apart = not any(SPACE in w.lstrip(SPACE) for w in words)
        self.lines_apart = not any("\n" in w for w in words)
        surface = [b"" if c else train.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode() for p, c in zip(model.pieces, self.control, strict=True)]
        for b, i in byte.items():
            surface[i] = bytes([b])
        self.surface = surface
        self.width = np.array([len(x) for x in surface], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.letters = np.frombuffer(b"".join(surface), np.uint8)
        self.spaced = self.normal & np.array([x[:1] == b" " for x in surface])
        #: symbol of each code point
        self.of_code = -1 - np.arange(0x110000, dtype=np.int32)
        self.of_code[[ord(c) for c in self.chars]] = list(self.chars.values())
        self.pair_of: dict[int, tuple[int, int]] | None = None

    # -- encoding -------------------------------------------------------------------------

    def _fill(self, pairs: list[tuple[int, int, int]]) -> None:
        """A hash table of the pairs with open addressing, at most a quarter full."""
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NEVER, np.int32)
        self.slot_made = np.zeros(1 << self.bits, np.int32)
        key, rank, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        at = self._slot(key)
        while len(key):
            free = self.slot_key[at] < 0
            _, one = np.unique(at, return_index=True)
            put = np.zeros(len(key), bool)
            put[one] = True
            put &= free
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_made[at[put]] = key[put], rank[put], made[put]
            key, rank, made, at = key[~put], rank[~put], made[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each pair of symbols; the rank is _NEVER where they make no piece."""
        key = left.astype(np.int64) * self.span + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        held = self.slot_key[at]
        rank, made = np.where(held == key, self.slot_rank[at], _NEVER), self.slot_made[at]
        more = np.flatnonzero((held != key) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[at[more]]
            found = more[held == key[more]]
            rank[found], made[found] = self.slot_rank[at[found]], self.slot_made[at[found]]
            more = more[(held != key[more]) & (held >= 0)]
        return rank, made

    def merge(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin (one entry more than words).

        All symbols lie in one flat array. In a round each segment (a word, cut where no piece can reach across if it is long) takes the least rank among its
        pairs and merges all pairs of this rank at once, the leftmost first where they overlap; segments without a pair left go out, and the rest
        moves together. If a merge makes a pair that should come before the segment's other merges of the round, or ROUNDS are over, as in runs of
        letters without end, the segment is merged one pair at a time instead.
        """
        lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        first = np.concatenate([[0], np.cumsum(lens)])
        new = np.zeros(len(code), bool)
        new[first[:-1][lens > 0]] = True
        long = np.flatnonzero(np.repeat(lens > LONG, lens))
        if len(long):
            long = long[~new[long]]
            near = (code[long - 1].astype(np.int64) << 21) | code[long]
            new[long] = self.beside[np.minimum(np.searchsorted(self.beside, near), len(self.beside) - 1)] != near
        origin = self.of_code[code]
        sym = origin.copy()
        out = np.full(len(code), _NEVER, np.int32)  # what stands at each symbol's first character in the end
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(code))  # of segments, in code
        pos = np.arange(len(code), dtype=np.int32 if len(code) < _NEVER else np.int64)
        seg = np.cumsum(new, dtype=pos.dtype) - 1
        rank = np.full(len(sym), _NEVER, np.int32)
        if len(sym) > 1:
            rank[:-1] = self._pairs(sym[:-1], sym[1:])[0]
            rank[:-1][new[1:]] = _NEVER
        rounds = 0
        while len(sym):
            rounds += 1
            begin = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
            best = np.minimum.reduceat(rank, begin)
            width = np.diff(np.append(begin, len(sym)))
            shut = best == _NEVER
            if shut.any():
                closed = np.repeat(shut, width)
                gone, stay = np.flatnonzero(closed), np.flatnonzero(~closed)
                out[pos[gone]] = sym[gone]
                sym, seg, pos, rank = sym[stay], seg[stay], pos[stay], rank[stay]
                width, best = width[~shut], best[~shut]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, width))
            # of hits that follow one another, every second from the first
            run = np.arange(len(hits))
            head = np.concatenate([[True], hits[1:] != hits[:-1] + 1])
            take = hits[(run - np.maximum.accumulate(np.where(head, run, 0))) % 2 == 0]
            least, sym[take] = self._pairs(sym[take], sym[take + 1])
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            keep = np.flatnonzero(keep)
            sym, seg, pos, rank = sym[keep], seg[keep], pos[keep], rank[keep]
            # pairs beside what was merged
            fresh = take - np.arange(len(take))
            for at in (fresh, fresh[fresh > 0] - 1):
                near = np.minimum(at + 1, len(sym) - 1)
                rank[at] = self._pairs(sym[at], sym[near])[0]
                rank[at[(seg[at] != seg[near]) | (near == at)]] = _NEVER
            before = np.maximum(fresh - 1, 0)
            early = (rank[fresh] <= least) | ((fresh > 0) & (seg[before] == seg[fresh]) & (rank[before] <= least))
            bad = np.zeros(0, seg.dtype)
            if rounds >= ROUNDS:
                bad = np.unique(seg)
            elif early.any():
                whose, times = np.unique(seg[fresh], return_counts=True)
                bad = np.intersect1d(whose[times > 1], seg[fresh[early]])
            for s in bad.tolist():
                at, got = self._one_by_one(origin[starts[s] : ends[s]])
                out[at + starts[s]] = got
            if len(bad):
                stay = np.flatnonzero(~np.isin(seg, bad))
                sym, seg, pos, rank = sym[stay], seg[stay], pos[stay], rank[stay]
        pos = np.flatnonzero(out != _NEVER)
        out = out[pos]
        lost = (out < 0) | (out >= self.size)
        if lost.any():  # characters that are no piece become their bytes
            raw = [self.byte_ids[list(chr(c).encode())] for c in code[pos[lost]].tolist()]
            times = np.ones(len(out), np.int64)
            times[lost] = [len(r) for r in raw]
            out, pos, lost = np.repeat(out, times), np.repeat(pos, times), np.repeat(lost, times)
            out[lost] = np.concatenate(raw)
        return out, np.searchsorted(pos, first)

    def _one_by_one(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and symbols of one segment, merged pair by pair: least rank first, then leftmost."""
        if self.pair_of is None:
            self.pair_of = dict(zip(self.slot_key.tolist(), zip(self.slot_rank.tolist(), self.slot_made.tolist(), strict=True), strict=True))
        s = sym.tolist()
        nxt, prv = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if min(s[i], s[j]) >= 0 and (found := self.pair_of.get(s[i] * self.span + s[j])):
                heapq.heappush(heap, (found[0], i, s[i], s[j], found[1]))

        for i in range(len(s) - 1):
            add(i, i + 1)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j >= len(s) or s[j] != b:
                continue
            s[i], s[j], nxt[i] = m, None, nxt[j]
            if nxt[j] < len(s):
                prv[nxt[j]] = i
                add(i, nxt[j])
            if prv[i] >= 0:
                add(prv[i], i)
        left = [i for i, x in enumerate(s) if x is not None]
        return np.array(left, np.int64), np.array([s[i] for i in left], np.int64)

    def words(self, texts: pa.StringArray) -> pa.ListArray:
        """Parts of each text that encode independently: cut at a space after another character, and around line ends if no piece has one."""
        marked = pc.replace_substring(texts, SPACE, " ")
        if self.words_apart:
            marked = pc.replace_substring(marked, " ", " " + SPACE)
        else:
            marked = pc.replace_substring(marked, " ", SPACE)
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(SPACE, marked, ""))
        if self.words_apart:
            for _ in range(2):  # spaces in a row stay together; the first pass leaves those between two pairs
                marked = pc.replace_substring(marked, SPACE + " " + SPACE, SPACE + SPACE)
            if self.lines_apart:
                marked = pc.replace_substring(marked, "\n", " \n ")
            return pc.split_pattern(marked, " ")
        return pa.ListArray.from_arrays(np.arange(len(marked) + 1, dtype=np.int32), marked)

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text. Every distinct word of the texts is merged once."""
        parts = self.words(texts)
        coded = parts.flatten().dictionary_encode()
        ids, at = self.merge(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[word])]).astype(np.int64)
        rows = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(_gathered(ids, at[:-1][word], ends)))

    # -- decoding -------------------------------------------------------------------------

    def decode_all(self, lists: pa.ListArray) -> pa.StringArray:
        """The texts of arrays of ids, null for null."""
        ids = lists.flatten()
        if ids.null_count:
            raise ValueError("null id")
        ids = ids.to_numpy(zero_copy_only=False)
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("id out of range")
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        if not np.isin(ids, list(self.controls)).any():
            begin, width = self.begin[ids], self.width[ids]
            first = rows[:-1][rows[1:] > rows[:-1]]
            first = first[self.spaced[ids[first]]]
            begin[first] += 1
            width[first] -= 1
            ends = np.concatenate([[0], np.cumsum(width)])
            raw = _gathered(self.letters, begin, ends)
            cuts = ends[rows]
            try:
                raw.tobytes().decode()
                whole = not (raw[cuts[:-1][cuts[:-1] < len(raw)]] & 0xC0 == 0x80).any()  # no character reaches into the next text
            except UnicodeDecodeError:
                whole = False
            if whole and len(raw) < _NEVER:
                texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw))
                return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts) if lists.null_count else texts
        return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with spaces, bytes as UTF-8, the dummy prefix taken off, control ids nothing; no character reaches across one."""
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise ValueError("id out of range")
        raw = b"".join(map(self.surface.__getitem__, ids))
        if raw[:1] == b" ":
            first = next(i for i in ids if not self.control[i])
            raw = raw[1:] if self.normal[first] else raw
        if not self.controls.isdisjoint(ids):
            parts = [b"".join(self.surface[i] for i in run) for is_control, run in itertools.groupby(ids, self.controls.__contains__) if not is_control]
            if parts and len(raw) < sum(map(len, parts)):
                parts[0] = parts[0][1:]
            return "".join(map(_mended, parts))
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _mended(raw)


def _mended(raw: bytes) -> str:
    """UTF-8 in which each byte that begins no whole character is U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


def _gathered(values: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """values[begin[i]:...] for each i, one after the other; the i-th ends at ends[i + 1] in the result."""
    return values[np.repeat(begin - ends[:-1], np.diff(ends)) + np.arange(ends[-1])]


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose column has about as many bytes, and a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if most else None
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_pieces(docs: DataFrame, *, text: str = "text", model: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` (array of int): the pieces of each whole text, without begin or end ids. ``keep`` names the columns that stay (all, if not given).

    A null or empty text has no ids; long texts are whole; equal texts have equal ids; equal rows stay separate; an empty table stays empty. A column of the
    input named ids is replaced; other columns pass through. A worker encodes SLICE_BYTES of text at a time, or one longer text.
    """
    path = model or default_model()
    stay = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    body = docs.select(*(F.col(f"`{c}`") for c in stay), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_piece_text"))
    schema = T.StructType([*body.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for whole in batches:
            for part in _slices(whole, "_piece_text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), code.encode(part.column("_piece_text"))], names=[*stay, "ids"])

    return body.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, *, ids: str = "ids", model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of each array of ids.

    Null ids have a null text, an empty array an empty one; bytes that are no UTF-8 become U+FFFD each; an id that the model lacks, or a null id within
    an array, raises ValueError. A column of the input named decoded is replaced; other columns pass through.
    """
    path = model or default_model()
    stay = [c for c in df.columns if c != "decoded"]
    body = df.select(*(F.col(f"`{c}`") for c in stay))
    schema = T.StructType([*body.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in stay), code.decode_all(part.column(ids))], names=[*stay, "decoded"])

    return body.mapInArrow(run, schema)


def piece_rows(docs: DataFrame) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text that they decode to."""
    coded = encode_pieces(docs.select("doc_id", "text"), keep=["doc_id"])
    digests = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return decode_pieces(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
