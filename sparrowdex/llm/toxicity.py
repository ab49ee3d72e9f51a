"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that the fit sees at most (least hashes of the id first), and their length at most.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Length of the kernel's subsequences, its decay for each character that one spans, longest unit, landmarks, clean units in the fit.
ORDER, DECAY, LONGEST, LANDMARKS, NEGATIVES = 3, 0.55, 16, 160, 6000
THRESHOLD = 0.7
#: Lengths of the parts of units that are looked at for witnesses.
STEMS = (4, 5, 6)
#: Margin of a text in which no unit is long enough for the kernel: that of the clean side.
NOTHING = -1.0
#: Symbols of the kernel: the letters a to z, then those of other scripts by their code points' remainder, which parts the letters of one alphabet.
LATIN, SIDE = 26, 64
CACHE_UNITS = 400_000
#: Digits and signs that stand for letters within a word, as fixed values.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][.\-_*]?\s+){2,}[^\W\d_](?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")


# -- units ---------------------------------------------------------------------------------------


def tokens(text: str) -> list[str]:
    """Lower-case words as white space parts them, and letters that stand alone one after the other as one word more."""
    low = text.lower()
    found = low.split()
    if found:
        found += ["".join(m.group().split()) for m in _SPACED.finditer(low)]
    return found


def units(token: str) -> list[str]:
    """What the kernel compares of a token: its letters, without marks and signs between them, in windows if there are many."""
    letters = token.strip(".,;:!?\"'()")
    if not letters.isascii():
        plain = unicodedata.normalize("NFKD", letters)
        letters = plain.encode("ascii", "ignore").decode() or "".join(filter(str.isalpha, plain))
    if not letters.isalpha():
        plain = letters.translate(LOOKALIKES) if any(map(str.isalpha, letters)) else ""
        letters = "".join(filter(str.isalpha, plain))
    if len(letters) <= LONGEST:
        return [letters]
    return [letters[i : i + LONGEST] for i in range(0, len(letters) - LONGEST // 2, LONGEST // 2)]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


# -- the kernel ----------------------------------------------------------------------------------


@functools.cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(list(itertools.combinations(range(n), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1).astype(np.float64)


def _codes(words: list[str]) -> np.ndarray:
    point = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.where((point >= 97) & (point < 97 + LATIN), point - 97, LATIN + point % (SIDE - LATIN))


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Explicit features of words of one length: the feature of each subsequence, and its weight.

    The kernel of two words sums, over the subsequences that they share, the product of their decayed weights. That is a scalar product over
    the SIDE ** ORDER subsequences, of which a word has few.
    """
    at, weight = _triples(len(words[0]))
    codes = _codes(words)
    keys = codes[:, at[:, 0]]
    for j in range(1, ORDER):
        keys = keys * SIDE + codes[:, at[:, j]]
    return keys, weight


@functools.cache
def _decays(n: int) -> np.ndarray:
    """Decay from each position to each later one; none to itself or back."""
    step = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(step > 0, DECAY ** np.maximum(step, 1).astype(np.float64), 0.0)


def norms(words: list[str]) -> np.ndarray:
    """Root of each word's kernel with itself, for words of one length.

    By the kernel's recursion over pairs of positions: what ends at a pair of equal letters is what ended at all pairs before it, decayed.
    """
    codes = _codes(words)
    n = codes.shape[1]
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float64)
    ends, decay = same * DECAY**2, _decays(n).T
    for _ in range(ORDER - 1):
        half = (ends.reshape(-1, n) @ decay).reshape(-1, n, n).swapaxes(1, 2)
        ends = same * (half.reshape(-1, n) @ decay).reshape(-1, n, n)
    return np.sqrt(ends.sum(axis=(1, 2)))


def by_length(words: list[str], most: int = 4096):
    """(positions, words) of equal length, in blocks; words too short for a subsequence are left out."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        if n >= ORDER:
            at = np.flatnonzero(lengths == n)
            step = max(64, most * 84 // len(_triples(int(n))[1]))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                yield part, [words[k] for k in part]


def columns(words: list[str]) -> np.ndarray:
    """The features that occur in the words, ascending."""
    found = [np.unique(subsequences(part)[0]) for _, part in by_length(words)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def features(words: list[str], active: np.ndarray) -> np.ndarray:
    """Normalised features as a dense matrix of the columns ``active``."""
    where = np.full(SIDE**ORDER, -1)
    where[active] = np.arange(len(active))
    out = np.zeros((len(words), len(active)), np.float32)
    for at, part in by_length(words):
        keys, weight = subsequences(part)
        cols = where[keys]
        rows = np.repeat(at, keys.shape[1])
        keep = cols.ravel() >= 0
        np.add.at(out, (rows[keep], cols.ravel()[keep]), (weight[None, :] / norms(part)[:, None]).ravel()[keep])
    return out


@dataclass
class Model:
    """The fitted machine: the landmarks' weights summed up over the kernel's features, and Platt's curve."""

    vector: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    @functools.cached_property
    def digest(self) -> str:
        return hashlib.sha256(self.vector.tobytes() + repr((self.bias, self.slope, self.offset)).encode()).hexdigest()

    def margins(self, words: list[str]) -> np.ndarray:
        """Each word's margin; minus infinity for a word too short for a subsequence, which so decides nothing."""
        out = np.full(len(words), -np.inf)
        for at, part in by_length(words):
            keys, weight = subsequences(part)
            out[at] = self.vector[keys] @ weight.astype(self.vector.dtype) / norms(part) + self.bias
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


# -- fitting -------------------------------------------------------------------------------------


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps in the primal; the last weight is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = np.full(x1.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(30):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        c = cost * weight[on]
        new = np.linalg.solve(np.diag(ridge) + (x1[on] * c[:, None]).T @ x1[on], x1[on].T @ (c * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities, with smoothed goals."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 2.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def _widened(words: list[str], rng: np.random.Generator, each: int = 6) -> list[str]:
    """The words with one or two letters put in."""
    out = []
    for w in words:
        for k in range(each):
            s = w
            for _ in range(1 + (k % 3 == 2)):
                i = int(rng.integers(1, max(2, len(s))))
                s = s[:i] + chr(97 + int(rng.integers(26))) + s[i:]
            out.append(s[:LONGEST])
    return out


def _thinned(bags: list[list[str]], hashes: int = 8) -> list[int]:
    """Bags without near copies of earlier ones: copies of one toxic text would make all of its units look toxic."""
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for i, bag in enumerate(bags):
        codes = np.array([zlib.crc32(u.encode()) for u in bag] or [0], dtype=np.uint64)
        mins = [(k, int(((codes * np.uint64(2 * k + 1) * np.uint64(0x9E3779B1) + np.uint64(k * 77)) & np.uint64(0xFFFFFFFF)).min())) for k in range(hashes)]
        met = Counter(j for m in mins for j in seen.get(m, ()))
        if not met or met.most_common(1)[0][1] < hashes // 2:
            out.append(i)
            for m in mins:
                seen.setdefault(m, []).append(i)
    return out


def _surprise(toxic: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """A bound on minus the log of the chance that, were labels dealt at random, texts would be toxic as often as those."""
    both = np.maximum(toxic + clean, 1)
    rate = np.clip(toxic / both, 1e-9, 1 - 1e-9)
    value = both * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
    return np.where(rate > base, value, 0.0)


def _evidence(names: list[str], bags: list[np.ndarray], y: np.ndarray):
    """Texts of each label that hold each unit, whether a unit is a witness beyond chance, and how surprising it is.

    A unit counts by itself or by a part of it (STEMS letters), so that forms of one stem, each of them rare, are found together.
    """
    stems: dict[str, int] = {}
    parts = [[stems.setdefault(p, len(stems)) for p in {u[i : i + n] for n in STEMS for i in range(len(u) - n + 1)}] for u in names]
    counts = np.zeros((2, len(names)))
    found = np.zeros((2, len(stems)))
    for b, label in zip(bags, y, strict=True):
        if len(b):
            counts[int(label > 0), b] += 1
            found[int(label > 0), np.unique(np.concatenate([np.asarray(parts[i], dtype=np.int64) for i in b]))] += 1
    base = float((y > 0).mean())
    own, of_stems = _surprise(counts[1], counts[0], base), _surprise(found[1], found[0], base)
    bar = np.log((len(names) + len(stems)) / 0.05)
    strong = np.where((found[0] <= 0.02 * found[1]) & (of_stems > bar), of_stems, 0.0)
    best = np.maximum(np.where(own > bar, own, 0.0), np.array([strong[q].max() if q else 0.0 for q in parts]))
    return counts[1], counts[0], best > 0, np.maximum(best, own)


def _spread(words: list[str], most: int, near: float = 0.75) -> list[str]:
    """The first words that are not too near, by the kernel, to one before them."""
    words = words[: 4 * most]
    f = features(words, columns(words))
    near_to = f @ f.T
    out: list[int] = []
    for i in range(len(words)):
        if len(out) < most and (not out or near_to[i, out].max() < near):
            out.append(i)
    return [words[i] for i in out]


def fit(rows: list[tuple[str, int]], rounds: int = 3) -> Model:
    """Fits the machine on labelled texts.

    A text's label holds for its sentences, but only some sentences of a toxic text are toxic. So the fit alternates, as for multiple
    instances: a toxic text names as witnesses the units of its sentences that are in toxic texts too often for chance, or else the one with the
    highest margin so far; witnesses (and forms of them with letters put in) stand against units of clean sentences.
    """
    rng = np.random.default_rng(7)
    y = np.array([1 if t else -1 for _, t in rows])
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(SIDE**ORDER), -1.0, 1.0, 0.0, float(((y > 0).sum() + 1) / (len(y) + 2)))
    bags = [sorted({u for s in sentences(t) for tok in tokens(s) for u in units(tok) if len(u) >= ORDER}) for t, _ in rows]
    alone = _thinned(bags)
    bags, y = [bags[i] for i in alone], y[alone]
    names = sorted({u for b in bags for u in b})
    if not names:
        return Model(np.zeros(SIDE**ORDER), -1.0, 1.0, 0.0, float(((y > 0).sum() + 1) / (len(y) + 2)))
    index = {u: i for i, u in enumerate(names)}
    bags = [np.array([index[u] for u in b], dtype=np.int64) for b in bags]
    toxic, clean, sure, surprise = _evidence(names, bags, y)
    nt, nc = (y > 0).sum(), (y < 0).sum()
    spare = np.flatnonzero(clean > 0)
    model = None
    for turn in range(rounds):
        score = surprise if turn == 0 else model.margins(names)
        named = [b[sure[b]] if sure[b].any() else b[[np.argmax(score[b])]] for b, l in zip(bags, y, strict=True) if l > 0 and len(b)]
        named = np.concatenate(named)
        likely = named[sure[named] | ((score[named] > 0) & (clean[named] <= 0.2 * toxic[named]) & (turn > 0))]
        seen, count = np.unique(likely if len(likely) else named, return_counts=True)
        best = np.argsort(-count, kind="stable")[: LANDMARKS * 3]
        pos = [names[int(i)] for i in seen[best]]
        forms = _widened(pos, rng)
        hard = spare[np.argsort(-score[spare], kind="stable")[: NEGATIVES // 3]] if turn else spare[:0]
        rest = rng.permutation(spare)[: NEGATIVES - len(hard)]
        neg = [names[int(i)] for i in np.unique(np.concatenate([hard, rest]))]
        marks = _spread(pos, LANDMARKS * 3 // 5)
        marks += [neg[i] for i in rng.permutation(len(neg))[: LANDMARKS - len(marks)]]
        active = columns(marks)
        base = features(marks, active)
        values, vectors = np.linalg.eigh(base @ base.T)
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-4)))
        words = pos + forms + neg
        phi = np.vstack([(features(words[i : i + 1000], active) @ base.T) @ root for i in range(0, len(words), 1000)])
        lab = np.array([1] * (len(pos) + len(forms)) + [-1] * len(neg), dtype=float)
        mass = np.concatenate([np.minimum(count[best], 50), np.full(len(forms), 1.0), np.full(len(neg), 1.0)]).astype(float)
        mass[lab > 0] *= len(neg) / mass[lab > 0].sum()
        w, bias = _svm(phi, lab, mass)
        vector = np.zeros(SIDE**ORDER)
        vector[active] = base.T @ (root @ w)
        model = Model(vector, bias, 1.0, 0.0)
    score = model.margins(names)
    top = np.array([score[b].max() if len(b) else NOTHING for b in bags])
    model.slope, model.offset = _platt(top, y)
    model.vector = model.vector.astype(np.float32)
    return model


# -- Spark ---------------------------------------------------------------------------------------


def held_out(key: str = "doc_id") -> F.Column:
    """Whether labels of the row are kept from the fit: the crc of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on at most ``rows`` labelled texts of each class, none of them held out and none above ``chars`` characters.

    The sample is the rows with the least hashes of the id, so it doesn't depend on the order of either table. Null labels and null ids count as unlabelled;
    of contradicting labels the toxic one holds.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    # twice as many ids as rows, for labels without a text and for long texts; that bounds what is broadcast
    picked = [marked.filter(f"toxic {op} 0").orderBy(F.xxhash64(key), key).limit(2 * rows) for op in ("=", "!=")]
    ids = picked[0].unionByName(picked[1]).withColumnRenamed(key, "_id")
    fit_on = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).filter(F.length("_text") <= chars).join(F.broadcast(ids), "_id")
    fit_on = fit_on.select("_text", (F.col("toxic") != 0).cast("int").alias("toxic"), F.xxhash64("_id").alias("_h"), "_id")
    both = [fit_on.filter(F.col("toxic") == c).orderBy("_h", "_id", "_text").limit(rows) for c in (0, 1)]
    got = both[0].unionByName(both[1]).select("_text", "toxic").collect()
    return fit(sorted((r["_text"], r["toxic"]) for r in got))


_CACHE: dict[str, float] = {}
_CACHE_OF: list = [None]


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    """Probability of each text: of its most toxic unit, or of ``NOTHING`` if it has none that the kernel can read."""
    if _CACHE_OF[0] != model.digest or len(_CACHE) > CACHE_UNITS:
        _CACHE.clear()
        _CACHE_OF[0] = model.digest
    split = [tokens(t) for t in texts]
    new = list(set().union(*split).difference(_CACHE)) if split else []
    parts = [units(t) for t in new]
    flat = [u for p in parts for u in p]
    margin = model.margins(flat)
    at = 0
    for t, p in zip(new, parts, strict=True):
        _CACHE[t] = float(margin[at : at + len(p)].max()) if p else -np.inf
        at += len(p)
    best = np.array([max(map(_CACHE.__getitem__, s), default=-np.inf) for s in split])
    return model.probability(np.where(np.isfinite(best), best, NOTHING))


def score_toxicity(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from ``THRESHOLD`` on) to every row; a null or empty text has the score of a text without words."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        whole = t.fillna("").tolist()
        return pd.Series(np.concatenate([score_texts(model, whole[i : i + 256]) for i in range(0, len(whole), 256)] or [np.empty(0)]))

    scored = docs.drop("score", "predicted").withColumn("score", score(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score; see ``train`` and ``score_toxicity``."""
    narrow = docs.select("doc_id", "text")
    return score_toxicity(narrow, train(narrow, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
