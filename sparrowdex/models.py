"""Model endpoints as protocols, and deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    name: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def column(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str], k: int) -> list[tuple[int, float]]: ...


class Model(Protocol):
    def __call__(self, prompt: str) -> str: ...


class HashEmbedder:
    """Hashed bags of words as unit vectors; equal texts have equal vectors, and shared words bring texts together."""

    def __init__(self, dimension: int = 64, batch: int = 128):
        self.dimension, self.batch, self.name = dimension, batch, f"hash-{dimension}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            size = float(np.sqrt((v**2).sum()))
            out.append((v / size if size else v).astype(np.float32).tolist())
        return out

    def column(self, text: Column) -> Column:
        embed, batch = self.embed, self.batch

        @F.pandas_udf("array<float>")
        def run(t: pd.Series) -> pd.Series:
            rows = t.fillna("").tolist()
            return pd.Series([v for i in range(0, len(rows), batch) for v in embed(rows[i : i + batch])])

        return run(text)


def batch_size(model: str, default: int = 128) -> int:
    """Texts that a model's endpoint takes at once."""
    return min(default, 100) if "gemini" in model.lower() else default


class OverlapReranker:
    """Scores a text by the share of the query's words that it holds."""

    def rerank(self, query: str, texts: Sequence[str], k: int) -> list[tuple[int, float]]:
        want = set(query.lower().split())
        score = [len(want & set(t.lower().split())) / max(1, len(want)) for t in texts]
        return [(i, score[i]) for i in sorted(range(len(texts)), key=lambda i: (-score[i], i))[:k]]


class CachedEmbedder:
    """Query vectors by model and text, for some minutes; tries again on errors that pass."""

    def __init__(self, inner: Embedder, size: int = 256, seconds: float = 300, tries: int = 3, wait: float = 0.5, passing: Callable[[Exception], bool] = lambda e: True):
        self.inner, self.cache, self.tries, self.wait, self.passing = inner, Lru(size, seconds), tries, wait, passing

    def query(self, text: str) -> list[float]:
        key = (self.inner.name, text)
        found = self.cache.get(key)
        if found is not None:
            return found
        for n in range(self.tries):
            try:
                value = self.inner.embed([text])[0]
                break
            except Exception as e:
                if n + 1 == self.tries or not self.passing(e):
                    raise
                time.sleep(self.wait * 2**n)
        if not value:
            raise ValueError("the model gave no vector")
        self.cache.put(key, value)
        return value


class Lru:
    """Least recently used entries go first; an entry ends after so many seconds; reading renews its place, not its time."""

    def __init__(self, size: int, seconds: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict = OrderedDict()

    def get(self, key):
        if key not in self.held:
            return None
        value, born = self.held[key]
        if self.seconds is not None and self.clock() - born > self.seconds:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return value

    def put(self, key, value) -> None:
        self.held[key] = (value, self.clock())
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)

    def __len__(self) -> int:
        return len(self.held)
