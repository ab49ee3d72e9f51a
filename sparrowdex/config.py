"""Settings by name: a stored override wins over the environment, and that over the default."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping

#: Effective defaults.
DEFAULTS: dict[str, bool | int | float | str] = {
    "KB_EMBEDDING_DIM": 4096,
    "KB_EMBEDDING_MODEL": "qwen/qwen3-embedding-8b",
    "KB_BM25_ENABLED": True,
    "KB_RERANK_ENABLED": False,
    "KB_RERANKER": "overlap",
    "KB_RERANK_INITIAL_K": 20,
    "KB_RERANK_FINAL_K": 5,
    "KB_QUERY_EXPANSION_ENABLED": False,
    "KB_CONTEXTUAL_RETRIEVAL_ENABLED": False,
    "KB_INTENT_CLASSIFIER_ENABLED": False,
    "KB_STANDALONE_QUERY_ENABLED": False,
    "KB_NEIGHBOR_WINDOW": 1,
    "KB_FIGURE_LIMIT": 3,
    "KB_FIGURE_MIN_RERANK": 0.2,
    "KB_STORE_CONCURRENCY": 3,
    "KB_QUERY_EMBED_CACHE": 256,
    "KB_SMART_FALLBACK": "gpt-4.1-nano",
    "KB_VLM_TYPES": "chart",
    "KB_CHUNK_SIZE": 800,
    "KB_CHUNK_OVERLAP": 200,
    "KB_ENTITY_WEIGHT": 0.3,
    "KB_VECTOR_WEIGHT": 0.7,
}
OVERRIDABLE = tuple(k for k in DEFAULTS if k not in ("KB_EMBEDDING_DIM", "KB_STORE_CONCURRENCY", "KB_QUERY_EMBED_CACHE"))


class Settings:
    """Reads settings; overrides come from a callable and are kept for a minute. If it fails, the last ones known stay."""

    def __init__(self, overrides: Callable[[], Mapping[str, str]] | None = None, env: Mapping[str, str] | None = None, seconds: float = 60, clock: Callable[[], float] = time.monotonic):
        self._load, self._env, self._seconds, self._clock = overrides, os.environ if env is None else env, seconds, clock
        self._held: dict[str, str] = {}
        self._at: float | None = None

    def _overrides(self) -> dict[str, str]:
        now = self._clock()
        if self._load is not None and (self._at is None or now - self._at > self._seconds):
            try:
                self._held = {k: v for k, v in self._load().items() if k in OVERRIDABLE and v is not None and v.strip()}
            except Exception:  # noqa: BLE001 - settings outlive their store
                pass
            self._at = now
        return self._held

    def given(self, name: str) -> bool:
        """Whether an override or the environment sets it."""
        return bool((self._overrides().get(name) or self._env.get(name, "")).strip())

    def get(self, name: str):
        """The setting in its default's type: "true" switches on what is off, only "false" switches off what is on; a number must be one."""
        default = DEFAULTS[name]
        raw = self._overrides().get(name) or self._env.get(name, "")
        if not raw.strip():
            return default
        if isinstance(default, bool):
            return raw != "false" if default else raw == "true"
        if isinstance(default, int):
            if str(int(raw)) != raw.strip():
                raise ValueError(f"{name} is no whole number: {raw}")
            return int(raw)
        return type(default)(raw)


class Registry:
    """Named makers of extractors, rerankers or models."""

    def __init__(self, **makers: Callable):
        self._makers = dict(makers)

    def add(self, name: str, maker: Callable) -> None:
        self._makers[name] = maker

    def make(self, name: str | None, *args, **options):
        """What the name stands for; nothing for no name. A router can't route to itself."""
        if not name or name == "off":
            return None
        if options.get("within") == name:
            raise ValueError(f"{name} can't fall back to itself")
        options.pop("within", None)
        if name not in self._makers:
            raise KeyError(f"{name} isn't one of {', '.join(sorted(self._makers))}")
        return self._makers[name](*args, **options)
