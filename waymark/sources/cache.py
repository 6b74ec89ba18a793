"""Cache of lookups on one worker: least recently used first, by age, number and weight."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

# Fixed values of the services' cache.
MAX_ENTRIES = 500
MAX_WEIGHT = 500_000
DEFAULT_TTL_S = 300


class LruCache:
    def __init__(self, max_entries: int = MAX_ENTRIES, ttl_s: float = DEFAULT_TTL_S, max_weight: float = float("inf"), clock: Callable[[], float] = time.monotonic):
        self.max_entries, self.ttl_s, self.max_weight, self._clock = max_entries, ttl_s, max_weight, clock
        self._held: OrderedDict[str, tuple[Any, float, float]] = OrderedDict()
        self.weight = 0.0

    def __len__(self) -> int:
        return len(self._held)

    def _drop(self, key: str) -> None:
        _, _, weight = self._held.pop(key)
        self.weight -= weight

    def get(self, key: str, default: object = None) -> Any:
        if key not in self._held:
            return default
        value, until, _ = self._held[key]
        if self._clock() > until:
            self._drop(key)
            return default
        self._held.move_to_end(key)
        return value

    def set(self, key: str, value: object, weight: float = 1) -> None:
        """Keeps a value, unless it alone is heavier than the cache may be."""
        if key in self._held:
            self._drop(key)
        if weight > self.max_weight:
            return
        self._held[key] = (value, self._clock() + self.ttl_s, weight)
        self.weight += weight
        while len(self._held) > self.max_entries or self.weight > self.max_weight:
            self._drop(next(iter(self._held)))

    def clear(self) -> None:
        self._held.clear()
        self.weight = 0.0


class Lookup:
    """Values by key from a cache or a loader; concurrent requests for one key share a single load. Failures are not
    kept."""

    def __init__(self, cache: LruCache):
        self.cache = cache
        self._guard = threading.Lock()
        self._pending: dict[str, threading.Event] = {}
        self._results: dict[str, tuple[bool, Any]] = {}

    def __call__(self, key: str, load: Callable[[], Any], weight: float = 1) -> Any:
        missing = object()
        with self._guard:
            value = self.cache.get(key, missing)
            if value is not missing:
                return value
            waiting = self._pending.get(key)
            if waiting is None:
                self._pending[key] = threading.Event()
        if waiting is not None:
            waiting.wait()
            with self._guard:
                value = self.cache.get(key, missing)
            return value if value is not missing else self(key, load, weight)
        try:
            value = load()
            with self._guard:
                self.cache.set(key, value, weight)
            return value
        finally:
            with self._guard:
                self._pending.pop(key).set()
