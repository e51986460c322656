"""Leases of model keys: exclusive, round robin, paced, with cooldowns and daily exhaustion. No Spark in here."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class KeyPool:
    def __init__(self, keys: list[str], gap: float, clock: Callable[[], float] = time.monotonic):
        self.keys, self.gap, self.clock = list(dict.fromkeys(keys)), gap, clock
        self.ready = dict.fromkeys(self.keys, 0.0)
        self.leased: set[str] = set()
        self.exhausted: set[str] = set()
        self.turn = 0
        self.lock = threading.Lock()

    def lease(self) -> tuple[str | None, float]:
        """(key, 0) or (None, seconds until one may be free; inf if none ever is)."""
        with self.lock:
            now, wait = self.clock(), float("inf")
            for i in range(len(self.keys)):
                key = self.keys[(self.turn + i) % len(self.keys)]
                if key in self.exhausted:
                    continue
                if key in self.leased:
                    wait = min(wait, self.gap)
                elif self.ready[key] <= now:
                    self.turn = (self.turn + i + 1) % len(self.keys)
                    self.leased.add(key)
                    return key, 0.0
                else:
                    wait = min(wait, self.ready[key] - now)
            return None, wait

    def release(self, key: str, cooldown: float = 0.0, daily: bool = False) -> None:
        with self.lock:
            self.leased.discard(key)
            self.ready[key] = self.clock() + max(self.gap, cooldown)
            if daily:
                self.exhausted.add(key)


class JobState:
    """idle -> running -> stopping -> idle; anything else is refused."""

    _NEXT = {("idle", "start"): "running", ("running", "stop"): "stopping", ("running", "finish"): "idle", ("stopping", "finish"): "idle"}

    def __init__(self):
        self.state, self.history = "idle", ["idle"]

    def on(self, event: str) -> bool:
        to = self._NEXT.get((self.state, event))
        if to is None:
            return False
        self.state = to
        self.history.append(to)
        return True
