"""A source that breaks off and is opened again, within a budget, and what it counts."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass
class Stats:
    opened: int = 0
    reconnects: int = 0
    produced: int = 0
    read: int = 0
    dropped: int = 0
    down: bool = False
    error: str | None = None


class Reconnecting:
    """Items of ``connect()``, opened again whenever it fails or ends, at most ``budget`` times in all (0: no end).

    ``delay`` seconds pass before each try, unless ``stop`` is set, which ends the source at once.
    """

    def __init__(self, connect: Callable[[], Iterator], budget: int = 0, delay: float = 1.0):
        self.connect, self.budget, self.delay = connect, budget, delay
        self.stop, self.stats = threading.Event(), Stats()

    def __iter__(self) -> Iterator:
        s = self.stats
        while not self.stop.is_set():
            try:
                items = self.connect()
                s.opened += 1
                for x in items:
                    s.produced += 1
                    yield x
                    if self.stop.is_set():
                        return
                why = "the source ended"
            except OSError as e:
                why = f"{type(e).__name__}: {e}"
            if 0 < self.budget <= s.reconnects:
                s.down, s.error = True, f"no more than {self.budget} reconnects: {why}"
                return
            s.reconnects += 1
            self.stop.wait(self.delay)


class Mailbox:
    """The newest item only: what was not taken before the next came is dropped. read + dropped + waiting = produced."""

    def __init__(self, stats: Stats):
        self.stats, self.ready, self.item, self.full = stats, threading.Condition(), None, False

    def put(self, x) -> None:
        with self.ready:
            self.stats.dropped += self.full
            self.item, self.full = x, True
            self.ready.notify_all()

    def take(self, seconds: float):
        """The item, or None if none comes in time."""
        with self.ready:
            if not self.ready.wait_for(lambda: self.full, seconds):
                return None
            x, self.item, self.full = self.item, None, False
            self.stats.read += 1
            return x
