"""Progress of long driver-side loops as lines of text, at most one in `interval` seconds."""

from __future__ import annotations

import time
from collections.abc import Callable


class Progress:
    def __init__(self, total: int, unit: str = "items", interval: float = 5.0, least: int = 50, say: Callable[[str], None] = print, clock: Callable[[], float] = time.monotonic) -> None:
        """Totals under `least` aren't reported."""
        self.total, self.unit, self.interval, self.least, self.say, self.clock = total, unit, interval, least, say, clock
        self.began = self.last = clock()

    def line(self, done: int) -> str:
        spent = max(self.clock() - self.began, 1e-9)
        rate = done / spent
        left = f", {(self.total - done) / rate:.0f} s left" if rate and done < self.total else ""
        return f"{done} of {self.total} {self.unit} ({done * 100 / max(1, self.total):.1f}%), {rate:.1f} a second{left}"

    def report(self, done: int) -> bool:
        """Say so if it is time, or all is done."""
        due = self.total >= self.least and (done >= self.total or self.clock() - self.last >= self.interval)
        if due:
            self.last = self.clock()
            self.say(self.line(done))
        return due
