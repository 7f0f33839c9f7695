"""Small state machines that batch and streaming operators share."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Ewma:
    """A running level and spread; ``push`` gives the size of a jump above them, or 0.

    The jump is judged by the state before it. Jumps are trusted after ``settle`` values.
    """

    level: float = 0.0
    spread: float = 0.0
    seen: int = 0
    alpha: float = 0.05
    settle: int = 12

    def push(self, delta: float) -> float:
        self.seen += 1
        jump = self.seen > self.settle and delta > self.level + 6 * self.spread + 0.02
        self.level += self.alpha * (delta - self.level)
        self.spread += self.alpha * (abs(delta - self.level) - self.spread)
        return min(1.0, 4 * delta) if jump else 0.0


@dataclass
class Bucket:
    """A token bucket: ``take`` says whether a request at a time passes, and else after how many seconds it would."""

    rate: float
    burst: float
    tokens: float | None = None
    at: float = 0.0

    def take(self, now: float, cost: float = 1.0) -> tuple[bool, float]:
        held = self.burst if self.tokens is None else min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        passed = held >= cost
        self.tokens = held - cost if passed else held
        return passed, 0.0 if passed else round((cost - held) / max(self.rate, 1e-6), 2)


@dataclass
class Breaker:
    """Closed until ``threshold`` failures in a row, then open for ``cooldown`` seconds, then one probe at a time."""

    threshold: int = 3
    cooldown: float = 30.0
    failures: int = 0
    opened: float = 0.0
    probing: bool = False

    def state(self, now: float) -> str:
        if self.failures < self.threshold:
            return "closed"
        return "half_open" if now - self.opened >= self.cooldown else "open"

    def allow(self, now: float) -> bool:
        state = self.state(now)
        if state == "half_open" and not self.probing:
            self.probing = True
            return True
        return state == "closed"

    def record(self, now: float, success: bool) -> None:
        self.probing = False
        self.failures = 0 if success else self.failures + 1
        if not success and self.failures >= self.threshold:
            self.opened = now
