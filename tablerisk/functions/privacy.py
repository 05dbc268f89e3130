"""What differentially private steps spend of a budget."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class PrivacyLedger:
    """Epsilons of the releases made from one table; they add up, and more than the budget raises."""

    epsilon: float
    entries: list[tuple[str, int, float]] = field(default_factory=list)

    def __post_init__(self):
        if not self.epsilon > 0:
            raise ValueError("epsilon must be positive")

    def spend(self, what: str, epsilon: float, releases: int) -> float:
        """Enter ``releases`` that share ``epsilon``; returns what each of them may spend."""
        if self.spent + epsilon > self.epsilon * (1 + 1e-9):
            raise ValueError(f"{what} would spend more than epsilon = {self.epsilon}")
        self.entries.append((what, releases, epsilon / releases))
        return epsilon / releases

    @property
    def spent(self) -> float:
        return math.fsum(n * each for _, n, each in self.entries)


def information_sensitivity(n: float) -> float:
    """How far one replaced record of ``n`` moves a pair's mutual information."""
    n = max(n, 2.0)
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))
