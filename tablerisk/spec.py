"""Declared table metadata and answer mechanisms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

ID = "record_id"


@dataclass(frozen=True)
class TableSpec:
    """Which columns are categorical (with their ordered domain) and which continuous.

    ``scaled`` lists the continuous columns that min-max scaling applies to (metadata type
    ``Float``); ``Integer`` columns keep their raw values.
    """

    categorical: tuple[str, ...]
    continuous: tuple[str, ...]
    scaled: tuple[str, ...] = ()
    domain: dict[str, tuple] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        """All attributes in metadata order."""
        return self.order or (*self.categorical, *self.continuous)

    def select(self, cols) -> "TableSpec":
        """Keep ``cols``: the order follows the request, the two type lists keep their own."""
        if cols[0] == "all":
            return self
        unknown = [c for c in cols if c not in self.columns]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        return replace(
            self,
            categorical=tuple(c for c in self.categorical if c in cols),
            continuous=tuple(c for c in self.continuous if c in cols),
            scaled=tuple(c for c in self.scaled if c in cols),
            domain={c: d for c, d in self.domain.items() if c in cols},
            order=tuple(cols),
        )

    def coded(self) -> "TableSpec":
        """The spec after categorical columns were replaced by their integer codes."""
        return replace(self, domain={c: tuple(range(len(d))) for c, d in self.domain.items()})


@dataclass(frozen=True)
class Mechanism:
    """How a count interface perturbs its answers."""

    kind: str
    threshold: int = 0
    scale: float = 0.0
    c: int = 2
    epsilon: float = 1.0

    def __post_init__(self):
        if self.kind not in ("simple", "table-builder", "dp-laplace"):
            raise ValueError(f"unknown mechanism {self.kind!r}")

    @property
    def deterministic(self) -> bool:
        """True when asking the same query twice gives the same answer."""
        return self.kind == "table-builder" or (self.kind == "simple" and self.scale == 0)
