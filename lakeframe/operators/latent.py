"""Latent score models: declared terms become one column expression."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPES = {
    "identity": lambda v: v,
    "log1p": lambda v: F.log(1 + F.greatest(v, F.lit(-0.999999))),
    "sqrt": lambda v: F.sqrt(F.greatest(v, F.lit(0.0))),
    "tanh": F.tanh,
    "square": lambda v: v * v,
    "abs": F.abs,
}


@dataclass(frozen=True)
class Driver:
    name: str
    coefficient: float
    shape: str = "identity"
    center: float = 0.0
    scale: float = 1.0

    def column(self) -> Column:
        return self.coefficient * SHAPES[self.shape]((F.col(self.name) - self.center) / self.scale)


@dataclass(frozen=True)
class Levels:
    name: str
    effects: Mapping[str, float]

    def column(self) -> Column:
        out = F.lit(0.0)
        for level, effect in self.effects.items():
            out = F.when(F.col(self.name) == level, float(effect)).otherwise(out)
        return out


@dataclass(frozen=True)
class Interaction:
    """coefficient * x * right, or coefficient * x where the column right has the level gate; x is (left - center) / scale."""

    left: str
    right: str
    coefficient: float
    gate: str | None = None
    center: float = 0.0
    scale: float = 1.0

    def column(self) -> Column:
        x = (F.col(self.left) - self.center) / self.scale if (self.center, self.scale) != (0.0, 1.0) else F.col(self.left)
        if self.gate is None:
            return self.coefficient * x * F.col(self.right)
        return F.when(F.col(self.right) == self.gate, self.coefficient * x).otherwise(0.0)


@dataclass(frozen=True)
class LatentModel:
    intercept: float
    terms: tuple[Driver | Levels | Interaction, ...]
    floor: float | None = None
    ceiling: float | None = None

    def raw(self) -> Column:
        """The unclamped signal; a missing input adds nothing."""
        out = F.lit(self.intercept)
        for term in self.terms:
            out = out + F.coalesce(term.column(), F.lit(0.0))
        return out

    def signal(self) -> Column:
        out = self.raw()
        out = F.greatest(out, F.lit(self.floor)) if self.floor is not None else out
        return F.least(out, F.lit(self.ceiling)) if self.ceiling is not None else out

    def only(self, *kinds: type) -> LatentModel:
        return replace(self, terms=tuple(t for t in self.terms if isinstance(t, kinds)))
