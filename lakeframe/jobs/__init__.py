"""Jobs on the given tables, each registered with its SQL twin."""

from . import admission, learning, measurement, modelling, monitoring, worlds  # noqa: F401  they register their jobs
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
