"""All queries of the library and their SQL."""

from pulsegrid.plans import delivery, monitoring  # noqa: F401  (they register their queries)
from pulsegrid.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
