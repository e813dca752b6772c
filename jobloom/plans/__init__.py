"""All named queries. Importing the package fills the registry."""

from jobloom.plans.registry import ORACLES, QUERIES
from jobloom.plans import loads, pages, relational, scalars, scores, streams, texts  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
