"""The registered queries, each with the SQL that gives the same rows."""

from . import batches, evaluation, images, more, reports, samples, sequences  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
