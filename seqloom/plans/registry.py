"""All queries of the library, by name."""

from __future__ import annotations

from . import canonical, evaluation, evidence, geometry, integrity, policies, quality, relations, reviews, rules, selection, storage, vectors  # noqa: F401  they register
from ._register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
