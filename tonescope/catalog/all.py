"""Importing this module registers every query."""

from tonescope.catalog import agreements, calls, inferences, measures, older, profiles, questions, ranks, runs, slices, streams  # noqa: F401
from tonescope.catalog.base import ENTRIES

__all__ = ["ENTRIES"]
