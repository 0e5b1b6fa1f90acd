"""Linked-view analytics on Spark DataFrames.

Records go in (JSON, JSON Lines or any frame); the datasets behind a set of linked
views come out as lazy DataFrames: field profile, category series, entity links,
node/link graph and hierarchy, joined by one shared selection.
"""

from viewloom.plans.dashboard import Dashboard
from viewloom.plans.specs import GraphSpec, HierarchySpec, LinkSpec, Measure, SeriesSpec

__all__ = ["Dashboard", "GraphSpec", "HierarchySpec", "LinkSpec", "Measure", "SeriesSpec"]
