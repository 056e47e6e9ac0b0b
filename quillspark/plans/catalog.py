"""All queries of the library, gathered by importing the plan modules."""

from quillspark.plans import analysis, dump, evaluate, forms, history, layout, merging, review, rollups, scalars, search, sequences, states, stream, trees  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
