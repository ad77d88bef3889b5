"""All queries of the library's own operators and their SQL."""

from docwatch.plans import queries_jobs, queries_match, queries_sources, queries_state, queries_text  # noqa: F401  each module registers its queries
from docwatch.plans.roles import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
