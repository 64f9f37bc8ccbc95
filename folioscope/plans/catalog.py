"""All queries of the library by name, and the SQL that DuckDB runs for the same rows."""

from folioscope.plans import collections, library, prose, records, site, terms, texts, vault, work  # noqa: F401
from folioscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
