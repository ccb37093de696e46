"""Registered queries over the driver tables, each with the SQL that gives the same rows."""

from termweave.workload import files, reports, terms, text, vectors  # noqa: F401
from termweave.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
