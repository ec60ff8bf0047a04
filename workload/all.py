"""Every registered query with, where SQL can say it, the statement that checks it."""

from workload import (  # noqa: F401
    analytics, backlog, extraction, ingest, process, records, results, review, stream, templates,
    validation)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
