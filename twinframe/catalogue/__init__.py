"""Registered queries over the driver's tables, each with the SQL that checks it."""

from . import assembly, chunks, curation, metrics, pairs, vectors  # noqa: F401
from .register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
