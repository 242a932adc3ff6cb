"""All registered queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from .plans import tables

QUERIES = dict(tables.QUERIES)
SQL = dict(tables.SQL)
