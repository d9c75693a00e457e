"""The registered queries, and the SQL that gives the same rows."""

from __future__ import annotations

from casebook.plans import board, desk, domain, fields, records, relational, streamed  # noqa: F401
from casebook.plans.base import ORACLES, QUERIES  # noqa: F401
