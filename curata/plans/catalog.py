"""All registered queries of the library's core with the SQL that states them."""

from __future__ import annotations

from curata.plans import queries_audit, queries_more, queries_rest, queries_select, queries_sequences, queries_text  # noqa: F401
from curata.plans.registry import ORACLE, QUERIES  # noqa: F401
