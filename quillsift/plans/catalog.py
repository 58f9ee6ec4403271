"""Every query over the shared tables, by name, and the SQL that returns the same rows."""

from __future__ import annotations

from quillsift.plans import record_queries, redaction_queries, review_queries, step_queries

QUERIES = redaction_queries.QUERIES | review_queries.QUERIES | record_queries.QUERIES | step_queries.QUERIES
SQL = redaction_queries.SQL | review_queries.SQL | record_queries.SQL | step_queries.SQL
