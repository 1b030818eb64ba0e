"""All registered queries of the document engine and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from leafwork.plans import document_queries, nested_queries, package_queries, text_queries

QUERIES: dict = document_queries.QUERIES | text_queries.QUERIES | package_queries.QUERIES | nested_queries.QUERIES
SQL: dict[str, str] = document_queries.SQL | text_queries.SQL | package_queries.SQL | nested_queries.SQL
