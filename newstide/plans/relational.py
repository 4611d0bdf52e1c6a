"""All queries that are one SQL text for both engines, by name."""

from __future__ import annotations

from . import aggregates_sql, frames_sql, joins_sql, samples_sql, sources_sql, tests_sql, text_sql, windows_sql, studies_sql, tables  # noqa: F401  (tables names the common tables)

SQL: dict[str, tuple[str, str]] = aggregates_sql.SQL | frames_sql.SQL | joins_sql.SQL | samples_sql.SQL | sources_sql.SQL | tests_sql.SQL | text_sql.SQL | windows_sql.SQL | studies_sql.SQL
