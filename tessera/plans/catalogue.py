"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import builds, extraction, joins, records, sources, state, stores, texts, trees

QUERIES = {**builds.query.queries, **extraction.query.queries, **texts.query.queries, **joins.query.queries, **state.query.queries, **records.query.queries, **sources.query.queries, **trees.query.queries, **stores.query.queries}
ORACLE_SQL = {**builds.query.sql, **extraction.query.sql, **texts.query.sql, **joins.query.sql, **state.query.sql, **records.query.sql, **sources.query.sql, **trees.query.sql, **stores.query.sql}
