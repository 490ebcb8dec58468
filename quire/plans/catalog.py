"""All queries of the core, with their SQL."""

from __future__ import annotations

from quire.plans import made, nested, pages, prose, recover

QUERIES = {**prose.QUERIES, **pages.QUERIES, **recover.QUERIES, **nested.QUERIES, **made.QUERIES}
SQL = {**prose.SQL, **pages.SQL, **recover.SQL, **nested.SQL, **made.SQL}
