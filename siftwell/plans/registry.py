"""All registered queries of the library."""

from __future__ import annotations

from . import dashboard, documents, relational

QUERIES = {**dashboard.QUERIES, **relational.QUERIES, **documents.QUERIES}
SQL = {**dashboard.SQL, **relational.SQL, **documents.SQL}
