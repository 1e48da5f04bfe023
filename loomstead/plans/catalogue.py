"""All queries of the core library by name, with the SQL they are checked against."""

from __future__ import annotations

from loomstead.plans import contract_queries, data_quality, index_queries, lookup_queries, reference_queries, store_queries

FLAGSHIP = "search_documents"
QUERIES = {**data_quality.QUERIES, **reference_queries.QUERIES, **store_queries.QUERIES, **contract_queries.QUERIES, **index_queries.QUERIES, **lookup_queries.QUERIES}
SQL = {**data_quality.SQL, **reference_queries.SQL, **store_queries.SQL, **contract_queries.SQL, **index_queries.SQL, **lookup_queries.SQL}
