"""Names and SQL of the registered queries."""

from .plans import catalogue_queries, record_queries, review_queries, run_queries, scalar_queries, store_queries, stream_queries, text_queries

_MODULES = (catalogue_queries, scalar_queries, record_queries, run_queries, review_queries, store_queries, stream_queries, text_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
