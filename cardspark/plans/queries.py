"""All registered queries of the library's own operators, with their oracles."""

from . import card_queries, file_queries, stream_queries, text_queries, usage_queries

_PARTS = (text_queries, card_queries, usage_queries, stream_queries, file_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
