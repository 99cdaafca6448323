"""All queries of the library and their SQL, by name."""

from veritrail.plans import decisions, layout, parsing, reads, relational, similarity, spans, streams, tables, text, training

_PLANS = (relational, text, similarity, decisions, training, layout, streams, tables, reads, parsing, spans)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL = {name: text for plan in _PLANS for name, text in plan.SQL.items()}
