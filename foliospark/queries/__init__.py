"""Queries over the given tables, one per operator, with the SQL that checks them.

Every query runs over whole tables. Functions that run in the executors are
written inside their query, so the executors need no copy of this package.
"""

from foliospark.queries import cells, fanout, json_texts, layers, reports, scripts, tables

_GROUPS = (tables, json_texts, fanout, reports, layers, cells, scripts)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
