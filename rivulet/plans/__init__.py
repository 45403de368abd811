"""Named queries and, where SQL can state them, the SQL that must give the same rows."""

from rivulet.plans import general, models, pipeline, serving, streams, transport

_ALL = (pipeline, serving, models, streams, transport, general)
CORE_QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
CORE_SQL = {name: s for m in _ALL for name, s in m.SQL.items()}
