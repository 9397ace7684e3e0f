"""All queries of the core and their SQL."""

from fragloom.plans import genotyping, graphs, problems, reads, variants

_MODULES = (problems, reads, variants, graphs, genotyping)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
