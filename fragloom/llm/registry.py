"""All queries of the subpackage and their SQL."""

from fragloom.llm import corpus, sets_and_groups

QUERIES = {**sets_and_groups.QUERIES, **corpus.QUERIES}
SQL = {**sets_and_groups.SQL, **corpus.SQL}
