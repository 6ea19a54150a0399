"""All queries: importing the modules registers them."""

from reelspan import queries, queries_entities, queries_extra, queries_more, queries_timeline  # noqa: F401
from reelspan.registry import ORACLE_SQL, QUERIES  # noqa: F401
