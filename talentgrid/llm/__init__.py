"""Training-data operators (quality, dedup, toxicity, packing, formatting, sharding).

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` feed the
entry module; each ``opNN`` module holds one operator with its general interface plus the
thin query over the stated table.
"""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
