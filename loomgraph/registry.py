"""All queries of the engine by inventory id, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from loomgraph.plans import registered_graph, registered_more, registered_rank, registered_rest, registered_scalars, registered_sources  # noqa: F401
from loomgraph.plans.catalog import ORACLE_SQL, QUERIES

FLAGSHIP = "res_ladder"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
