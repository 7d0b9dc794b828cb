"""All queries of the scene tables and their SQL; importing the modules registers them."""

from kinotable import motion_queries, scene_queries, tree_queries, verdict_queries  # noqa: F401
from kinotable.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
