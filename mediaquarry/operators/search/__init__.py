"""Ranked full-text search over a catalog's docs."""

from .bounds import ALL, block_bounds, counted, explore_top, write_bounds
from .index import Index, build, dictionary
from .parse import InvalidSearchQuery, parse
from .rank import explore, explore_deep, hits, ranked

__all__ = ["ALL", "Index", "InvalidSearchQuery", "block_bounds", "build", "counted", "dictionary", "explore", "explore_deep", "explore_top", "hits", "parse", "ranked", "write_bounds"]
