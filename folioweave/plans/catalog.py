"""All queries: importing the modules registers them."""

from . import aggregates, checks, extract, feeds, graph, relational, retrieval, roots, scalars  # noqa: F401
from .registry import IDS, QUERIES, SQL  # noqa: F401
