"""Named queries, by family."""

from lectern.plans import catalog_queries, library_queries, registry, scalar_queries, search_queries, text_queries

__all__ = ["catalog_queries", "library_queries", "registry", "scalar_queries", "search_queries", "text_queries"]
