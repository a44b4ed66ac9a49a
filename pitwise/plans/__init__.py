"""Compositions of operators, and the registered queries over the given tables."""

from importlib import import_module

_MODULES = ("queries_scan", "queries_features", "queries_scores", "queries_models",
            "queries_streams")


def load_queries() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
