"""Importing the query modules registers their queries."""

from importlib import import_module

MODULES = ["source_queries", "kb_queries", "text_queries", "eval_queries", "matrix_queries",
           "sentiment_queries", "graph_queries", "model_queries"]


def load() -> None:
    for name in MODULES:
        import_module(f"standout.plans.{name}")
