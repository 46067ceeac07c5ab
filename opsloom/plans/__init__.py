"""The registered queries, one module per group of operators."""

from importlib import import_module

MODULES = ["selection", "summaries", "panels", "alerting", "state_quality", "documents",
           "similarity", "training", "storage", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"opsloom.plans.{name}")
