"""Registered queries, each with its SQL counterpart where SQL can say it."""

import importlib

GROUPS = ["cleaning", "sampling", "scoring", "sequencing", "networks", "training", "streams"]


def load():
    """The registry with every group of queries imported."""
    for group in GROUPS:
        importlib.import_module(f"flowloom.plans.{group}")
    return importlib.import_module("flowloom.plans.registry")
