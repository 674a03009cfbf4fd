"""Registered queries over the driver's tables."""

import importlib

MODULES = ("q_design", "q_features", "q_conformal", "q_mixture", "q_scoring", "q_stats")


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"varve.plans.{name}")
    return importlib.import_module("varve.plans.registry")
