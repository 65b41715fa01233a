"""Registered queries, one module per subject."""

from corpuslens.plans import inventory, bundles, index, review, retrieval, prompts, ledger, live  # noqa: F401
from corpuslens.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
