"""Imports every plan module so that its queries register."""

from ridelattice.plans import data, evaluation, fleet, live, marketplace, matching, network  # noqa: F401
from ridelattice.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
