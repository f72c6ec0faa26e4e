"""Imports every query module so that the registry is complete."""

from perpflow.plans import analysis, backtests, features, gates, market, streams  # noqa: F401
from perpflow.plans.common import ORACLES, QUERIES  # noqa: F401
