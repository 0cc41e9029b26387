"""The registered queries by name."""

from freshet.plans import analytics, feeds, forecasting, networks, operations, scenarios, states
from freshet.plans.catalog import REGISTRY

__all__ = ["REGISTRY", "analytics", "feeds", "forecasting", "networks", "operations", "scenarios", "states"]
