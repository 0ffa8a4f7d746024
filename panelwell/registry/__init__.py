"""Named queries over the driver's tables, each with the SQL that checks it."""

from panelwell.registry.core import REGISTRY
from panelwell.registry import cohort, features, manifests, metrics, modelling, splitting, windows  # noqa: F401  (fill the registry)

__all__ = ["REGISTRY"]
