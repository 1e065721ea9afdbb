"""All queries of the engine's own operators, with their SQL for DuckDB."""

from sightline.plans import connectors, detection, devices, space  # noqa: F401
from sightline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
