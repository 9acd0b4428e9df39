"""All registered queries."""

from fleetlens.catalog import (alerting, comparing, correlating, ingest, jobs, linking, live, rule_pass, ruling,  # noqa: F401
                               timing, writing)
from fleetlens.catalog.registry import ORACLES, QUERIES  # noqa: F401
