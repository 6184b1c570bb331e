"""Every registered query with its SQL counterpart."""

from trialwright.queries import curves, data, logs, models, runs, stops, streams  # noqa: F401
from trialwright.queries.registry import ORACLES, QUERIES  # noqa: F401
