"""All queries of the engine outside the training-data subpackage."""

from quillon.plans import actions, audits, confirmations, curation, detection, evaluation, events, flows, frames, handoff, layouts, planners, privacy, records, samples, sanitise, stats, stored, verdicts, wire  # noqa: F401
from quillon.registry import COVERS, ORACLES, QUERIES  # noqa: F401
