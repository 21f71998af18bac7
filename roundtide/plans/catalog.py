"""All registered queries."""

from roundtide.plans import generated, identity_q, reads, scalar, state_q, streams  # noqa: F401
from roundtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
