"""Registered queries. Importing this package fills `registry.PLANS`."""

from tickledger.plans import audits, histories, late, snapshot, sources, streams
from tickledger.plans.registry import PLANS

__all__ = ["PLANS", "audits", "histories", "late", "snapshot", "sources", "streams"]
