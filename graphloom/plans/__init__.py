"""Query plans: small driver-side documents that are compiled to DataFrame joins."""

from .plan import Entity, Hop, Plan, PlanError

__all__ = ["Entity", "Hop", "Plan", "PlanError"]
