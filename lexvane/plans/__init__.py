"""Whole-query plans built from the operators."""

from lexvane.plans.engine import Engine, plan, requests_of

__all__ = ["Engine", "plan", "requests_of"]
