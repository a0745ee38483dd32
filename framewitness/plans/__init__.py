"""Whole investigations put together from the operators."""

from framewitness.plans.investigate import Investigation, investigate

__all__ = ["Investigation", "investigate"]
