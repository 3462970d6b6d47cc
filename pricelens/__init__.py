"""Pricing and profitability analytics on Spark DataFrames."""

from .engine import Engine
from .operators.facts import Analysis, Tables, DateWindow

__all__ = ["Engine", "Analysis", "Tables", "DateWindow"]
