"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from . import catalog, lists, logs, plan, sessions, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "lists", "logs", "plan", "sessions", "text"]
