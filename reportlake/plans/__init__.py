"""Registered queries, their fixtures and their SQL counterparts."""

from reportlake.plans import report_queries, task_queries  # noqa: F401
from reportlake.plans.registry import ORACLE, QUERIES  # noqa: F401
