"""Compiled expressions on streams: the dialect has no streaming of its own; its filters work on streaming frames."""

from dunlin.plans.compile import compile_on, query

__all__ = ["compile_on", "query"]
