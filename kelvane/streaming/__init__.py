"""Structured Streaming forms of the stateful operators."""

from .stateful import latest_status, quota_use, task_states

__all__ = ["latest_status", "quota_use", "task_states"]
