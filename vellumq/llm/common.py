"""Shared pieces."""

from __future__ import annotations

from vellumq.operators.running import partitions, prefix_sums

__all__ = ["partitions", "prefix_sums"]
