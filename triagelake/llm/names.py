"""Names for helper columns."""

from __future__ import annotations

from triagelake.operators.rows import fresh

__all__ = ["fresh"]
