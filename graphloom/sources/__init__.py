"""Table readers and scratch storage."""

from .scratch import drop_scratch, spill
from .tables import spread, table

__all__ = ["drop_scratch", "spill", "spread", "table"]
