"""The corpus pipeline, which ledgerloom.llm.pipeline holds: its stages, their run, and its SQL."""

from __future__ import annotations

from ledgerloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
