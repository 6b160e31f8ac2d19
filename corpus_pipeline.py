"""The corpus pipeline of ``llm.pipeline``: STAGES, run() and ORACLE_SQL."""

from llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
