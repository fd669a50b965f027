"""The training-corpus pipeline: its stages, its run, and its SQL, if any; cardloom.llm.pipeline has them."""

from cardloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
