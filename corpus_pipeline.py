"""A corpus pipeline of the training-data operators: language ID, near-duplicates, secrets, mixing, packing."""

from parcelmint.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
