"""The pipeline of ``graphlake.llm.pipeline``: language, exact copies, near copies, mixture, tokens."""

from graphlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
