"""The document pipeline: classifier, rules, near-duplicates, packing. Its stages are in tidemill.llm.pipeline."""

from tidemill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
