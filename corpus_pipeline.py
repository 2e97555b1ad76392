"""The corpus pipeline of ``strataq.llm``: its stages, the whole of them, and their SQL."""

from strataq.llm.pipeline import ORACLE_SQL, STAGES, decontamination, near_duplicates, packing, run, toxicity

__all__ = ["ORACLE_SQL", "STAGES", "decontamination", "near_duplicates", "packing", "run", "toxicity"]
