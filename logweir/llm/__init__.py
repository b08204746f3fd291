"""Operators for preparing training text: one module per operator, each with its `opN_*` query."""

from logweir.llm.registry import llm_oracle_sql, llm_queries

__all__ = ["llm_oracle_sql", "llm_queries"]
