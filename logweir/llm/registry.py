"""Queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweir.llm.langid import op3_language_id
from logweir.llm.linededup import OP6_SQL, op6_line_dedup
from logweir.llm.matroska import op5_matroska
from logweir.llm.mixing import op7_mixing
from logweir.llm.topk import OP10_SQL, op10_top_k
from logweir.llm.toxicity import op1_toxicity

from logweir.llm.minhash import OP9_SQL, op9_minhash

from logweir.llm.pii import op8_pii

from logweir.llm.pieces import op4_sentencepiece

from logweir.llm.substrings import OP2_SQL, op2_substring_dedup


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op3_language_id": op3_language_id,
        "op5_matroska": op5_matroska,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op9_minhash": op9_minhash,
        "op8_pii": op8_pii,
        "op4_sentencepiece": op4_sentencepiece,
        "op2_substring_dedup": op2_substring_dedup,
        "op10_top_k": op10_top_k,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_minhash": OP9_SQL, "op10_top_k": OP10_SQL}
