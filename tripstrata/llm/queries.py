"""The queries of the thirteen operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripstrata.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1.op1_simhash,
        "op2_suffix_dedup": op2.op2_suffix_dedup,
        "op3_lm_score": op3.op3_lm_score,
        "op4_language_id": op4.op4_language_id,
        "op5_personal_data": op5.op5_personal_data,
        "op6_exact_dedup": op6.op6_exact_dedup,
        "op7_toxicity": op7.op7_toxicity,
        "op8_shard": op8.op8_shard,
        "op9_pack": op9.op9_pack,
        "op10_decontaminate": op10.op10_decontaminate,
        "op11_bpe": op11.op11_bpe,
        "op12_resample": op12.op12_resample,
        "op13_whiten": op13.op13_whiten,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": op2.ORACLE, "op6_exact_dedup": op6.ORACLE, "op10_decontaminate": op10.ORACLE}
