"""The queries of this subpackage's operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import decontaminate, lm, mixing, neardup, pii, quality, substrings, tokenbin, topk, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": tokenbin.op1_token_ids,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality": quality.op3_quality,
        "op4_substrings": substrings.op4_substrings,
        "op5_lm_score": lm.op5_lm_score,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_url_filter": urls.op8_url_filter,
        "op9_top_k": topk.op9_top_k,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op9_top_k": topk.SQL}
