"""Queries opN_<name> of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact, html_text, langid, lm, minhash, mixing, packing, quality_fm, rules, toxicity
from tessella.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda spark, d: langid.identify(table(spark, d, "documents")),
        "op2_lm_score": lambda spark, d: lm.score_documents(table(spark, d, "documents")),
        "op3_near_dedup": lambda spark, d: minhash.components(table(spark, d, "documents")),
        "op4_exact_dedup": lambda spark, d: exact.exact_groups(table(spark, d, "documents")),
        "op5_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
        "op6_html_text": lambda spark, d: html_text.extract(table(spark, d, "pages")),
        "op7_quality_rules": lambda spark, d: rules.quality(table(spark, d, "documents")),
        "op8_mixing": lambda spark, d: mixing.taken(table(spark, d, "documents")),
        "op9_quality_classifier": lambda spark, d: quality_fm.quality(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": minhash.SQL, "op4_exact_dedup": exact.SQL}
