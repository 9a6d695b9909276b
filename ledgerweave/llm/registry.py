"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import decontamination
from ledgerweave.llm.decontamination import op8_benchmark_decontamination
from ledgerweave.llm.html_extract import op5_html_extraction
from ledgerweave.llm.language_id import op4_language_id
from ledgerweave.llm.lm_scoring import op2_lm_scoring
from ledgerweave.llm.packing import op1_best_fit_packing
from ledgerweave.llm.quality import op7_quality_classifier
from ledgerweave.llm.quality_rules import op9_quality_rules
from ledgerweave.llm.simhash_dedup import op10_simhash_near_dedup
from ledgerweave.llm.token_counts import op6_token_counts
from ledgerweave.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_lm_scoring, op3_toxicity, op4_language_id, op5_html_extraction,
        op6_token_counts, op7_quality_classifier, op8_benchmark_decontamination, op9_quality_rules, op10_simhash_near_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op8_benchmark_decontamination": decontamination.ORACLE_SQL}
