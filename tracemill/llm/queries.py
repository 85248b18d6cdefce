"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import alignment, collocations, contamination, html_extract, jaccard, langid, near_vectors, packing, quality, records, secret_scan, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_consensus": html_extract.op2_html_consensus,
    "op3_decontamination": contamination.op3_decontamination,
    "op4_binary_records": records.op4_binary_records,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_near_vectors": near_vectors.op7_near_vectors,
    "op8_language_id": langid.op8_language_id,
    "op9_pattern_packing": packing.op9_pattern_packing,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_decontamination": contamination.SQL,
    "op7_near_vectors": near_vectors.SQL,
    "op10_jaccard_join": jaccard.SQL,
    "op11_secret_scan": secret_scan.SQL,
    "op13_collocations": collocations.SQL,
}
