"""Operators for training-data pipelines, with their queries and, where SQL can express them, oracle SQL."""

from . import decontamination, langid, license_scan, line_dedup, mixing, ngram_jaccard, quality_model, quality_rules, token_count, warc

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.query,
    "op2_line_dedup": line_dedup.query,
    "op3_token_counts": token_count.query,
    "op4_decontamination": decontamination.query,
    "op5_quality_model": quality_model.query,
    "op6_quality_rules": quality_rules.query,
    "op7_source_mix": mixing.query,
    "op8_warc_derivatives": warc.query,
    "op9_language_id": langid.query,
    "op10_license_scan": license_scan.query,
}

ORACLES = {
    "op1_ngram_jaccard": ngram_jaccard.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op7_source_mix": mixing.ORACLE,
}
