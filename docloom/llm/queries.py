"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from docloom.llm import decontamination, jaccard_join, line_dedup, pieces, pii, quality_classifier, quality_rules, secrets, substring_dedup, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_pieces": pieces.op10_pieces,
}

ORACLE_SQL = {
    "op2_secret_scan": secrets.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
}
