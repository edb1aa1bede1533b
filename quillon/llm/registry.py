"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import decontamination, fill_middle, language_id, line_dedup, mixing, ngram_join, oracles, pii, quality_classifier, quality_rules, secret_scan, suffix_dedup, url_filter, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
    "whitening_base": whitening.whitening_base,
    "url_rules": url_filter.url_rules,
    "pii_base": pii.pii_base,
}
ORACLE_SQL = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op7_suffix_dedup": oracles.SUFFIXES,
    "op8_ngram_join": oracles.JOIN,
    "op10_secret_scan": oracles.SECRETS,
    "pii_base": oracles.PERSONAL,
    "pipeline": corpus_pipeline.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "whitening_base": whitening.BASE_SQL,
    "url_rules": url_filter.RULES_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
}
