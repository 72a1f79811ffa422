"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, class_lm, jaccard_join, lexical, license_scan, packing, quality_rules, rule_ensemble, simhash, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_quality_classifier": rule_ensemble.op1_quality_classifier,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard_join": jaccard_join.op5_ngram_jaccard_join,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_topk_search": topk.op8_topk_search,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_class_lm": class_lm.op10_class_lm,
    "op11_simhash": simhash.op11_simhash,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_ranked_search": lexical.op13_ranked_search,
}

ORACLE_SQL = {
    "op8_topk_search": topk.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op13_ranked_search": lexical.SQL,
}
