"""The queries of this subpackage and, where SQL can express them, the DuckDB SQL for the same rows."""

from __future__ import annotations

from . import centroids, decontam, htmltext, langid, mixing, neardup, pii, quality, rules, stamps, tokens, topk, urlrules


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_token_counts": tokens.op2_token_counts,
        "op3_language_id": langid.op3_language_id,
        "op4_source_mix": mixing.op4_source_mix,
        "op5_minhash_near_dedup": neardup.op5_minhash_near_dedup,
        "op6_pii": pii.op6_pii,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_url_filters": urlrules.op8_url_filters,
        "op9_exact_topk": topk.op9_exact_topk,
        "op10_html_text": htmltext.op10_html_text,
        "op11_mixed_stamps": stamps.op11_mixed_stamps,
        "op12_centroids": centroids.op12_centroids,
        "op13_quality_rules": rules.op13_quality_rules,
    }


def oracle_sql() -> dict:
    return {
        "op4_source_mix": mixing.ORACLE,
        "op8_url_filters": urlrules.oracle(),
        "op9_exact_topk": topk.ORACLE,
        "op11_mixed_stamps": stamps.ORACLE,
        "op12_centroids": centroids.ORACLE,
        "op13_quality_rules": rules.ORACLE,
    }
