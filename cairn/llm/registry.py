"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from cairn.llm import (
    html_extraction,
    importance,
    kneser_ney,
    line_dedup,
    lm_scoring,
    media,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    shallot,
    token_counts,
    url_filters,
)

_MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_ngram_join": ngram_join,
    "op3_html_extraction": html_extraction,
    "op4_lm_scoring": lm_scoring,
    "op5_mixing": mixing,
    "op6_media": media,
    "op7_packing": packing,
    "op8_line_dedup": line_dedup,
    "op9_kneser_ney": kneser_ney,
    "op10_url_filters": url_filters,
    "op11_token_counts": token_counts,
    "op12_centroid_clustering": shallot,
    "op13_importance_resampling": importance,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if module.ORACLE_SQL}
