"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from relictum.llm import decontam, html, lbl, logindex, packing, quality, simhash, suffix, tokenstore, urlfilter


def queries() -> dict:
    return {
        "op1_simhash_neardup": simhash.query,
        "op2_packing": packing.query,
        "op3_decontamination": decontam.query,
        "op4_lm_scoring": lbl.query,
        "op5_url_filters": urlfilter.query,
        "op6_suffix_dedup": suffix.query,
        "op7_html_extraction": html.query,
        "op8_log_index_dedup": logindex.query,
        "op9_quality_rules": quality.query,
        "op10_token_store": tokenstore.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.SQL, "op5_url_filters": urlfilter.SQL}
