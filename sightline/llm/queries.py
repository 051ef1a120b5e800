"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import chat_format, collocations, exact_dedup, html_extract, license_scan, minhash_dedup, mixing, packing, quality_crf, quality_rules, spelling, suffix_dedup, token_files


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_minhash_neardup": minhash_dedup.op3_minhash_neardup,
        "op4_html_main_text": html_extract.op4_html_main_text,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_token_files": token_files.op7_token_files,
        "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_phrase_collocations": collocations.op11_phrase_collocations,
        "op12_quality_classifier": quality_crf.op12_quality_classifier,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.sql(),
        "op3_minhash_neardup": minhash_dedup.SQL,
        "op4_html_main_text": html_extract.SQL,
        "op5_quality_rules": quality_rules.SQL,
        "op9_chat_format": chat_format.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
        "op11_phrase_collocations": collocations.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
