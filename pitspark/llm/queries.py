"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontamination, html_extraction, jaccard, langid, line_dedup, packing, quality, repeats, sharding

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_language_id": langid.op9_language_id,
    "op10_suffix_array_dedup": repeats.op10_suffix_array_dedup,
}
SQL = {
    "op3_quality_rules": quality.OP3_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_ngram_jaccard_join": jaccard.OP6_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op8_benchmark_decontamination": decontamination.OP8_SQL,
    "op10_suffix_array_dedup": repeats.OP10_SQL,
}
