"""Queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, fm_quality, html_content, license_scan, line_dedup, ngram_join, phrase_dedup, phrase_mining, product_search, source_mix, spelling_variants, weak_rules

QUERIES = {
    "op1_license_scan": license_scan.license_query,
    "op2_html_content": html_content.html_query,
    "op3_chat_format": chat_format.format_query,
    "op4_line_dedup": line_dedup.line_dedup_query,
    "op5_ngram_jaccard": ngram_join.jaccard_query,
    "op6_quality_classifier": fm_quality.quality_query,
    "op7_source_mix": source_mix.mix_query,
    "op8_quality_rules": weak_rules.quality_rules_query,
    "op9_substring_dedup": phrase_dedup.substring_query,
    "op10_decontaminate": decontaminate.decontaminate_query,
    "op11_product_search": product_search.search_query,
    "op12_spelling_variants": spelling_variants.spelling_query,
    "op13_phrase_collocations": phrase_mining.collocation_query,
}
SQL = {
    "op1_license_scan": license_scan.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_ngram_jaccard": ngram_join.SQL,
    "op7_source_mix": source_mix.SQL,
    "op9_substring_dedup": phrase_dedup.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_product_search": product_search.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_phrase_collocations": phrase_mining.SQL,
}
