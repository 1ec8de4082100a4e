"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from seriesloom.llm import annsearch, decontaminate, htmltext, langid, linededup, mixing, quality, simhash, suffixdedup, tokencount

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_inverted_multi_index": annsearch.query,
    "op3_language_id": langid.query,
    "op4_quality_classifier": quality.query,
    "op5_edit_aware_token_counts": tokencount.query,
    "op6_simhash_near_dup": simhash.query,
    "op7_html_text": htmltext.query,
    "op8_suffix_array_dedup": suffixdedup.query,
    "op9_line_dedup": linededup.query,
    "op10_decontaminate": decontaminate.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_inverted_multi_index": annsearch.ORACLE,
    "op8_suffix_array_dedup": suffixdedup.ORACLE,
    "op9_line_dedup": linededup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
