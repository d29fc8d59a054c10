"""Registered queries of this package and their SQL."""

from . import chat_format, embedding_dedup, html_extract, language_id, license_scan, mixing, ngram_join, packing, quality_rules, token_rollups

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_best_fit_pack": packing.op3_best_fit_pack,
    "op4_language_id": language_id.op4_language_id,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_chat_format": chat_format.op6_chat_format,
    "chat_linked_calls": chat_format.linked_calls,
    "op7_token_rollup": token_rollups.op7_token_rollup,
    "token_rollup_words": token_rollups.token_rollup_words,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
ORACLE_SQL = {"op6_chat_format": chat_format.OP6_SQL, "chat_linked_calls": chat_format.LINKED_SQL, "token_rollup_words": token_rollups.WORDS_SQL, "op8_quality_rules": quality_rules.OP8_SQL}
