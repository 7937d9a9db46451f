"""The queries of this package by name, and their SQL."""

from . import chat_format, conversation_trie, decontaminate, hard_negatives, license_scan, line_dedup, ngram_join, sequence_packing
from . import source_mixing, substring_dedup, topk_search, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_best_fit_packing": sequence_packing.op11_best_fit_packing,
    "op12_conversation_trie": conversation_trie.op12_conversation_trie,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op6_source_mixing": source_mixing.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
