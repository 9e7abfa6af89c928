"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, language, mixing, ngram_join, packing, prefix_trie, quality, sharding, token_counts, token_files, url_filter, vector_codes, warc

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_sharding": sharding.query,
    "op3_mixing": mixing.query,
    "op4_packing": packing.query,
    "op5_decontamination": decontamination.query,
    "op6_url_filter": url_filter.query,
    "op7_ngram_join": ngram_join.query,
    "op8_token_counts": token_counts.query,
    "op9_quality": quality.query,
    "op10_language": language.query,
    "op11_warc": warc.query,
    "op12_vector_codes": vector_codes.query,
    "op13_prefix_trie": prefix_trie.query,
    "quality_ablation": quality.ablated,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op9_quality": quality.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
    "quality_ablation": quality.ABLATION_SQL,
}
