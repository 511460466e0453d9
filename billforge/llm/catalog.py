"""Queries of this subpackage, by name, and SQL for those that DuckDB can express. The others use XXH64, learned models, random draws
or components of similar texts; tests hold them against brute force."""

from __future__ import annotations

from . import op1_suffix_dedup, op2_quality, op3_decontaminate, op4_simhash, op5_lines, op6_licenses, op7_sharding, op8_paragraphs, op9_mixing, op10_secrets, op11_whitening, op12_search, op13_chat

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_dedup.query,
    "op2_quality_rules": op2_quality.query,
    "op3_decontamination": op3_decontaminate.query,
    "op4_simhash_dedup": op4_simhash.query,
    "op5_line_dedup": op5_lines.query,
    "op6_license_scan": op6_licenses.query,
    "op7_sharding": op7_sharding.query,
    "op8_paragraph_dedup": op8_paragraphs.query,
    "op9_source_mixing": op9_mixing.query,
    "op10_secret_scan": op10_secrets.query,
    "op11_embedding_whitening": op11_whitening.query,
    "op12_lexical_search": op12_search.query,
    "op13_chat_formatting": op13_chat.query,
}
SQL: dict[str, str] = {"op1_suffix_array_dedup": op1_suffix_dedup.SQL, "op7_sharding": op7_sharding.SQL, "op12_lexical_search": op12_search.SQL, "op13_chat_formatting": op13_chat.SQL}
