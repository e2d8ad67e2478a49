"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from lectern.llm import bpe, chosen_path, filter_audit, html_text, importance, jaccard_join, langid, mixing, nn_descent, order_minhash, substring_dedup, suffix_dedup, token_store

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_fingerprints": order_minhash.op3_fingerprints,
    "op4_html": html_text.op4_html,
    "op5_language": langid.op5_language,
    "op6_bpe": bpe.op6_bpe,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_nearest": nn_descent.op9_nearest,
    "op10_mixing": mixing.op10_mixing,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_importance": importance.op12_importance,
    "op13_near_dedup": chosen_path.op13_near_dedup,
}

ORACLE_SQL = {
    "op10_mixing": mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}
