"""Registry of this subpackage: query name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from . import (bm25_search, centroid_clustering, chat_format, context_tree, decontaminate, html_tree, language_id,
               minmax_dedup, packing, pii, substring_dedup, toxicity_crf, turn_repair)

REGISTRY = {
    "op1_best_fit_packing": (packing.op1_best_fit_packing, None),
    "op2_prefix_target_chat": (chat_format.op2_prefix_target_chat, chat_format.OP2_SQL),
    "op3_weak_supervision_pii": (pii.op3_weak_supervision_pii, None),
    "op4_toxicity_crf": (toxicity_crf.op4_toxicity_crf, None),
    "op5_tree_model_html": (html_tree.op5_tree_model_html, None),
    "op6_minmax_near_duplicates": (minmax_dedup.op6_minmax_near_duplicates, None),
    "op7_context_tree_lm": (context_tree.op7_context_tree_lm, None),
    "op8_bm25_decontamination": (decontaminate.op8_bm25_decontamination, None),
    "op9_nearest_centroid_language": (language_id.op9_nearest_centroid_language, None),
    "op10_bm25_top_k": (bm25_search.op10_bm25_top_k, None),
    "op11_super_kmer_dedup": (substring_dedup.op11_super_kmer_dedup, substring_dedup.OP11_SQL),
    "op12_centroid_clustering": (centroid_clustering.op12_centroid_clustering, centroid_clustering.OP12_SQL),
    "op13_turn_repair": (turn_repair.op13_turn_repair, None),
}


def queries():
    return {name: call for name, (call, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
