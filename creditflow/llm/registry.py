"""The queries of this subpackage by name, and their SQL where SQL can state them."""

from __future__ import annotations

from creditflow.llm import (
    bag_minhash,
    decontaminate,
    dual_tree,
    heap_clusters,
    language_id,
    line_dedup,
    packing,
    rule_quality,
    secret_scan,
    substring_dedup,
    token_alignment,
    token_attribution,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.op1_substring_dedup,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_token_attribution": token_attribution.op3_token_attribution,
        "op4_language_id": language_id.op4_language_id,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_dual_tree_topk": dual_tree.op6_dual_tree_topk,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_bag_minhash": bag_minhash.op9_bag_minhash,
        "op10_differencing_packing": packing.op10_differencing_packing,
        "op11_rule_quality": rule_quality.op11_rule_quality,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_heap_clusters": heap_clusters.op13_heap_clusters,
    }


def oracle_sql() -> dict:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE_SQL,
        "op2_secret_scan": secret_scan.ORACLE_SQL,
        "op6_dual_tree_topk": dual_tree.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op9_bag_minhash": bag_minhash.ORACLE_SQL,
        "op13_heap_clusters": heap_clusters.ORACLE_SQL,
    }
