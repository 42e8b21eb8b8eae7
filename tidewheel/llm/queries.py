"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, class_lm, decontaminate, host_rules, language_id, merkle, near_dedup, packing, secret_scan, suffix_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_language_id": language_id.op2_language_id,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_class_lm": class_lm.op5_class_lm,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_host_rules": host_rules.op10_host_rules,
    "op11_token_files": token_files.op11_token_files,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLES = {"op10_host_rules": host_rules.ORACLE_OP10, "op12_centroid_clusters": centroids.ORACLE_OP12, "op13_merkle_manifest": merkle.ORACLE_OP13}
