"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, language_model, licenses, packing, pii, quality_classifier, quality_rules, secret_owners, sharding, simhash

QUERIES = {
    "op1_cumulative_link": quality_classifier.query,
    "op2_elias_fano_trie": language_model.query,
    "op3_covariance_determinant": quality_rules.query,
    "op4_greedy_string_tiling": decontamination.query,
    "op5_anchor_expansion": pii.query,
    "op6_ownership_frequency": secret_owners.query,
    "op7_vantage_point_trees": simhash.query,
    "op8_minimum_bin_slack": packing.query,
    "op9_patience_alignment": licenses.query,
    "op10_histogram_sort": sharding.query,
}

SQL: dict[str, str] = {}
