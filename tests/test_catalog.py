"""Catalog queries against their SQL on the smallest scale factor."""

import pytest
from check import compare, connect

import __spark_entry__ as entry

FAST = [
    "a2_csv_round_trip", "a3_pool_sink", "a4_json_report", "b3_min_length", "c1_clean_documents",
    "c2_transcript_lines", "c5_intent_rules", "c5_intent_documents", "c6_escalation",
    "c11_word_ngrams", "c12_char_ngrams_short_words", "c16_unsupported_claims", "c20_dense_ids",
    "d1_pairs_from_transcripts", "d2_pairs_per_intent", "e4_topk_retrieval", "e8_text_leakage",
    "f2_vocab_diversity", "f3_dedupe", "f7_word_count_profile", "f16_stage_counts",
    "f21_weighted_kappa_spearman", "h5_prefix_fraction", "j1_pools", "j2_stratified_split",
    "k1_tfidf_documents", "k3_feature_union", "k6_naive_bayes", "k8_override",
    "l2_decisions_all_events", "l5_judge", "l7_l8_three_systems", "s1_score_stream",
    "a6_index_round_trip", "c22_prompts", "d3_prepared_pools", "f2_vocab_sketch",
    "f16_observed_counts", "f21_spearman_long_scale", "k5_hash_collisions", "k5_hashed_features",
    "k8_override_report", "k9_gap_classes", "k9_gap_matrix", "k9_gap_report",
    "k10_learning_curve", "k10_prefix_vocabulary", "k11_shared_grams", "k13_word_or_char",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf) == ""


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
