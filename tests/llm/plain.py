"""Queries of this folder that have no SQL, and the tests that hold them against plain versions or known results."""

BRUTE_FORCE = {
    "op2_toxicity": "tests/llm/test_models.py::test_toxic_expressions_are_found_in_held_out_documents",
    "op3_mix_sources": "tests/llm/test_rows.py::test_expected_tokens_meet_the_targets",
    "op4_language_id": "tests/llm/test_models.py::test_scores_equal_a_plain_walk",
    "op5_resharding": "tests/llm/test_rows.py::test_flow_costs_no_more_than_any_other",
    "op6_pii_pseudonyms": "tests/llm/test_rows.py::test_values_keep_their_format_and_come_back",
    "op7_html_text": "tests/llm/test_rows.py::test_region_is_the_best_run",
    "op8_fingerprints": "tests/llm/test_rows.py::test_edited_texts_follow_the_order_of_ids",
    "op9_quality_rules": "tests/llm/test_models.py::test_base_counts_equal_brute_force",
    "op10_packing": "tests/llm/test_rows.py::test_pieces_hold_the_ids_of_the_tokenizer",
    "op13_piece_encoding": "tests/llm/test_pieces.py::test_query_digests",
    "pipeline": "tests/llm/test_pipeline.py::test_stages_hand_on_the_columns_of_documents",
}
