"""Result columns whose SQL type is wider than Spark's: sums and counts as BIGINT.

SQL sums of integers are 128 bits wide there; the rows compare by value and type.
"""

_LOOP = ["compiled", "executed", "killed", "survived", "equivalent_suspected", "not_executed"]
_RATES = ["killed", "survived", "compile_failed", "other"]
_SUMMARY = ["compiled_tests", "executed_tests", "target_killed", "suite_killed", "suite_live"]

LONG_COLUMNS = {
    "P1_owner_members": ["fields", "id_sum"],
    "J15_candidate_imports": ["priorities"],
    "P2_feedback_funnel": ["no_analysis", "other_target", "low_confidence", "not_auto_repairable", "accepted"],
    "M9_replaced_children": ["child_sum"],
    "A30_F44_feedback_counts": [
        "knowledge_events", "actionable_knowledge", "actionable_imports", "actionable_other", "evidence_events",
        "generator_events", "other_events", "retryable", "actionable_kills",
    ],
    "J33_signature_agreement": ["errors"],
    "M2_changed_keys": ["original_size", "mutant_size"],
    "A1_A2_kill_details": [
        "compiled_count", "not_compiled_count", "killed_runs", "live_runs", "primary_runs", "fallback_runs",
        "timeout_runs", "elapsed_ms",
    ],
    "A3_baseline_details": ["killed_runs", "live_runs", "inferred_runs"],
    "A5_artifact_table": ["java_count", "class_count", "java_missing", "class_missing"],
    "A17_method_summary": _SUMMARY,
    "A32_S21_failure_groups": ["java_exists", "error_exists", "graph_exists", "graph_missing"],
    "M13_write_back_suite": ["suite_runs"],
    "A35_experiment_metrics": ["compiled", "executed", "target_killed", "suite_killed"],
    "W8_episodes": ["total_llm_calls", "total_compile_calls", "total_ms"],
    "A7_operator_rates": _RATES,
    "A8_class_rates": _RATES,
    "A29_loop_statistics": _LOOP,
    "T5_loop_statistics_by_round": _LOOP,
    "T5_streamed_loop_statistics": _LOOP,
    "S8_suite_reports": ["mutants", "killed", "live"],
    "S12_kill_statistics": ["killed", "live", "killing_tests"],
    "S13_killed_list": ["listed", "bare"],
    "S17_timing_lines": ["total_ms"],
    "A21_suite_scores": ["killed", "live"],
    "A22_history_scores": ["killed", "live", "equivalent"],
    "A23_test_set_scores": ["countable"],
    "J28_mapped_candidates": ["own", "test_no_sum"],
}

# ids that may be absent: -1 on both sides, so that the column stays an integer
ABSENT_IDS = {
    "J18_match_reports": ["index_row"],
    "J20_match_log_to_index": ["index_row"],
    "J21_unique_triple": ["index_row"],
    "M7_event_upsert": ["mutant_row_id"],
    "T3_streamed_feedback": ["mutant_row_id"],
}
