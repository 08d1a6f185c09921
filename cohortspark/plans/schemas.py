"""The published tables' closed schemas."""

from __future__ import annotations

# Ordered columns of each published table.
SCHEMAS: dict[str, tuple[str, ...]] = {
    "cohort_flow": (
        "flow_order",
        "row_type",
        "stage_id",
        "stage_label",
        "starting_n",
        "excluded_n",
        "retained_n",
        "percent_of_enrolled",
        "exclusion_definition",
        "notes",
    ),
    "sample_characteristics": (
        "scope_order",
        "scope",
        "characteristic_order",
        "characteristic",
        "characteristic_label",
        "level_order",
        "level",
        "summary_type",
        "unit",
        "n_total",
        "n_observed",
        "n_missing",
        "count",
        "percentage",
        "mean",
        "standard_deviation",
        "median",
        "q1",
        "q3",
        "minimum",
        "maximum",
        "notes",
    ),
    "outcomes_by_member_type": (
        "scope_order",
        "scope",
        "outcome_order",
        "outcome",
        "outcome_label",
        "outcome_type",
        "unit",
        "n_total",
        "n_observed",
        "n_missing",
        "mean",
        "standard_deviation",
        "median",
        "q1",
        "q3",
        "minimum",
        "maximum",
        "numerator",
        "denominator",
        "percentage",
        "ci_lower",
        "ci_upper",
        "ci_level",
        "ci_method",
    ),
    "engagement_by_member_type": (
        "scope_order",
        "scope",
        "metric_order",
        "metric",
        "metric_label",
        "unit",
        "n_total",
        "n_observed",
        "n_missing",
        "zero_n",
        "reached_n",
        "mean",
        "standard_deviation",
        "median",
        "q1",
        "q3",
        "minimum",
        "maximum",
        "exposure_window_definition",
        "denominator_definition",
    ),
    "engagement_activity_summary": (
        "event_order",
        "event_type",
        "actionability_class",
        "is_repeatable",
        "n_analysis",
        "n_reached",
        "n_zero",
        "total_events",
        "events_per_reached_member",
        "median_events_among_reached",
        "q1_events_among_reached",
        "q3_events_among_reached",
        "predictor",
        "predictor_transform",
        "effect_unit",
        "estimate",
        "standard_error",
        "test_statistic",
        "reference_distribution",
        "degrees_of_freedom",
        "p_value",
        "ci_lower",
        "ci_upper",
        "ci_level",
        "fdr_method",
        "fdr_family",
        "fdr_test_count",
        "fdr_adjusted_p_value",
        "covariance_estimator",
        "adjustment_terms",
        "reference_member_type",
        "test_status",
        "interpretation",
    ),
    "modules_by_member_type": (
        "scope_order",
        "scope",
        "module_order",
        "module_variable",
        "module_label",
        "module_group",
        "available_title_denominator",
        "availability_status",
        "support_scope",
        "n_members",
        "n_members_with_completion",
        "n_members_without_completion",
        "member_completion_percentage",
        "total_unique_completions",
        "mean_completion_count",
        "standard_deviation_count",
        "median_completion_count",
        "q1_completion_count",
        "q3_completion_count",
        "minimum_completion_count",
        "maximum_completion_count",
        "mean_completion_proportion",
        "standard_deviation_proportion",
        "zero_completion_group_flag",
        "completion_definition",
        "cross_group_comparability",
        "interpretation",
    ),
    "base_model_comparison_summary": (
        "model_order",
        "model_id",
        "model_family",
        "modeled_outcome",
        "prediction_target",
        "metric_order",
        "metric",
        "metric_unit",
        "n_members",
        "cv_repeats",
        "cv_folds",
        "n_fold_scores",
        "n_test_predictions",
        "mean_score",
        "standard_deviation",
        "minimum_score",
        "maximum_score",
        "fold_plan_id",
        "score_aggregation",
        "rank",
        "is_winner",
        "winner_rule",
        "tie_tolerance",
        "validation_scope",
    ),
    "lasso_mean_selection": (
        "specification_order",
        "module_spec",
        "is_winning_specification",
        "candidate_order",
        "candidate",
        "candidate_label",
        "candidate_role",
        "support_scope",
        "reference_level",
        "penalty_status",
        "selected_lambda_ratio",
        "full_sample_lambda",
        "full_sample_lambda_max",
        "cv_selection_rule",
        "cv_mean_mse",
        "cv_standard_error",
        "fold_plan_id",
        "n_resamples",
        "subsample_fraction",
        "selection_threshold",
        "full_sample_coefficient",
        "full_sample_standardized_coefficient",
        "selection_count",
        "selection_frequency",
        "selected_at_threshold",
        "eligible_for_locked_model",
        "locked_model_status",
        "exclusion_reason",
        "coefficient_unit",
        "interpretation",
    ),
    "locked_model_coefficients_hc3": (
        "model_id",
        "term_order",
        "term",
        "term_label",
        "term_role",
        "support_scope",
        "contrast",
        "reference",
        "estimate",
        "standard_error",
        "test_statistic",
        "reference_distribution",
        "degrees_of_freedom",
        "p_value",
        "ci_lower",
        "ci_upper",
        "ci_level",
        "unit",
        "n_members",
        "covariance_estimator",
        "winning_base_model",
        "winning_module_spec",
        "selection_frequency",
        "selection_provenance",
        "inference_status",
    ),
    "locked_model_fit_statistics": (
        "model_id",
        "winning_base_model",
        "winning_module_spec",
        "analysis_population",
        "modeled_outcome",
        "model_formula",
        "reference_member_type",
        "duration_adjustment",
        "n_members",
        "n_parameters",
        "residual_degrees_of_freedom",
        "covariance_estimator",
        "r_squared",
        "adjusted_r_squared",
        "residual_rmse",
        "negative_two_log_likelihood",
        "aic",
        "bic",
        "likelihood_use",
        "standardized_design_condition_number",
        "maximum_leverage",
        "maximum_cooks_distance",
        "selection_rule",
        "inference_status",
        "fit_status",
    ),
    "model_diagnostics": (
        "model_id",
        "diagnostic_order",
        "diagnostic_type",
        "row_type",
        "series",
        "bin_order",
        "bin_method",
        "bin_lower",
        "bin_upper",
        "bin_count",
        "x_value",
        "y_value",
        "y_lower",
        "y_upper",
        "metric",
        "value",
        "threshold",
        "flag",
        "status",
        "interpretation",
    ),
    "hypothesis_evidence": (
        "hypothesis_order",
        "hypothesis_id",
        "question",
        "prespecified_expectation",
        "estimand",
        "population",
        "exposure_or_predictor",
        "outcome",
        "adjustment_set",
        "evidence_table",
        "evidence_filter",
        "result_status",
        "effect_summary",
        "uncertainty_summary",
        "multiplicity_control",
        "inference_status",
        "causal_status",
        "noncausal_interpretation",
        "leadership_action",
        "randomized_pilot_population",
        "randomized_pilot_comparator",
        "randomized_pilot_kpi",
        "randomized_pilot_time_horizon",
    ),
    "findings_and_implications": (
        "finding_order",
        "finding_id",
        "finding",
        "quantitative_evidence",
        "evidence_table",
        "evidence_filter",
        "interpretation",
        "certainty",
        "causal_status",
        "leadership_implication",
        "recommended_test",
        "pilot_population",
        "pilot_intervention",
        "pilot_comparator",
        "pilot_primary_kpi",
        "pilot_time_horizon",
    ),
    "limitations": (
        "limitation_order",
        "limitation_id",
        "category",
        "limitation",
        "empirical_evidence",
        "affected_estimand",
        "potential_impact",
        "direction_of_bias",
        "affected_outputs",
        "mitigation_in_current_analysis",
        "recommended_future_design",
        "severity",
    ),
}
SCHEMAS["lasso_domain_selection"] = SCHEMAS["lasso_mean_selection"]
