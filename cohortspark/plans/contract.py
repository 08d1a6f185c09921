"""What a run must fulfil before it is published: its metadata, its tables against each other, its tables against the study."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .figures import FIGURES
from .longitudinal import RATIO
from .models import Gls, Ols
from .resample import OLS_MODEL

# The keys of the metadata.
METADATA_KEYS = (
    "analysis_schema_version",
    "seed",
    "cv_folds",
    "cv_repeats",
    "stability_resamples",
    "lambda_ratios",
    "stability_subsample_fraction",
    "stability_selection_threshold",
    "complete_pair_eligible_members",
    "excluded_nonprimary_members",
    "included_members",
    "reference_member_type",
    "responder_threshold_percentage",
    "source_row_counts",
    "base_model_comparison_target",
    "base_model_comparison_metrics",
    "base_model_winner_rule",
    "winning_base_model",
    "cross_family_likelihood_comparison",
    "locked_covariance_estimator",
    "locked_inference_status",
    "selection_interpretation",
    "longitudinal_lasso_interpretation",
    "longitudinal_exploratory_lambda_ratio",
    "lasso_specification_tie_tolerance",
    "lasso_fold_plan_id",
    "lasso_fold_plan",
    "output_files",
)

#: What a run's metadata says of its method, the same in every run.
LABELS = {
    "analysis_schema_version": "1.0.0",
    "base_model_comparison_target": "raw_last_weight",
    "base_model_comparison_metrics": ["rmse", "mae"],
    "base_model_winner_rule": f"least mean rmse, then least mean mae, then {OLS_MODEL}",
    "cross_family_likelihood_comparison": False,
    "locked_covariance_estimator": "HC3",
    "locked_inference_status": "conditional_exploratory",
    "selection_interpretation": "selected terms describe these members; their p values do not account for the selection",
    "longitudinal_lasso_interpretation": "exploratory, with the covariance of the whole sample",
    "longitudinal_exploratory_lambda_ratio": RATIO,
    "lasso_specification_tie_tolerance": 1e-12,
    "lasso_fold_plan": "the same whole members in both specifications",
}

#: Percentage loss from which a member has responded.
RESPONDER = 5.0

#: Whole numbers in the metadata and the least that each may be.
WHOLE = {"seed": 0, "cv_folds": 2, "cv_repeats": 1, "stability_resamples": 1, "complete_pair_eligible_members": 1, "excluded_nonprimary_members": 0, "included_members": 1}


def check_metadata(metadata: Mapping[str, Any], tables: Mapping[str, pd.DataFrame], rows: Mapping[str, int] | None = None) -> None:
    """Fail unless the metadata has exactly its keys, plain finite values, and agrees with the tables (and the sources' row counts)."""
    problems = [f"missing {k}" for k in METADATA_KEYS if k not in metadata] + [f"unknown {k}" for k in metadata if k not in METADATA_KEYS]
    if problems:
        raise ValueError(f"metadata: {', '.join(problems)}")
    try:
        json.dumps(metadata, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise ValueError(f"metadata: {e}") from e
    for key, least in WHOLE.items():
        if type(metadata[key]) is not int or metadata[key] < least:
            problems.append(f"{key} must be a whole number from {least}")
    problems += [f"{k} must be {v!r}" for k, v in LABELS.items() if metadata[k] != v or type(metadata[k]) is not type(v)]
    ratios = metadata["lambda_ratios"]
    if not isinstance(ratios, list) or not ratios or any(type(x) not in (int, float) or not 0 <= x <= 1 for x in ratios) or len(set(ratios)) != len(ratios):
        problems.append("lambda_ratios must be different numbers in 0 to 1")
        ratios = []
    for key in ("stability_subsample_fraction", "stability_selection_threshold"):
        if type(metadata[key]) not in (int, float) or not 0 < metadata[key] <= 1:
            problems.append(f"{key} must lie in 0 to 1")
    flow = tables["cohort_flow"].iloc[-1]
    told = {k: int(flow[c]) for k, c in (("complete_pair_eligible_members", "starting_n"), ("excluded_nonprimary_members", "excluded_n"), ("included_members", "retained_n"))}
    selection = pd.concat([tables["lasso_mean_selection"], tables["lasso_domain_selection"]], ignore_index=True)
    compared, fits, terms = tables["base_model_comparison_summary"], tables["locked_model_fit_statistics"], tables["locked_model_coefficients_hc3"]
    # each of these must be the only value of its column
    columns = {
        "cv_folds": (compared, "cv_folds"), "cv_repeats": (compared, "cv_repeats"), "stability_resamples": (selection, "n_resamples"),
        "stability_subsample_fraction": (selection, "subsample_fraction"), "stability_selection_threshold": (selection, "selection_threshold"),
        "lasso_fold_plan_id": (selection, "fold_plan_id"), "locked_covariance_estimator": (terms, "covariance_estimator"),
        "reference_member_type": (fits, "reference_member_type"), "winning_base_model": (fits, "winning_base_model"),
        "locked_inference_status": (terms, "inference_status"),
    }
    problems += [f"{k} is {metadata[k]!r}, {c} of the tables {sorted(set(t[c]))!r}" for k, (t, c) in columns.items() if set(t[c]) != {metadata[k]}]
    problems += [f"{k} does not agree with the cohort flow" for k, v in told.items() if metadata[k] != v]
    if set(compared[compared["is_winner"].astype(bool)]["model_id"]) != {metadata["winning_base_model"]}:
        problems.append("the winner is not the comparison's")
    if set(compared["fold_plan_id"]) != {f"seed {metadata['seed']}"} or metadata["lasso_fold_plan_id"] != f"seed {metadata['seed'] + 1000 if isinstance(metadata['seed'], int) else ''}":
        problems.append("the fold plans are not the seed's")
    if not set(selection["selected_lambda_ratio"]) <= set(ratios):
        problems.append("a selected ratio is none of lambda_ratios")
    if metadata["output_files"] != sorted([*(f"{n}.csv" for n in tables), *(f"{n}.svg" for n in FIGURES), "metadata.json"]):
        problems.append("output_files are not the tables, figures and metadata")
    if metadata["responder_threshold_percentage"] != RESPONDER:
        problems.append(f"responder_threshold_percentage must be {RESPONDER}")
    counts = metadata["source_row_counts"]
    if not isinstance(counts, dict) or set(counts) != {"body_weights", "demographics", "engagement", "module_completions"} or any(type(v) is not int or v < 0 for v in counts.values()):
        problems.append("source_row_counts must be the four sources' whole numbers")
    elif counts["demographics"] < told["included_members"]:
        problems.append("there are fewer members in the sources than in the cohort")
    if rows is not None and dict(rows) != metadata["source_row_counts"]:
        problems.append("the row counts are not the sources'")
    if problems:
        raise ValueError(f"metadata: {'; '.join(problems)}")


def check_selection(table: pd.DataFrame, candidates: Sequence[str], tolerance: float = 1e-12) -> None:
    """Fail unless a selection table is whole: counts, frequencies and flags agree, order is canonical, the specification's values are one."""
    problems = []
    if list(table["candidate"]) != list(candidates) or list(table["candidate_order"]) != list(range(1, len(candidates) + 1)):
        problems.append("candidates are not in canonical order")
    if ((table["selection_count"] / table["n_resamples"] - table["selection_frequency"]).abs() > tolerance).any():
        problems.append("a frequency is not its count by the resamples")
    if (table["selected_at_threshold"] != (table["selection_frequency"] >= table["selection_threshold"])).any():
        problems.append("a threshold flag is wrong")
    one = ("module_spec", "selected_lambda_ratio", "cv_mean_mse", "n_resamples", "selection_threshold", "fold_plan_id", "is_winning_specification")
    problems += [f"{c} differs within the specification" for c in one if table[c].nunique(dropna=False) != 1]
    if (table["locked_model_status"] == "locked").any() and not table["is_winning_specification"].all():
        problems.append("a candidate of the other specification is locked")
    if problems:
        raise ValueError("; ".join(problems))


def member_consistency(members: DataFrame, features: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: members of one table only, members of another type, event counts of no member, and repeated pairs of member and type.

    Everything is 0 where cohort, features and event counts belong together.
    """
    both = members.select("member_id", F.col("member_type").alias("a"), F.lit(True).alias("in_members")).join(
        features.select("member_id", F.col("member_type").alias("b"), F.lit(True).alias("in_features")), "member_id", "full_outer"
    )
    sides = both.agg(
        F.count_if(F.col("in_features").isNull()).alias("only_in_members"),
        F.count_if(F.col("in_members").isNull()).alias("only_in_features"),
        F.count_if(F.col("in_members") & F.col("in_features") & ~F.col("a").eqNullSafe(F.col("b"))).alias("type_differs"),
    )
    strangers = counts.join(members.select("member_id"), "member_id", "left_anti").agg(F.count(F.lit(1)).alias("counts_of_no_member"))
    pairs = counts.groupBy("member_id", "event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_pairs"))
    return sides.join(strangers).join(pairs)  # one row each


def coefficients_json(fit: Gls | Ols) -> str:
    """A fit's coefficients by name, in order, as compact JSON."""
    if isinstance(fit, Gls):
        own = [*zip(("intercept", *fit.names), fit.beta), *zip(("time", *(f"time:{n}" for n in fit.change_names)), fit.delta)]
    else:
        own = list(zip(fit.terms, fit.coefficients))
    return json.dumps({k: float(v) for k, v in own}, separators=(",", ":"))


def model_summary(fits: Mapping[str, Gls | Ols]) -> pd.DataFrame:
    """A row a base model; what a model does not have is missing."""
    rows = []
    for name, fit in fits.items():
        own = dict(model_id=name, n_members=fit.n, deviance=float(fit.deviance), coefficients=coefficients_json(fit))
        if isinstance(fit, Gls):
            own |= dict(
                outcome_scale=fit.scale_name, covariance_structure=fit.structure, parameters=fit.parameters,
                log_likelihood=float(fit.raw_log_likelihood), aic=float(fit.aic), bic=float(fit.bic), v00=fit.v00, v01=fit.v01, v11=fit.v11
            )
        else:
            own |= dict(
                outcome_scale="percentage_loss", parameters=fit.k + 1, aic=float(fit.aic()), bic=float(fit.bic()),
                r_squared=float(fit.r_squared), adjusted_r_squared=float(fit.adjusted_r_squared), rmse=math.sqrt(fit.rss / fit.n)
            )
        rows.append(own)
    names = (
        "model_id", "outcome_scale", "covariance_structure", "n_members", "parameters", "log_likelihood", "deviance", "aic", "bic",
        "r_squared", "adjusted_r_squared", "rmse", "v00", "v01", "v11", "coefficients"
    )
    return pd.DataFrame(rows, columns=list(names))
