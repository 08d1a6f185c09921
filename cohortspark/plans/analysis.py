"""The whole analysis: cohort, features, models, the locked model and the published tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import aggregate_with_quantiles
from ..functions.stats import adjust_p, equal_count_bins
from ..operators import cohort as c
from ..operators import describe as d
from ..operators import features as f
from ..operators.cohort import Rules
from ..operators.quality import require_keys
from ..sources.extracts import Study
from . import lasso as ls
from .association import activity_associations
from .contract import LABELS, check_metadata, check_selection, model_summary
from .evidence import registers
from .figures import FIGURES
from .longitudinal import exploratory_records
from .models import Contrasts, Gls, Ols, coefficient_table, fit_gls, fit_ols
from .moments import Scale, tall_qr
from .resample import GLS_MODEL, OLS_MODEL, base_model_cv, winner
from .schemas import SCHEMAS

ENGAGEMENT = ("engagement_volume_repeatable", "engagement_volume_repeatable_rate", "engagement_breadth", "tenure_days")


@dataclass(frozen=True)
class Config:
    """Seeds and sizes of the resampling; checked before any job runs."""

    seed: int = 20260901
    cv_folds: int = 5
    cv_repeats: int = 2
    lambda_ratios: tuple[float, ...] = ls.RATIOS
    resamples: int = 100
    fraction: float = 0.7
    threshold: float = 0.75
    selection_rule: str = "one_standard_error"

    def __post_init__(self) -> None:
        if self.cv_folds < 2 or self.cv_repeats < 1 or self.resamples < 1:
            raise ValueError("cv_folds must be 2 or more, cv_repeats and resamples 1 or more")
        if not 0 < self.fraction <= 1 or not 0 < self.threshold <= 1:
            raise ValueError("fraction and threshold must lie in (0, 1]")
        if not self.lambda_ratios or any(not 0 <= r <= 1 for r in self.lambda_ratios):
            raise ValueError("lambda ratios must lie between 0 and 1")


@dataclass(frozen=True)
class Specification:
    """One candidate family's tuning, full fit and stability."""

    name: str
    candidates: tuple[str, ...]
    tuning: ls.Tuning
    fit: ls.Lasso
    counts: dict[str, int]
    n_resamples: int

    def frequency(self, candidate: str) -> float:
        return 0.0 if candidate in self.fit.excluded else self.counts[candidate] / self.n_resamples

    @property
    def score(self) -> float:
        return float(self.tuning.mean[self.tuning.best])


@dataclass(frozen=True)
class Analysis:
    config: Config
    rules: Rules
    features: DataFrame
    base_fits: dict[str, Gls | Ols]
    winner: str
    specifications: dict[str, Specification]
    winning_specification: str
    locked: tuple[str, ...]
    tables: dict[str, pd.DataFrame]
    metadata: dict = field(default_factory=dict)
    models: pd.DataFrame | None = None
    longitudinal: pd.DataFrame | None = None


def candidates_of(kind: str, rules: Rules, sexes: Sequence[str]) -> tuple[str, ...]:
    modules = ("module_mean",) if kind == "mean" else tuple(f"module_{n}" for n, _, _ in rules.module_domains)
    return (*ENGAGEMENT, *modules, *sexes)


def specify(kind: str, df: DataFrame, folds: DataFrame, base: Sequence[str], sexes: Sequence[str], rules: Rules, config: Config, seed: int) -> Specification:
    names = candidates_of(kind, rules, sexes)
    own = [*base, *names, "percentage_loss"]
    scale = Scale.of(df.dropna(subset=own), own)
    tuning = ls.tune(df, folds, "percentage_loss", base, names, ratios=config.lambda_ratios, rule=config.selection_rule, scale=scale)
    fit = ls.fit_lasso(df, "percentage_loss", base, names, tuning.ratio, scale=scale)
    samples = ls.subsamples(df, "member_id", "member_type", fraction=config.fraction, n=config.resamples, seed=seed)
    counts, n = ls.stability(df, samples, "percentage_loss", base, names, tuning.ratio, scale=scale)
    return Specification(kind, names, tuning, fit, counts, n)


def choose_specification(mean: Specification, domains: Specification) -> str:
    """The mean specification unless the domains' score is smaller by more than 1e-12."""
    return "mean" if mean.score <= domains.score + 1e-12 else "domains"


def canonical(candidate: str) -> bool:
    """Of the contrasts of sex only that of MALE is eligible for the locked model."""
    return not candidate.startswith("sex[") or candidate == "sex[MALE]"


def locked_candidates(spec: Specification, threshold: float) -> tuple[str, ...]:
    """The winning specification's candidates that reach the threshold, in order; those that are not canonical are reported, but not locked."""
    return tuple(n for n in spec.candidates if canonical(n) and spec.frequency(n) >= threshold)


def common_support(df: DataFrame, column: str) -> DataFrame:
    """Rows between the larger of the types' minima and the smaller of their maxima."""
    ends = df.groupBy("member_type").agg(F.min(column).alias("lo"), F.max(column).alias("hi")).agg(F.max("lo"), F.min("hi")).first()
    return df.where(F.col(column).between(ends[0], ends[1]))


def condition_number(df: DataFrame, names: Sequence[str]) -> float:
    """Of the design with an intercept and standardised columns."""
    scale = Scale.of(df, names)
    s = np.linalg.svd(tall_qr(df, [F.lit(1.0), *[scale.apply(n) for n in names]]), compute_uv=False)
    return float(s[0] / s[-1]) if s[-1] else math.inf


def locked_model(df: DataFrame, model_id: str, names: Sequence[str], locked: Sequence[str], meta: dict) -> tuple[list[dict], dict, list[dict]]:
    """Coefficient rows, the fit row and diagnostic rows of one HC3 model."""
    fit = fit_ols(df, "percentage_loss", names)
    rows = [
        dict(
            model_id=model_id, term_order=k, term=x.term, term_label=x.term.replace("_", " "),
            term_role="selected" if x.term in locked else "base", estimate=x.estimate, standard_error=x.standard_error,
            test_statistic=x.statistic, reference_distribution="normal", p_value=x.p_value, ci_lower=x.ci_lower, ci_upper=x.ci_upper,
            ci_level=0.95, n_members=fit.n, covariance_estimator="HC3", selection_frequency=meta["frequency"].get(x.term),
            selection_provenance="stability selection" if x.term in locked else "always included",
            inference_status=LABELS["locked_inference_status"], **meta["ids"]
        )
        for k, x in enumerate(coefficient_table(fit, fit.hc3(df)), start=1)
    ]
    points = fit.with_diagnostics(df)
    top = points.agg(F.max("leverage"), F.max("cooks_distance"), F.max(F.abs("standardized_residual"))).first()
    cond = condition_number(df, names)
    fit_row = dict(
        model_id=model_id, analysis_population="primary complete pairs", modeled_outcome="percentage_loss",
        model_formula="percentage_loss ~ " + " + ".join(names), n_members=fit.n, n_parameters=fit.k,
        residual_degrees_of_freedom=fit.n - fit.k, covariance_estimator="HC3", r_squared=fit.r_squared,
        adjusted_r_squared=fit.adjusted_r_squared, residual_rmse=math.sqrt(fit.rss / fit.n), negative_two_log_likelihood=fit.deviance,
        aic=fit.aic(0), bic=fit.bic(0), likelihood_use="descriptive", standardized_design_condition_number=cond, maximum_leverage=top[0],
        maximum_cooks_distance=top[1], selection_rule=f"frequency >= {meta['threshold']}", inference_status=LABELS["locked_inference_status"],
        fit_status="estimated", **meta["ids"]
    )
    diagnostics = [*binned(points, model_id, "residuals_vs_fitted", "fitted_value", "residual", "mean_residual"), *quantile_pairs(points, model_id, fit.n)]
    for kind, metric, value, limit in (
        ("leverage", "maximum_leverage", top[0], 2 * fit.k / fit.n), ("cooks_distance", "maximum_cooks_distance", top[1], 4 / fit.n),
        ("global_metric", "maximum_absolute_standardized_residual", top[2], 2.0),
        ("global_metric", "standardized_condition_number", cond, 30.0)
    ):
        diagnostics.append(dict(
            model_id=model_id, diagnostic_type=kind, row_type="summary", series="summary_metric", bin_count=fit.n, metric=metric,
            value=value, threshold=limit, flag=bool(value > limit), status="review" if value > limit else "within_threshold"
        ))
    diagnostics += binned(points, model_id, "leverage", "leverage", "standardized_residual", "mean_standardized_residual")
    diagnostics += binned(points, model_id, "cooks_distance", "leverage", "cooks_distance", "mean_cooks_distance")
    for k, row in enumerate(diagnostics, start=1):
        row["diagnostic_order"] = k
    return rows, fit_row, diagnostics


def binned(points: DataFrame, model_id: str, kind: str, x: str, y: str, metric: str) -> list[dict]:
    bins = equal_count_bins(points, x, "member_id")
    got = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("x"), F.avg(y).alias("y")).orderBy("bin").collect()
    return [dict(
        model_id=model_id, diagnostic_type=kind, row_type="plot_summary", series="binned_mean", bin_order=r["bin"],
        bin_method="stable_equal_count", bin_lower=r["lo"], bin_upper=r["hi"], bin_count=r["n"], x_value=r["x"], y_value=r["y"],
        metric=metric, value=r["y"], flag=False, status="descriptive"
    ) for r in got]


def quantile_pairs(points: DataFrame, model_id: str, n: int) -> list[dict]:
    k = min(9, n)
    at = [(i + 0.5) / k for i in range(k)]
    got = aggregate_with_quantiles(points, [], "standardized_residual", at).first()["q"]
    return [
        dict(
            model_id=model_id, diagnostic_type="normal_qq", row_type="plot_summary", series="quantile_pair", bin_order=i,
            bin_method="fixed_probability_quantiles", bin_lower=p, bin_upper=p, bin_count=n, x_value=NormalDist().inv_cdf(p), y_value=v,
            metric="standardized_residual_quantile", value=v, flag=False, status="descriptive"
        ) for i,
        (p, v) in enumerate(zip(at, got), start=1)
    ]


def run_analysis(study: Study, rules: Rules | None = None, config: Config | None = None, actionability: dict[str, str] = d.ACTIONABILITY) -> Analysis:
    """Run everything; fails if the percentage-loss model does not win the comparison, as only that can be locked.

    ``actionability`` classes every event type, and no other: a type without a
    class, a missing one or a class without its type fails the run.
    """
    kept: list[DataFrame] = []
    try:
        return _run(study, rules or Rules(), config or Config(), actionability, kept)
    finally:
        for df in kept:
            df.unpersist()


def _run(study: Study, rules: Rules, config: Config, actionability: dict[str, str], kept: list[DataFrame]) -> Analysis:
    """:func:`run_analysis`; what is kept in memory meanwhile is put into ``kept``."""

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return df

    require_keys(study.demographics, "member_id", "demographics")
    require_keys(study.weights, "member_id", "weights")
    members = keep(c.members(study, rules))
    pairs = keep(f.event_pairs(study.engagement, members))
    types = keep(f.classify_pairs(pairs, rules))
    wide = f.member_features(study.engagement, study.modules, members, rules, pairs)
    wide = Contrasts("member_type", (rules.treated, rules.reference), rules.reference).apply(wide, ["treated"])
    sexes: list[str] = []
    if not wide.where("sex is not null").isEmpty():
        sex = Contrasts.of(wide, "sex", preferred="FEMALE")
        sexes, wide = list(sex.names), sex.apply(wide)
    wide = keep(wide)
    base = ["first_weight", "treated"]
    fits = {
        "raw_unstructured": fit_gls(wide, ["treated"], structure="unstructured"),
        "log_compound_symmetry": fit_gls(wide, ["treated"], scale_name="log", structure="compound_symmetry"),
        "log_compound_symmetry_by_type": fit_gls(wide, ["treated"], scale_name="log", structure="compound_symmetry", interaction=True),
        OLS_MODEL: fit_ols(wide, "percentage_loss", base),
    }
    cv = base_model_cv(wide, ["treated"], folds=config.cv_folds, repeats=config.cv_repeats, seed=config.seed)
    cv = keep(cv)
    best = winner(cv)
    folds = ls.assign_folds(wide, "member_id", "member_type", folds=config.cv_folds, repeats=config.cv_repeats, seed=config.seed + 1000)
    folds = keep(folds)
    specs = {k: specify(k, wide, folds, base, sexes, rules, config, config.seed + s) for k, s in (("mean", 11000), ("domains", 12000))}
    if len({x.n for x in fits.values()}) != 1:
        raise ValueError("the base models have different members: a value is missing in some")
    chosen = choose_specification(specs["mean"], specs["domains"])
    if best != OLS_MODEL:
        raise ValueError(f"{best} won the comparison; only {OLS_MODEL} can be locked")
    locked = locked_candidates(specs[chosen], config.threshold)
    tables = build_tables(study, rules, config, members, pairs, types, wide, cv, best, specs, chosen, locked, base, actionability)
    for k, kind in (("lasso_mean_selection", "mean"), ("lasso_domain_selection", "domains")):
        check_selection(tables[k], specs[kind].candidates)
    flow = tables["cohort_flow"].iloc[-1]
    metadata = dict(
        seed=config.seed,
        cv_folds=config.cv_folds,
        cv_repeats=config.cv_repeats,
        stability_resamples=config.resamples,
        lambda_ratios=list(config.lambda_ratios),
        stability_subsample_fraction=config.fraction,
        stability_selection_threshold=config.threshold,
        complete_pair_eligible_members=int(flow["starting_n"]),
        excluded_nonprimary_members=int(flow["excluded_n"]),
        included_members=int(flow["retained_n"]),
        reference_member_type=rules.reference,
        responder_threshold_percentage=float(rules.success_percent),
        source_row_counts=source_rows(study),
        winning_base_model=best,
        lasso_fold_plan_id=tables["lasso_mean_selection"]["fold_plan_id"].iloc[0],
        **LABELS,
        output_files=sorted([*(f"{n}.csv" for n in tables), *(f"{n}.svg" for n in FIGURES), "metadata.json"]),
    )
    check_metadata(metadata, tables)
    longitudinal = exploratory_records(wide, fits["log_compound_symmetry"], specs["mean"].candidates)
    return Analysis(config, rules, wide, fits, best, specs, chosen, locked, tables, metadata, model_summary(fits), pd.DataFrame(longitudinal))


def source_rows(study: Study) -> dict[str, int]:
    return {"body_weights": study.weights.count(), "demographics": study.demographics.count(), "engagement": study.engagement.count(), "module_completions": study.modules.count()}


def closed(name: str, rows: pd.DataFrame | list[dict]) -> pd.DataFrame:
    """The rows under the table's schema; a column it does not have is an error, one that is not given is empty."""
    df = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows)
    extra = set(df.columns) - set(SCHEMAS[name])
    if extra:
        raise ValueError(f"{name}: no such columns: {sorted(extra)}")
    return df.reindex(columns=list(SCHEMAS[name]))


def small(df: DataFrame, *order: str) -> pd.DataFrame:
    """A report-sized result, sorted."""
    return df.orderBy(*order).toPandas()


def build_tables(
    study: Study, rules: Rules, config: Config, members: DataFrame, pairs: DataFrame, types: DataFrame, wide: DataFrame, cv: DataFrame, best: str,
    specs: dict[str, Specification], chosen: str, locked: Sequence[str], base: Sequence[str], actionability: dict[str, str]
) -> dict[str, pd.DataFrame]:
    out: dict[str, pd.DataFrame] = {}
    flow = small(c.cohort_flow(study, rules), "flow_order").assign(row_type="stage", notes="")
    out["cohort_flow"] = closed(
        "cohort_flow",
        flow.assign(stage_label=flow["stage_id"].str.replace("_", " "), exclusion_definition=["", *[f"excluded first at: {s.replace('_', ' ')}" for s in c.STAGES]])
    )
    levels = small(d.levels(members, rules), "scope_order", "characteristic_order", "level").assign(
        summary_type="categorical", unit="", notes="percent of observed; Missing in percent of all"
    )
    levels["level_order"] = levels.groupby(["scope_order", "characteristic_order"]).cumcount() + 1
    out["sample_characteristics"] = closed("sample_characteristics", levels.assign(characteristic_label=levels["characteristic"].str.replace("_", " ")))
    outcomes = small(d.outcomes(members, rules), "scope_order", "outcome_order")
    binary = outcomes["outcome"] == "weight_loss_success"
    out["outcomes_by_member_type"] = closed(
        "outcomes_by_member_type",
        outcomes.assign(
            outcome_label=outcomes["outcome"].str.replace("_", " "), outcome_type=np.where(binary, "binary", "continuous"), unit="",
            ci_level=np.where(binary, 0.95, np.nan), ci_method=np.where(binary, "wilson", "")
        )
    )
    eng = small(d.engagement(wide, rules), "scope_order", "metric_order")
    out["engagement_by_member_type"] = closed(
        "engagement_by_member_type",
        eng.assign(
            metric_label=eng["metric"].str.replace("_", " "), unit="", exposure_window_definition="events up to the last weight",
            denominator_definition=np.where(eng["metric"].str.contains("rate"), f"at least {rules.floor_days:g} days", "")
        )
    )
    counts = f.event_counts(study.engagement, members, rules, pairs)
    with_treated = wide.select("member_id", "percentage_loss", "first_weight", "treated", "weight_days")
    classed = d.classify_strictly(types, actionability)
    acts = d.activities(counts, members.count(), types).join(classed.select("event_type", "actionability_class"), "event_type").toPandas()
    tests = adjust_p(activity_associations(with_treated, counts, types, ["treated"]), "p_value").toPandas().drop(columns="n_reached")
    acts = acts.merge(tests, on="event_type").sort_values("event_type", ignore_index=True)
    acts = acts.assign(
        event_order=acts.index + 1, predictor="event count", predictor_transform="standardised log1p",
        effect_unit="percentage points per SD", reference_distribution="normal", ci_level=0.95, fdr_method="benjamini_hochberg",
        fdr_family="event types tested", fdr_test_count=int((acts["test_status"] == "tested").sum()), covariance_estimator="HC3",
        adjustment_terms="first_weight, member_type, weight_days, weight_days squared", reference_member_type=rules.reference,
        interpretation="association, not an effect"
    )
    out["engagement_activity_summary"] = closed("engagement_activity_summary", acts)
    mods = small(d.modules(wide, rules), "scope_order", "module_order")
    out["modules_by_member_type"] = closed(
        "modules_by_member_type",
        mods.assign(
            module_label=mods["module_variable"].str.replace("_", " "),
            module_group=np.where(mods["module_variable"] == "module_core", "core", "extension"),
            completion_definition="distinct titles up to the last weight",
            availability_status=np.where(mods["zero_completion_group_flag"], "no completion observed", "observed"),
            support_scope=np.where(mods["zero_completion_group_flag"], "not verifiable in this scope", "observed in this scope"),
            cross_group_comparability=np.where(mods["zero_completion_group_flag"], "not comparable", "comparable"),
            interpretation="descriptive"
        )
    )
    scores = cv.toPandas()
    out["base_model_comparison_summary"] = closed("base_model_comparison_summary", comparison_rows(scores, best, config))
    for k, kind in enumerate(("mean", "domains"), start=1):
        name = f"lasso_{'mean' if kind == 'mean' else 'domain'}_selection"
        out[name] = closed(name, selection_rows(specs[kind], k, kind == chosen, locked, config))
    meta = dict(frequency={n: specs[chosen].frequency(n) for n in locked}, threshold=config.threshold, ids=dict(winning_base_model=best, winning_module_spec=chosen))
    names = [*base, *locked]
    complete = wide.dropna(subset=names)
    support = common_support(complete, "weight_days")
    mean_days = support.agg(F.avg("weight_days")).first()[0] or 0.0
    support = support.withColumn("days_centred", F.col("weight_days") - F.lit(mean_days)).withColumn("days_centred_squared", F.col("days_centred") ** 2)
    models = [
        locked_model(complete, "locked_primary", names, locked, meta),
        locked_model(support, "duration_sensitivity", [*base, "days_centred", "days_centred_squared", *locked], locked, meta)
    ]
    out["locked_model_coefficients_hc3"] = closed("locked_model_coefficients_hc3", [r for m in models for r in m[0]])
    out["locked_model_fit_statistics"] = closed(
        "locked_model_fit_statistics",
        [dict(m[1], reference_member_type=rules.reference, duration_adjustment=a) for m, a in zip(models, ("none", "centred linear and quadratic"))]
    )
    out["model_diagnostics"] = closed("model_diagnostics", [r for m in models for r in m[2]])
    out |= {name: closed(name, rows) for name, rows in registers(out).items()}
    return {name: out[name] for name in SCHEMAS}


def comparison_rows(scores: pd.DataFrame, best: str, config: Config) -> list[dict]:
    rows = []
    for k, (model, family) in enumerate(((GLS_MODEL, "two-occasion GLS"), (OLS_MODEL, "least squares")), start=1):
        own = scores[scores["model"] == model]
        for j, metric in enumerate(("rmse", "mae"), start=1):
            v = own[metric]
            rows.append(dict(
                model_order=k, model_id=model, model_family=family, modeled_outcome="log weights" if k == 1 else "percentage_loss",
                prediction_target="last_weight", metric_order=j, metric=metric, metric_unit="weight",
                n_members=int(own.groupby("repeat")["n_test"].sum().iloc[0]), cv_repeats=config.cv_repeats, cv_folds=config.cv_folds,
                n_fold_scores=len(own), n_test_predictions=int(own["n_test"].sum()), mean_score=v.mean(), standard_deviation=v.std(ddof=1),
                minimum_score=v.min(), maximum_score=v.max(), fold_plan_id=f"seed {config.seed}",
                score_aggregation="unweighted mean over folds", rank=1 if model == best else 2, is_winner=model == best,
                winner_rule="rmse, then mae, then least squares", tie_tolerance=0.0, validation_scope="internal"
            ))
    return rows


def selection_rows(spec: Specification, order: int, wins: bool, locked: Sequence[str], config: Config) -> list[dict]:
    rows = []
    for k, name in enumerate(spec.candidates):
        out, frequency = name in spec.fit.excluded, spec.frequency(name)
        reached = frequency >= config.threshold
        status = "ineligible_noncanonical_candidate" if not canonical(name) else "locked" if wins and name in locked else "inestimable_full_fit" if out else "nonwinning_specification" if not wins else "below_stability_threshold"
        rows.append(dict(
            specification_order=order, module_spec=spec.name, is_winning_specification=wins, candidate_order=k + 1, candidate=name,
            candidate_label=name.replace("_", " "),
            candidate_role="module" if name.startswith("module") else "demographic" if name.startswith("sex") else "engagement",
            reference_level="FEMALE" if name.startswith("sex") else "", penalty_status="penalised", selected_lambda_ratio=spec.tuning.ratio,
            full_sample_lambda=spec.fit.lam, full_sample_lambda_max=spec.fit.lam_max, cv_selection_rule=config.selection_rule,
            cv_mean_mse=spec.score, cv_standard_error=float(spec.tuning.error[spec.tuning.best]), fold_plan_id=f"seed {config.seed + 1000}",
            n_resamples=spec.n_resamples, subsample_fraction=config.fraction, selection_threshold=config.threshold,
            full_sample_coefficient=float(spec.fit.coefficients[k]), full_sample_standardized_coefficient=float(spec.fit.theta[k]),
            selection_count=0 if out else spec.counts[name], selection_frequency=frequency, selected_at_threshold=reached,
            eligible_for_locked_model=wins and reached and not out, locked_model_status=status,
            exclusion_reason="constant or within the base" if out else "", coefficient_unit="percentage points",
            interpretation="selection is not inference"
        ))
    return rows
