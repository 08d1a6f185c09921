"""Registers of hypotheses, findings and limitations, judged by rules on a run's own tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd

Tables = Mapping[str, pd.DataFrame]

#: Adjusted p values below this speak for an activity.
LEVEL = 0.05


@dataclass(frozen=True)
class Verdict:
    """What the tables say about one hypothesis: its status, and the numbers and rows that it rests on."""

    status: str
    effect: str
    uncertainty: str
    table: str
    where: str


def interval(low: float, high: float) -> str:
    """Of an interval: whether it lies above zero, below it, or holds it."""
    if pd.isna(low) or pd.isna(high):
        return "not_estimable"
    return "supported" if low > 0 else "contrary" if high < 0 else "inconclusive"


def term(t: Tables, model: str, name: str) -> pd.Series | None:
    k = t["locked_model_coefficients_hc3"]
    own = k[(k["model_id"] == model) & (k["term"] == name)]
    return own.iloc[0] if len(own) else None


def _effect(row: pd.Series) -> tuple[str, str]:
    return f"{row['estimate']:.3f}", f"95 % CI {row['ci_lower']:.3f} to {row['ci_upper']:.3f}"


def treatment_loss(t: Tables) -> Verdict:
    """The sign of the treated contrast's interval in the locked model."""
    where, row = "model_id = locked_primary; term = treated", term(t, "locked_primary", "treated")
    if row is None:
        return Verdict("not_estimable", "", "", "locked_model_coefficients_hc3", where)
    return Verdict(interval(row["ci_lower"], row["ci_upper"]), *_effect(row), "locked_model_coefficients_hc3", where)


def treatment_response(t: Tables) -> Verdict:
    """Whether the types' score intervals of the success rate lie apart."""
    o = t["outcomes_by_member_type"]
    own = o[(o["outcome"] == "weight_loss_success") & (o["scope_order"] > 1)].sort_values("scope_order")
    where = "outcome = weight_loss_success; scope_order > 1"
    if len(own) < 2 or own[["ci_lower", "ci_upper"]].isna().any().any():
        return Verdict("not_estimable", "", "", "outcomes_by_member_type", where)
    treated, other = own.iloc[0], own.iloc[1]
    status = "supported" if treated["ci_lower"] > other["ci_upper"] else "contrary" if treated["ci_upper"] < other["ci_lower"] else "inconclusive"
    effect = "; ".join(f"{r.scope}: {r.percentage:.2f} %" for r in own.itertuples())
    spread = "; ".join(f"{r.scope}: {r.ci_lower:.2f} to {r.ci_upper:.2f} %" for r in own.itertuples())
    return Verdict(status, effect, spread, "outcomes_by_member_type", where)


def _selected(t: Tables, role: str) -> Verdict:
    s = pd.concat([t["lasso_mean_selection"], t["lasso_domain_selection"]], ignore_index=True)
    own = s[s["is_winning_specification"].astype(bool) & (s["candidate_role"] == role)]
    where = f"is_winning_specification; candidate_role = {role}"
    table = "lasso_mean_selection, lasso_domain_selection"
    if own.empty or (own["locked_model_status"] == "inestimable_full_fit").all():
        return Verdict("not_estimable", "", "", table, where)
    locked = own[own["locked_model_status"] == "locked"]["candidate"]
    rows = [r for r in (term(t, "locked_primary", n) for n in locked) if r is not None]
    frequency = "; ".join(f"{r.candidate}: selected in {r.selection_frequency:.2f}" for r in own.itertuples())
    if not rows:
        return Verdict("not_selected", "no term reaches the threshold", frequency, table, where)
    signs = {interval(r["ci_lower"], r["ci_upper"]) for r in rows}
    status = "mixed" if {"supported", "contrary"} <= signs else "supported" if "supported" in signs else "contrary" if "contrary" in signs else "inconclusive"
    return Verdict(status, "; ".join(f"{r['term']}: {_effect(r)[0]}" for r in rows), "; ".join(f"{r['term']}: {_effect(r)[1]}" for r in rows) + "; " + frequency, table, where)


def engagement(t: Tables) -> Verdict:
    """The winning specification's engagement terms that are locked, by the signs of their intervals."""
    return _selected(t, "engagement")


def modules(t: Tables) -> Verdict:
    """As for engagement; where a type completed no module at all, the types can't be compared."""
    m, own = t["modules_by_member_type"], _selected(t, "module")
    none = m[m["zero_completion_group_flag"].astype(bool) & (m["scope_order"] > 1)]
    if none.empty:
        return own
    text = "; ".join(f"{r.scope}: no {r.module_variable}" for r in none.itertuples())
    return Verdict("not_comparable", own.effect, text, "modules_by_member_type", "zero_completion_group_flag; scope_order > 1")


def activities(t: Tables) -> Verdict:
    """Whether a tested activity's adjusted p value is below the level."""
    a = t["engagement_activity_summary"]
    tested = a[a["test_status"] == "tested"]
    where = f"test_status = tested; fdr_adjusted_p_value < {LEVEL}"
    if tested.empty:
        return Verdict("not_tested", "", "", "engagement_activity_summary", where)
    below = tested[tested["fdr_adjusted_p_value"] < LEVEL]
    effect = "; ".join(f"{r.event_type}: {r.estimate:.3f}" for r in below.itertuples()) or "no activity"
    least = f"{len(below)} of {len(tested)} tests; least adjusted p value {tested['fdr_adjusted_p_value'].min():.3f}"
    return Verdict("supported" if len(below) else "inconclusive", effect, least, "engagement_activity_summary", where)


def duration(t: Tables) -> Verdict:
    """Whether the treated contrast says the same with the days between weights adjusted for, on common support."""
    where = "model_id in (locked_primary, duration_sensitivity); term = treated"
    rows = [term(t, m, "treated") for m in ("locked_primary", "duration_sensitivity")]
    if any(r is None for r in rows):
        return Verdict("not_estimable", "", "", "locked_model_coefficients_hc3", where)
    said = [interval(r["ci_lower"], r["ci_upper"]) for r in rows]
    status = "not_estimable" if "not_estimable" in said else "robust" if said[0] == said[1] and (rows[0]["estimate"] > 0) == (rows[1]["estimate"] > 0) else "sensitive"
    effect = "; ".join(f"{n}: {_effect(r)[0]}" for n, r in zip(("primary", "adjusted"), rows))
    spread = "; ".join(f"{n}: {_effect(r)[1]}" for n, r in zip(("primary", "adjusted"), rows))
    return Verdict(status, effect, spread, "locked_model_coefficients_hc3", where)


@dataclass(frozen=True)
class Hypothesis:
    name: str
    question: str
    expectation: str
    estimand: str
    exposure: str
    outcome: str
    adjusted_for: str
    multiplicity: str
    inference: str
    rule: object
    kpi: str


HYPOTHESES = (
    Hypothesis("treatment_loss", "Do treated members lose more?", "treated members lose more", "difference of mean percentage loss", "member type", "percentage_loss", "first_weight, selected terms", "none", "conditional_exploratory", treatment_loss, "percentage loss"),
    Hypothesis("treatment_response", "Do more treated members respond?", "more treated members respond", "rates of success by type", "member type", "weight_loss_success", "none", "none", "descriptive", treatment_response, "rate of success"),
    Hypothesis("engagement", "Does engagement go with loss?", "more engagement goes with more loss", "slope of each locked term", "engagement", "percentage_loss", "first_weight, member type, other selected terms", "stability selection", "conditional_exploratory", engagement, "percentage loss"),
    Hypothesis("activities", "Which activities go with loss?", "some activities go with loss", "slope of each standardised log count", "event counts", "percentage_loss", "first_weight, member type, weight days and their square", "benjamini_hochberg", "exploratory", activities, "percentage loss"),
    Hypothesis("modules", "Does completing modules go with loss?", "more completions go with more loss", "slope of each locked term", "module completion", "percentage_loss", "first_weight, member type, other selected terms", "stability selection", "conditional_exploratory", modules, "percentage loss"),
    Hypothesis("duration", "Do differing durations explain the difference?", "the difference stays", "difference of mean percentage loss on common support", "member type", "percentage_loss", "first_weight, selected terms, weight days and their square", "none", "conditional_exploratory", duration, "percentage loss"),
)

#: By status: what may be said, how sure it is, and what may be done.
SAYINGS = {
    "supported": ("The data of these members agree with the expectation.", "moderate: observational", "test it in a pilot"),
    "contrary": ("The data of these members speak against the expectation.", "moderate: observational", "revise the expectation before a pilot"),
    "mixed": ("Terms of both signs are selected.", "low: observational", "name one term before a pilot"),
    "inconclusive": ("The interval holds both directions.", "low: imprecise", "plan a pilot of enough members"),
    "not_selected": ("No term is selected often enough.", "low: unstable", "no action on these terms"),
    "not_tested": ("Too few members have any such event.", "none: no test", "collect more events"),
    "not_comparable": ("A type has no completion, so that types can't be compared.", "none: no support", "offer the modules to both types"),
    "not_estimable": ("The data do not determine it.", "none: not estimable", "collect the missing data"),
    "robust": ("Adjusting for duration does not change what is said.", "moderate: observational", "keep the primary model"),
    "sensitive": ("What is said depends on the adjustment for duration.", "low: depends on the model", "fix the duration in a pilot"),
}


def registers(t: Tables) -> dict[str, list[dict]]:
    """Rows of the three registers, all judged on the tables given."""
    hypotheses, findings = [], []
    for k, h in enumerate(HYPOTHESES, start=1):
        v = h.rule(t)
        said, certainty, action = SAYINGS[v.status]
        common = dict(evidence_table=v.table, evidence_filter=v.where, causal_status="not causal")
        hypotheses.append(dict(
            hypothesis_order=k, hypothesis_id=h.name, question=h.question, prespecified_expectation=h.expectation, estimand=h.estimand,
            population="primary complete pairs", exposure_or_predictor=h.exposure, outcome=h.outcome, adjustment_set=h.adjusted_for,
            result_status=v.status, effect_summary=v.effect, uncertainty_summary=v.uncertainty, multiplicity_control=h.multiplicity,
            inference_status=h.inference, noncausal_interpretation=said, leadership_action=action,
            randomized_pilot_population="eligible members", randomized_pilot_comparator="usual care", randomized_pilot_kpi=h.kpi,
            randomized_pilot_time_horizon="the weights' usual distance", **common
        ))
        findings.append(dict(
            finding_order=k, finding_id=f"{h.name}_{v.status}", finding=f"{h.exposure} and {h.outcome}: {v.status.replace('_', ' ')}",
            quantitative_evidence="; ".join(x for x in (v.effect, v.uncertainty) if x), interpretation=said, certainty=certainty,
            leadership_implication=action, recommended_test="randomised pilot" if v.status in ("supported", "inconclusive", "robust", "sensitive") else "none yet",
            pilot_population="eligible members", pilot_intervention=h.exposure, pilot_comparator="usual care", pilot_primary_kpi=h.kpi,
            pilot_time_horizon="the weights' usual distance", **common
        ))
    return {"hypothesis_evidence": hypotheses, "findings_and_implications": findings, "limitations": limitations(t)}


def limitations(t: Tables) -> list[dict]:
    """What the design leaves open; severity is material where the tables show it, else potential."""
    o, a, m, flow = t["outcomes_by_member_type"], t["engagement_activity_summary"], t["modules_by_member_type"], t["cohort_flow"]
    days = o[(o["outcome"] == "weight_days") & (o["scope_order"] > 1)]
    zero = int(m["zero_completion_group_flag"].astype(bool).sum())
    k = t["locked_model_coefficients_hc3"]
    selected = list(k[(k["model_id"] == "locked_primary") & (k["term_role"] == "selected")]["term"])
    kept, enrolled = int(flow["retained_n"].iloc[-1]), int(flow["starting_n"].iloc[0])
    tested = int((a["test_status"] == "tested").sum())
    flagged = int(t["model_diagnostics"]["flag"].fillna(False).astype(bool).sum())
    rows = [
        ("no_randomisation", "design", "Types were not assigned at random.", "", True, "treatment effects", "confounding", "unknown", "regression on first weight", "randomised pilot"),
        ("selection", "design", "The funnel keeps complete pairs only.", f"{kept} of {enrolled} enrolled", kept < enrolled, "all", "members who stay differ", "unknown", "funnel reported", "follow all members"),
        ("duration", "design", "Follow-up differs between members.", "; ".join(f"{r.scope}: median {r.median:.0f} days" for r in days.itertuples()), days["median"].nunique() > 1, "treatment effects", "longer follow-up, other loss", "unknown", "sensitivity on common support", "fixed visits"),
        ("two_occasions", "measurement", "Two weights do not show a trajectory.", "", True, "loss", "course unknown", "unknown", "none", "more weights"),
        ("censoring", "measurement", "Activity after the last weight is not used.", "", True, "engagement", "activity undercounted", "toward zero", "one cutoff for all", "activity to a fixed day"),
        ("module_support", "support", "Some modules are not completed in a scope.", f"{zero} scopes without completions", zero > 0, "modules", "types not comparable", "unknown", "flags in the table", "modules for both types"),
        ("post_selection", "inference", "Intervals ignore the selection of terms.", f"selected: {', '.join(selected) or 'none'}", bool(selected), "locked terms", "intervals too short", "away from zero", "labels", "another sample"),
        ("multiplicity", "inference", "Many activities are tested.", f"{tested} tests", tested > 1, "activities", "false findings", "away from zero", "Benjamini-Hochberg", "another sample"),
        ("internal_validation", "inference", "Errors come from folds of one sample.", f"{flagged} diagnostics to review", flagged > 0, "predictions", "errors too small", "toward zero", "grouped folds", "another sample"),
        ("unmeasured", "design", "Age and other causes are not in the extracts.", "", True, "all", "confounding", "unknown", "none", "collect them"),
    ]
    names = ("limitation_id", "category", "limitation", "empirical_evidence", "severity", "affected_estimand", "potential_impact", "direction_of_bias", "mitigation_in_current_analysis", "recommended_future_design")
    out = []
    for k, r in enumerate(rows, start=1):
        row = dict(zip(names, r), limitation_order=k, affected_outputs="all tables" if r[5] == "all" else r[5])
        row["severity"] = "material" if row["severity"] else "potential"
        out.append(row)
    return out
