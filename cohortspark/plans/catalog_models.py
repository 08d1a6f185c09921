"""Model queries over the order study."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import adjust_p, rank_positions
from ..operators import cohort as c
from ..operators import describe as d
from ..operators import features as f
from ..sources.extracts import Study
from ..sources.views import RULES
from . import lasso as ls
from .analysis import Config, common_support, comparison_rows, condition_number, quantile_pairs
from .association import activity_associations
from .catalog import ORACLE_SQL, PREFIX, _r, features_of, query
from .contract import member_consistency, model_summary
from .longitudinal import exploratory_records, whitened
from .models import Contrasts, coefficient_table, fit_gls, fit_ols, fit_percentage_loss
from .moments import Scale, diagnose_collinearity
from .resample import base_model_cv, winner

SEED = 20260901
BASE = ["first_weight", "treated"]
MEAN = ["engagement_volume_repeatable", "engagement_volume_repeatable_rate", "engagement_breadth", "tenure_days", "module_mean"]


def cohort_of(s: Study) -> DataFrame:
    return c.members(s, RULES).withColumn("treated", F.when(F.col("member_type") == RULES.treated, 1.0).otherwise(0.0))


def wide(s: Study) -> DataFrame:
    return features_of(s).withColumn("treated", F.when(F.col("member_type") == RULES.treated, 1.0).otherwise(0.0))


@contextmanager
def once(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """``df`` (some columns of it) made once and kept: a fit reads its rows several times."""
    kept = (df.select(*columns) if columns else df).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def wide_once(s: Study, *columns: str) -> Iterator[DataFrame]:
    """``wide``, of which the cohort, the event pairs and the rows are each made once."""
    with once(cohort_of(s)) as k, once(f.event_pairs(s.engagement, k)) as pairs, once(f.member_features(s.engagement, s.modules, k, RULES, pairs), *columns) as w:
        yield w


# Closed forms: with one slope and two groups the slope is that within groups.
_OLS = """, k as (select *, case when member_type = 'MACHINERY' then 1 else 0 end as g, first_weight as x, percentage_loss as y from cohort),
means as (select g, count(*) as n, avg(x) as mx, avg(y) as my from k group by g),
slope as (select sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b, sum((x - mx) * (x - mx)) as sxx from k join means on k.g = means.g),
coefs as (select b, sxx, (select my from means where g = 0) - b * (select mx from means where g = 0) as a,
  (select my from means where g = 1) - (select my from means where g = 0) - b * ((select mx from means where g = 1) - (select mx from means where g = 0)) as t from slope),
points as (select k.*, y - (a + b * x + t * k.g) as e, 1.0::double / n + (x - mx) * (x - mx) / sxx as h, b, a, t, sxx, mx from k join means on k.g = means.g cross join coefs),
fit as (select count(*)::double as n, sum(e * e) as rss, (select sum((y - m) * (y - m)) from k, (select avg(y) as m from k) q) as tss from points)"""


def _rows(s: Study, names: list[str], rows: list[tuple], types: str) -> DataFrame:
    return s.demographics.sparkSession.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types.split())))


@query(
    "q25_percentage_loss_coefficients",
    _OLS + f" select 'first_weight' as term, {_r('b * 1000', 'estimate_x1000')} from coefs union all select 'intercept', {_r('a * 1000', 'e')} from coefs union all select 'treated', {_r('t * 1000', 'e')} from coefs"
)
def _(s: Study) -> DataFrame:
    fit = fit_ols(cohort_of(s), "percentage_loss", BASE)
    return _rows(s, ["term", "estimate_x1000"], [(t, float(v) * 1000) for t, v in zip(fit.terms, fit.coefficients)], "string double")


@query("q26_percentage_loss_fit", _OLS + """ select n::bigint as n, round(1 - rss / tss, 6) as r_squared, round(1 - (rss / (n - 3)) / (tss / (n - 1)), 6) as adjusted_r_squared, round(sqrt(rss / n), 6) as rmse,
 round(n * (ln(2 * pi() * rss / n) + 1), 6) as deviance, round(n * (ln(2 * pi() * rss / n) + 1) + 8, 6) as aic, round(n * (ln(2 * pi() * rss / n) + 1) + 4 * ln(n), 6) as bic from fit""")
def _(s: Study) -> DataFrame:
    fit = fit_ols(cohort_of(s), "percentage_loss", BASE)
    return _rows(
        s, ["n", "r_squared", "adjusted_r_squared", "rmse", "deviance", "aic", "bic"],
        [(fit.n, *map(float, (fit.r_squared, fit.adjusted_r_squared, math.sqrt(fit.rss / fit.n), fit.deviance, fit.aic(), fit.bic())))],
        "bigint double double double double double double"
    )


@query(
    "q27_percentage_loss_hc3",
    _OLS + " select round(b * 1000, 6) as slope_x1000, round(sqrt(sum(pow((x - mx) * e / (1 - h), 2))) / sxx * 1000, 6) as se_x1000 from points group by b, sxx"
)
def _(s: Study) -> DataFrame:
    k = cohort_of(s)
    fit = fit_ols(k, "percentage_loss", BASE)
    row = coefficient_table(fit, fit.hc3(k))[1]
    return _rows(s, ["slope_x1000", "se_x1000"], [(row.estimate * 1000, row.standard_error * 1000)], "double double")


# Regressions of y0, the change and the mid-point on the group, and of y0 on the group and the change.
_GLS = """, k as (select case when member_type = 'MACHINERY' then 1 else 0 end as g, ln(first_weight) as y0, ln(last_weight) - ln(first_weight) as d, ln(first_weight) + ln(last_weight) as logs from cohort),
w as (select *, y0 - avg(y0) over (partition by g) as r0, d - avg(d) over (partition by g) as rd, d - avg(d) over () as dd from k),
q as (select count(*)::double as n, sum(r0 * r0) as s00, sum(r0 * rd) as s01, sum(rd * rd) as s11, sum(dd * dd) as sd, sum(logs) as logs from w),
u as (select 'unstructured' as structure, 6 as parameters, n, logs, s01 / s11 as kappa, sd / n as vd, (s00 - s01 * s01 / s11) / n as vc from q),
m as (select *, s00 + s01 + s11 / 4 as sm from q),
a as (
  select structure, parameters, logs, n, vc + kappa * kappa * vd as v00, vc + kappa * kappa * vd + kappa * vd as v01, vc + kappa * kappa * vd + 2 * kappa * vd + vd as v11, -n / 2 * (ln(2 * pi() * vd) + ln(2 * pi() * vc) + 2) as ll from u
  union all select 'compound_symmetry', 5, logs, n, sm / n + sd / n / 4, sm / n - sd / n / 4, sm / n + sd / n / 4, -n / 2 * (ln(2 * pi() * sd / n) + ln(2 * pi() * sm / n) + 2) from m
  union all select 'iid', 4, logs, n, (2 * sm + sd / 2) / (2 * n), 0, (2 * sm + sd / 2) / (2 * n), -n * (ln(2 * pi() * (2 * sm + sd / 2) / (2 * n)) + 1) from m)"""


@query(
    "q28_two_occasion_gls",
    _GLS + " select structure, round(v00, 6) as v00, round(v01, 6) as v01, round(v11, 6) as v11, round(ll, 4) as log_likelihood, round(-2 * (ll - logs), 4) as deviance, round(-2 * (ll - logs) + 2 * parameters, 4) as aic from a"
)
def _(s: Study) -> DataFrame:
    fits = [fit_gls(cohort_of(s), ["treated"], scale_name="log", structure=x) for x in ("unstructured", "compound_symmetry", "iid")]
    names = ["structure", "v00", "v01", "v11", "log_likelihood", "deviance", "aic"]
    return _rows(s, names, [(x.structure, x.v00, x.v01, x.v11, round(x.log_likelihood, 4), round(x.deviance, 4), round(x.aic, 4)) for x in fits], "string" + " double" * 6)


# Of the diagonal structure one number is left to find: golden section, as the rows of a recursion.
_DIAGONAL = _GLS + """ select 'diagonal' as structure, round(-kappa * vd, 6) as v00, 0.0::double as v01, round((1 + kappa) * vd, 6) as v11, round(-n / 2 * (ln(2 * pi() * vd) + ln(2 * pi() * -kappa * (1 + kappa) * vd) + 2), 6) as log_likelihood
from (select kappa, n, (sd + (s00 - 2 * kappa * s01 + kappa * kappa * s11) / (-kappa * (1 + kappa))) / (2 * n) as vd from q cross join (
  with recursive golden(i, lo, hi) as (
    select 0, -1 + 1e-12::double, -1e-12::double
    union all
    select i + 1, case when ln(q1) + 2 * ln(sd + (s00 - 2 * a1 * s01 + a1 * a1 * s11) / q1) <= ln(q2) + 2 * ln(sd + (s00 - 2 * a2 * s01 + a2 * a2 * s11) / q2) then lo else a1 end,
      case when ln(q1) + 2 * ln(sd + (s00 - 2 * a1 * s01 + a1 * a1 * s11) / q1) <= ln(q2) + 2 * ln(sd + (s00 - 2 * a2 * s01 + a2 * a2 * s11) / q2) then a2 else hi end
    from (select *, -a1 * (1 + a1) as q1, -a2 * (1 + a2) as q2 from (
      select i, lo, hi, hi - (sqrt(5) - 1) / 2 * (hi - lo) as a1, lo + (sqrt(5) - 1) / 2 * (hi - lo) as a2 from golden where i < 60) x) y cross join q)
  select (lo + hi) / 2 as kappa from golden order by i desc limit 1) g) z"""


@query("q29_gls_diagonal", _DIAGONAL)
def _(s: Study) -> DataFrame:
    x = fit_gls(cohort_of(s), ["treated"], scale_name="log", structure="diagonal")
    return _rows(s, ["structure", "v00", "v01", "v11", "log_likelihood"], [(x.structure, x.v00, x.v01, x.v11, x.log_likelihood)], "string double double double double")


@query(
    "q30_predicted_last_weight",
    _OLS.replace(", first_weight as x", ", first_weight as x") + " select member_id, round(first_weight * (1 - (a + b * x + t * g) / 100), 4) as predicted_last_weight from points"
)
def _(s: Study) -> DataFrame:
    k = cohort_of(s)
    fit = fit_ols(k, "percentage_loss", BASE)
    return k.select("member_id", F.round(F.col("first_weight") * (1 - fit.fitted() / 100), 4).alias("predicted_last_weight"))


@query(
    "q31_regression_diagnostics",
    _OLS + " select count(*) as n, round(max(h), 6) as maximum_leverage, round(max(pow(e / sqrt(rss / (n - 3) * (1 - h)), 2) * h / ((1 - h) * 3)), 6) as maximum_cooks_distance, round(max(abs(e / sqrt(rss / (n - 3) * (1 - h)))), 6) as maximum_absolute_standardized_residual from points cross join fit"
)
def _(s: Study) -> DataFrame:
    k = cohort_of(s)
    fit = fit_ols(k, "percentage_loss", BASE)
    return fit.with_diagnostics(k).agg(
        F.count(F.lit(1)).alias("n"), F.max("leverage").alias("maximum_leverage"), F.max("cooks_distance").alias("maximum_cooks_distance"),
        F.max(F.abs("standardized_residual")).alias("maximum_absolute_standardized_residual")
    )


_PLACES = """, keyed as (select member_id, member_type, r::int as {r}, row_number() over (partition by r, member_type order by md5('20260901|' || r || '|' || member_id)) - 1 as place from cohort cross join range({n}) t(r)),
sizes as (select member_type, count(*) as size from cohort group by 1), starts as (select *, coalesce(sum(size) over (order by member_type rows between unbounded preceding and 1 preceding), 0) as start from sizes)"""


@query(
    "q32_stratified_folds",
    _PLACES.format(r="repeat", n=2) + " select member_id, k.member_type, repeat, ((place + start) % 5)::int as fold from keyed k join starts s on k.member_type = s.member_type"
)
def _(s: Study) -> DataFrame:
    return ls.assign_folds(cohort_of(s), "member_id", "member_type", folds=5, repeats=2, seed=SEED)


_QUOTAS = """, sized as (select member_type, count(*) as c from cohort group by 1), whole as (select round_even(0.7 * sum(c), 0) as size, sum(c) as n from sized),
ideal as (select member_type, size, size * c / n as i from sized cross join whole), floors as (select *, greatest(1, floor(i)) as q from ideal),
quotas as (select member_type, q + case when row_number() over (order by i - q desc, member_type) <= size - sum(q) over () then 1 else 0 end as quota from floors)"""


@query(
    "q33_quota_subsamples",
    _PLACES.format(r="resample", n=3) + _QUOTAS + " select member_id, k.member_type, resample from keyed k join quotas q on q.member_type = k.member_type where place < quota"
)
def _(s: Study) -> DataFrame:
    return ls.subsamples(cohort_of(s), "member_id", "member_type", fraction=0.7, n=3, seed=SEED).members(cohort_of(s))


# Both models' closed forms on each training part, and their errors on the rest.
_CV = """, plan as (select member_id, repeat, ((place + start) % 5)::int as fold from keyed k join starts s on k.member_type = s.member_type),
r as (select p.repeat, p.fold, case when member_type = 'MACHINERY' then 1 else 0 end as g, first_weight as x, percentage_loss as y, last_weight, ln(first_weight) as y0, ln(last_weight) - ln(first_weight) as d from plan p join cohort c on c.member_id = p.member_id),
tr as (select r.*, f.fold as held from r join (select distinct fold from r) f on f.fold <> r.fold),
gm as (select repeat, held, g, avg(x) as mx, avg(y) as my, avg(y0 + d / 2) as mm from tr group by all),
delta as (select repeat, held, avg(d) as delta from tr group by all),
sums as (select t.repeat, t.held, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) as b, avg((y0 + d / 2 - mm) * (y0 + d / 2 - mm)) as vm, avg((d - delta) * (d - delta)) as vd, any_value(delta) as delta
  from tr t join gm on gm.repeat = t.repeat and gm.held = t.held and gm.g = t.g join delta e on e.repeat = t.repeat and e.held = t.held group by all),
test as (select r.repeat, r.fold, last_weight, x * (1 - (my + b * (x - mx)) / 100) as ols, mm - delta / 2 as mu, vm + vd / 4 as v, vm - vd / 4 as c, delta, y0
  from r join gm on gm.repeat = r.repeat and gm.held = r.fold and gm.g = r.g join sums s on s.repeat = r.repeat and s.held = r.fold),
errors as (select repeat, fold, 'percentage_loss_ols' as model, last_weight - ols as e from test
  union all select repeat, fold, 'longitudinal_log_gls', last_weight - exp(mu + delta + c / v * (y0 - mu) + (v - c * c / v) / 2) from test),
scores as (select repeat, fold, model, count(*) as n_test, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae from errors group by all),
best as (select model from scores group by model order by avg(rmse), avg(mae), model = 'longitudinal_log_gls' limit 1)
select repeat::int as repeat, fold, model, n_test, round(rmse, 6) as rmse, round(mae, 6) as mae, model = (select model from best) as is_winner from scores"""


@query("q34_base_model_cv", _PLACES.format(r="repeat", n=2) + _CV)
def _(s: Study) -> DataFrame:
    made = base_model_cv(cohort_of(s), ["treated"], folds=5, repeats=2, seed=SEED)
    scores = made.sparkSession.createDataFrame(made.collect(), made.schema)  # a row a fold and model
    return scores.withColumn("is_winner", F.col("model") == winner(scores))


@query("q35_lasso_one_candidate", _OLS.replace("percentage_loss as y from cohort", "percentage_loss as y, engagement_breadth::double as z from features").replace("avg(y) as my from k", "avg(y) as my, avg(z) as mz from k") + """,
zs as (select sum((z - mz) * (x - mx)) / any_value(sxx) as c from k join means on k.g = means.g cross join slope),
zr as (select (z - means.mz) - c * (x - means.mx) as r, e, y from points join means on points.g = means.g cross join zs),
o as (select sum(r * e) / sum(r * r) as whole, count(*) as n from zr)
select 'engagement_breadth' as candidate, round(whole * 0.5, 6) as coefficient from o""")
def _(s: Study) -> DataFrame:
    with wide_once(s, *BASE, "engagement_breadth", "percentage_loss") as w:
        fit = ls.fit_lasso(w, "percentage_loss", BASE, ["engagement_breadth"], 0.5)
    return _rows(s, ["candidate", "coefficient"], [("engagement_breadth", float(fit.coefficients[0]))], "string double")


@query("q36_lasso_tuning_and_stability")
def _(s: Study) -> DataFrame:
    domains = [*MEAN[:-1], *[f"module_{n}" for n, _, _ in RULES.module_domains]]
    rows = []
    with wide_once(s, "member_id", "member_type", *BASE, *MEAN, *domains[len(MEAN) - 1 :], "percentage_loss") as w, once(ls.assign_folds(w, "member_id", "member_type", folds=5, repeats=2, seed=SEED + 1000)) as folds:
        for spec, names, seed in (("mean", MEAN, SEED + 11000), ("domains", domains, SEED + 12000)):
            own = [*BASE, *names, "percentage_loss"]
            scale = Scale.of(w.dropna(subset=own), own)
            tuned = ls.tune(w, folds, "percentage_loss", BASE, names, scale=scale)
            fit = ls.fit_lasso(w, "percentage_loss", BASE, names, tuned.ratio, scale=scale)
            samples = ls.subsamples(w, "member_id", "member_type", fraction=0.7, n=100, seed=seed)
            counts, n = ls.stability(w, samples, "percentage_loss", BASE, names, tuned.ratio, scale=scale)
            rows += [(spec, x, tuned.ratio, float(b), counts[x], counts[x] / n) for x, b in zip(names, fit.coefficients)]
    names = ["module_spec", "candidate", "lambda_ratio", "coefficient", "selection_count", "selection_frequency"]
    return _rows(s, names, rows, "string string double double bigint double")


def _association_fits() -> str:
    """One regression an event type by successive orthogonalisation: each regressor less what those before it explain."""
    names = ["x1", "x2", "x3", "x4", "z"]
    centred = ", ".join(f"{c} - avg({c}) over w as {c}" for c in [*names, "y"])
    sql = f"""(select event_type, n, n_reached, 1.0::double / n as h, {centred} from (
      select event_type, count(*) over w as n, count(*) filter (c > 0) over w as n_reached, first_weight as x1, case when member_type = 'MACHINERY' then 1.0::double else 0.0 end as x2,
        weight_days - avg(weight_days) over w as x3, pow(weight_days - avg(weight_days) over w, 2) as x4,
        (ln(1 + c) - avg(ln(1 + c)) over w) / stddev_samp(ln(1 + c)) over w as z, percentage_loss as y
      from dense window w as (partition by event_type)) d0 window w as (partition by event_type))"""
    for k, own in enumerate(names):
        rest = [*names[k + 1 :], "y"]
        slope = lambda c, own=own: f"sum({c} * {own}) over w / sum({own} * {own}) over w"
        moved = ", ".join(f"{c} - {own} * ({slope(c)}) as {c}" for c in rest)
        keep = f", z as zr, sum(z * z) over w as zz, {slope('y')} as b" if own == "z" else ""
        sql = f"(select event_type, n, n_reached, h + {own} * {own} / sum({own} * {own}) over w as h, {moved}{keep} from {sql} o{k} window w as (partition by event_type))"
    return f""", dense as (select k.*, t.event_type, coalesce(event_count, 0)::double as c from cohort k cross join types t left join counts n on n.member_id = k.member_id and n.event_type = t.event_type),
fits as (select event_type, any_value(n_reached) as n_reached, any_value(b) as b, sqrt(sum(pow(zr * y / (1 - h), 2))) / any_value(zz) as se from {sql} e group by event_type)"""


_TESTED = f"""select event_type, n_reached::bigint as n_reached, case when n_reached < 30 then 'insufficient_reach' else 'tested' end as test_status, {_r('case when n_reached >= 30 then b end', 'estimate')}, {_r('case when n_reached >= 30 then se end', 'standard_error')},
 {_r('case when n_reached >= 30 then b / se end', 'test_statistic')}, {_r('case when n_reached >= 30 then b - 1.959963984540054 * se end', 'ci_lower')}, {_r('case when n_reached >= 30 then b + 1.959963984540054 * se end', 'ci_upper')} from fits"""


# erfc(x) by the series of erf with positive terms only, told by logarithms.
_NORMAL_P = "1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(200), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(x) - lgamma(2 * n + 2) + lgamma(n + 1))))"
_P_VALUES = f""", ps as (select event_type, case when n_reached >= 30 then {_NORMAL_P} end as p from (select *, greatest(abs(b / se) / sqrt(2), 1e-300::double) as x from fits) f),
ranked as (select *, row_number() over (order by p) as place, count(p) over () as m from ps where p is not null)
select event_type, round(p, 6) as p_value, round(least(1, min(p * m / place) over (order by place desc rows between unbounded preceding and current row)), 6) as fdr_adjusted_p_value from ranked
union all select event_type, null, null from ps where p is null"""


def _associations(s: Study) -> DataFrame:
    with once(cohort_of(s), "member_id", "last_weight_at", "percentage_loss", "weight_days", *BASE) as k, once(f.event_pairs(s.engagement, k)) as pairs:
        return activity_associations(k, f.event_counts(s.engagement, k, RULES, pairs), f.classify_pairs(pairs, RULES), ["treated"])


@query("q37_activity_associations", _association_fits() + " " + _TESTED)
def _(s: Study) -> DataFrame:
    return _associations(s).drop("p_value")  # a normal probability: DuckDB has no erf


@query("q40_activity_p_values", _association_fits() + _P_VALUES)
def _(s: Study) -> DataFrame:
    return adjust_p(_associations(s), "p_value").select("event_type", "p_value", "fdr_adjusted_p_value")


@query("q38_collinearity")
def _(s: Study) -> DataFrame:
    names = ["intercept", "first_weight", "treated", *MEAN]
    with wide_once(s, *names[1:]) as w:
        got = diagnose_collinearity(w, [F.lit(1.0), *[F.col(x) for x in names[1:]]], names)
    return _rows(s, ["position", "singular_value", "rank"], [(k, v, got.rank) for k, v in enumerate(got.singular_values)], "int double int")


_SUMMARIZED = ["first_weight", "last_weight", "percentage_loss", "weight_days", *MEAN]
_STATISTICS = {
    "n_observed": "count({v})::double", "n_missing": "(count(*) - count({v}))::double", "mean": "avg({v})",
    "standard_deviation": "stddev_samp({v})", "minimum": "min({v})::double", "median": "quantile_cont({v}, 0.5)",
    "maximum": "max({v})::double"
}


@query(
    "q39_feature_summary",
    " union all ".join(
        f"select {k} as variable_order, '{v}' as variable, '{name}' as statistic, {_r(x.format(v=v), 'value')} from features" for k,
        v in enumerate(_SUMMARIZED, 1) for name, x in _STATISTICS.items()
    )
)
def _(s: Study) -> DataFrame:
    return d.feature_summary(features_of(s), _SUMMARIZED)


_CHOLESKY = """, l as (select 1 / sqrt(v00) as a, -v01 / v00 / sqrt(v11 - v01 * v01 / v00) as c, 1 / sqrt(v11 - v01 * v01 / v00) as d from a where structure = 'compound_symmetry')
select member_id, 'first' as occasion, round(l.a * ln(first_weight), 6) as outcome, 0.0::double as time, round(l.a * (member_type = 'MACHINERY')::int, 6) as treated, round(l.a * engagement_breadth, 6) as breadth, 0.0::double as time_breadth from features cross join l
union all select member_id, 'last', round(l.c * ln(first_weight) + l.d * ln(last_weight), 6), round(l.d, 6), round((l.c + l.d) * (member_type = 'MACHINERY')::int, 6), round((l.c + l.d) * engagement_breadth, 6), round(l.d * engagement_breadth, 6) from features cross join l"""


@query("q41_longitudinal_whitened_design", _GLS + _CHOLESKY)
def _(s: Study) -> DataFrame:
    w = wide(s)
    rows = whitened(w, fit_gls(w, ["treated"], scale_name="log", structure="compound_symmetry"), ["engagement_breadth"])
    return rows.select(
        "member_id", "occasion", "outcome", "time", "treated", F.col("engagement_breadth").alias("breadth"),
        F.col("`time:engagement_breadth`").alias("time_breadth")
    )


@query("q42_longitudinal_lasso")
def _(s: Study) -> DataFrame:
    with wide_once(s, "member_id", "member_type", "last_weight", *BASE, *MEAN) as w:
        rows = exploratory_records(w, fit_gls(w, ["treated"], scale_name="log", structure="compound_symmetry"), MEAN)
    return _rows(s, ["variable", "selected", "coefficient", "estimable"], [(r["variable"], r["count"], r["value"], r["estimable"]) for r in rows], "string int double boolean")


@query("q43_member_consistency", """ select count(*) filter (f.member_id is null) as only_in_members, count(*) filter (k.member_id is null) as only_in_features, count(*) filter (k.member_type is distinct from f.member_type and k.member_id is not null and f.member_id is not null) as type_differs,
  (select count(*) from counts where member_id not in (select member_id from cohort)) as counts_of_no_member, (select count(*) from (select 1 from counts group by member_id, event_type having count(*) > 1) x) as repeated_pairs
  from cohort k full join features f on k.member_id = f.member_id""")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES)
    return member_consistency(k, features_of(s), f.event_counts(s.engagement, k, RULES))


@query("q44_rank_positions", " select member_id, round((row_number() over (order by percentage_loss, member_id) - 0.5) / count(*) over (), 6)::double as position from cohort")
def _(s: Study) -> DataFrame:
    return rank_positions(cohort_of(s), "percentage_loss", "member_id").select("member_id", "position")


@query("q45_lasso_huge_candidate", ORACLE_SQL["q35_lasso_one_candidate"].removeprefix(f"with {PREFIX} "))
def _(s: Study) -> DataFrame:
    """The fit of q35 with its candidate times 1e200 and its baseline over 1e200, told in the units of q35."""
    with wide_once(s, *BASE, "engagement_breadth", "percentage_loss") as w:
        far = w.withColumns({"engagement_breadth": F.col("engagement_breadth") * 1e200, "first_weight": F.col("first_weight") / 1e200})
        fit = ls.fit_lasso(far, "percentage_loss", BASE, ["engagement_breadth"], 0.5)
    return _rows(s, ["candidate", "coefficient"], [("engagement_breadth", float(fit.coefficients[0]) * 1e200)], "string double")


@query("q46_prediction_by_fitted_levels", """, k as (select *, trim(ethnicity) as g from cohort where trim(ethnicity) <> ''),
means as (select g, avg(first_weight) as mx, avg(percentage_loss) as my from k group by g),
slope as (select sum((first_weight - mx) * (percentage_loss - my)) / sum((first_weight - mx) * (first_weight - mx)) as b from k join means on k.g = means.g)
select member_id, round(first_weight * (1 - (my + b * (first_weight - mx)) / 100), 4) as predicted_last_weight from k join means on k.g = means.g cross join slope""")
def _(s: Study) -> DataFrame:
    k = c.members(s, RULES).where("trim(ethnicity) <> ''")
    model = fit_percentage_loss(k, [Contrasts.of(k, "ethnicity")])
    return model.predict_last_weight(k).select("member_id", F.round("predicted_last_weight", 4).alias("predicted_last_weight"))


def _last_slope(source: str, names: list[str]) -> str:
    """(n, b, se) of the last of the regressors, with HC3: each one less what those before it explain."""
    sql = f"(select count(*) over () as n, 1.0::double / count(*) over () as h, {', '.join(f'{c} - avg({c}) over () as {c}' for c in [*names, 'y'])} from {source} d0)"
    for k, own in enumerate(names):
        moved = ", ".join(f"{c} - {own} * (sum({c} * {own}) over () / sum({own} * {own}) over ()) as {c}" for c in [*names[k + 1 :], "y"])
        keep = f", {own} as zr, sum({own} * {own}) over () as zz, sum(y * {own}) over () / sum({own} * {own}) over () as b" if own == names[-1] else ""
        sql = f"(select n, h + {own} * {own} / sum({own} * {own}) over () as h, {moved}{keep} from {sql} o{k})"
    return f"select any_value(n) as n, any_value(b) as b, sqrt(sum(pow(zr * y / (1 - h), 2))) / any_value(zz) as se from {sql} e"


_SUPPORT = """, ends as (select max(lo) as lo, min(hi) as hi from (select member_type, min(weight_days) as lo, max(weight_days) as hi from cohort group by member_type) t),
near as (select first_weight as x, percentage_loss as y, (member_type = 'MACHINERY')::int::double as g, weight_days - avg(weight_days) over () as d from cohort cross join ends where weight_days between lo and hi),
regressors as (select *, d * d as d2 from near)"""


@query("q47_duration_sensitivity", f"{_SUPPORT} select 'treated' as term, n, {_r('b', 'estimate')}, {_r('se', 'standard_error')} from ({_last_slope('regressors', ['x', 'd', 'd2', 'g'])}) f")
def _(s: Study) -> DataFrame:
    k = common_support(cohort_of(s), "weight_days")
    days = k.agg(F.avg("weight_days")).first()[0]
    k = k.withColumn("days", F.col("weight_days") - F.lit(days)).withColumn("days2", F.col("days") ** 2)
    fit = fit_ols(k, "percentage_loss", [*BASE, "days", "days2"])
    row = coefficient_table(fit, fit.hc3(k))[2]
    return _rows(s, ["term", "n", "estimate", "standard_error"], [(row.term, fit.n, float(row.estimate), float(row.standard_error))], "string bigint double double")


@query("q48_model_summary", f""" select * from (with {_GLS.lstrip(', ')}
  select structure as model_id, n::bigint as n_members, parameters::bigint as parameters, round(ll - logs, 4) as log_likelihood, round(-2 * (ll - logs), 4) as deviance, round(-2 * (ll - logs) + 2 * parameters, 4) as aic, round(-2 * (ll - logs) + ln(n) * parameters, 4) as bic, null::double as r_squared, null::double as rmse from a) g
union all select * from (with {_OLS.lstrip(', ')}
  select 'percentage_loss_ols', n::bigint, 4, null, round(n * (ln(2 * pi() * rss / n) + 1), 4), round(n * (ln(2 * pi() * rss / n) + 1) + 8, 4), round(n * (ln(2 * pi() * rss / n) + 1) + 4 * ln(n), 4), round(1 - rss / tss, 6), round(sqrt(rss / n), 6) from fit) o""")
def _(s: Study) -> DataFrame:
    with once(cohort_of(s), "last_weight", "percentage_loss", *BASE) as k:
        fits = {x: fit_gls(k, ["treated"], scale_name="log", structure=x) for x in ("unstructured", "compound_symmetry", "iid")}
        table = model_summary({**fits, "percentage_loss_ols": fit_ols(k, "percentage_loss", BASE)})
    four, six = ("log_likelihood", "deviance", "aic", "bic"), ("r_squared", "rmse")
    rows = [(r.model_id, int(r.n_members), int(r.parameters), *(None if math.isnan(v) else round(v, d) for d, names in ((4, four), (6, six)) for v in (float(getattr(r, n)) for n in names))) for r in table.itertuples()]
    return _rows(s, ["model_id", "n_members", "parameters", *four, *six], rows, "string bigint bigint" + " double" * 6)


@query("q49_condition_number", " select round(sqrt((1 + abs(r)) / (1 - abs(r))), 6) as condition_number from (select corr(first_weight, (member_type = 'MACHINERY')::int::double) as r from cohort) c")
def _(s: Study) -> DataFrame:
    """Of an intercept and two standardised columns: their correlation matrix has the eigenvalues 1, 1 + r and 1 - r."""
    return _rows(s, ["condition_number"], [(condition_number(cohort_of(s), BASE),)], "double")


_COMPARED = _CV[: _CV.rindex("\nselect repeat::int")] + """
select model as model_id, metric, count(*) as n_fold_scores, sum(n_test)::bigint as n_test_predictions, round(avg(v), 6) as mean_score, round(stddev_samp(v), 6) as standard_deviation, round(min(v), 6) as minimum_score, round(max(v), 6) as maximum_score, model = (select model from best) as is_winner
from (select model, n_test, 'rmse' as metric, rmse as v from scores union all select model, n_test, 'mae', mae from scores) u group by model, metric"""


@query("q50_base_model_comparison_summary", _PLACES.format(r="repeat", n=2) + _COMPARED)
def _(s: Study) -> DataFrame:
    scores = base_model_cv(cohort_of(s), ["treated"], folds=5, repeats=2, seed=SEED)
    kept = s.demographics.sparkSession.createDataFrame(scores.collect(), scores.schema)  # a row a fold and model
    names = {"model_id": "string", "metric": "string", "n_fold_scores": "bigint", "n_test_predictions": "bigint", "mean_score": "double", "standard_deviation": "double", "minimum_score": "double", "maximum_score": "double", "is_winner": "boolean"}
    rows = comparison_rows(kept.toPandas(), winner(kept), Config(cv_folds=5, cv_repeats=2, seed=SEED))
    plain = lambda r: tuple(float(r[n]) if t == "double" else bool(r[n]) if t == "boolean" else r[n] for n, t in names.items())
    return _rows(s, list(names), [plain(r) for r in rows], " ".join(names.values()))


@query("q51_residual_quantiles", _OLS + """, z as (select e / sqrt(rss / (n - 3) * (1 - h)) as z from points cross join fit)
select k::int as bin_order, round((k - 0.5) / 9, 6) as probability, round(list_extract(quantile_cont(z, [0.5 / 9, 1.5 / 9, 2.5 / 9, 3.5 / 9, 4.5 / 9, 5.5 / 9, 6.5 / 9, 7.5 / 9, 8.5 / 9]), k), 6) as value from z cross join range(1, 10) r(k) group by k""")
def _(s: Study) -> DataFrame:
    k = cohort_of(s)
    fit = fit_ols(k, "percentage_loss", BASE)
    rows = quantile_pairs(fit.with_diagnostics(k), "percentage_loss", fit.n)
    return _rows(s, ["bin_order", "probability", "value"], [(r["bin_order"], r["bin_lower"], float(r["value"])) for r in rows], "int double double")


_DESIGN = ["first_weight", "treated", *MEAN]
_PAIRS = " + ".join(f"2 * pow(corr({a}, {b}), 2)" for k, a in enumerate(_DESIGN) for b in _DESIGN[k + 1 :])


@query(
    "q52_collinearity_identities",
    f" select count(*) as n, {float(len(_DESIGN))}::double as squares, round({len(_DESIGN)} + {_PAIRS}, 6) as fourth_powers from (select *, (member_type = 'MACHINERY')::int::double as treated from features) f"
)
def _(s: Study) -> DataFrame:
    """Of the singular values of standardised columns the squares add up to n p, the fourth powers to n^2 times all squared correlations."""
    with wide_once(s, *_DESIGN) as w:
        scale = Scale.of(w, _DESIGN)
        n = w.count()
        v = [x * x / n for x in diagnose_collinearity(w, [scale.apply(x) for x in _DESIGN], _DESIGN).singular_values]
    return _rows(s, ["n", "squares", "fourth_powers"], [(n, float(sum(v)), float(sum(x * x for x in v)))], "bigint double double")
