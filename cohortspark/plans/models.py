"""Linear models from moments: ordinary least squares with HC3, and two-occasion marginal GLS."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..functions.stats import two_sided_p, z_value
from .moments import Moments, Scale, moments, require_finite


@dataclass(frozen=True)
class Ols:
    """A least-squares fit of ``outcome`` on 1 and ``names``; coefficients are on the raw scale."""

    outcome: str
    names: tuple[str, ...]
    scale: Scale
    scaled: np.ndarray
    inverse: np.ndarray
    n: int
    rss: float
    tss: float

    @property
    def k(self) -> int:
        return len(self.names) + 1

    @property
    def terms(self) -> tuple[str, ...]:
        return ("intercept", *self.names)

    @property
    def back(self) -> np.ndarray:
        return self.scale.of_names(self.names).back()

    @property
    def coefficients(self) -> np.ndarray:
        return self.back @ self.scaled

    @property
    def covariance(self) -> np.ndarray:
        """Model-based, with the unbiased variance."""
        return self.back @ self.inverse @ self.back.T * self.rss / (self.n - self.k)

    @property
    def r_squared(self) -> float:
        return 1 - self.rss / self.tss if self.tss else math.nan

    @property
    def adjusted_r_squared(self) -> float:
        return 1 - (1 - self.r_squared) * (self.n - 1) / (self.n - self.k)

    @property
    def deviance(self) -> float:
        """-2 log likelihood at the ML variance."""
        return self.n * (math.log(2 * math.pi * self.rss / self.n) + 1)

    def aic(self, extra: int = 1) -> float:
        """With the variance as a parameter (``extra=1``) or without."""
        return self.deviance + 2 * (self.k + extra)

    def bic(self, extra: int = 1) -> float:
        return self.deviance + math.log(self.n) * (self.k + extra)

    def fitted(self) -> Column:
        out = F.lit(float(self.scaled[0]))
        for b, n in zip(self.scaled[1:], self.names):
            out = out + F.lit(float(b)) * self.scale.apply(n)
        return out

    def leverage(self) -> Column:
        z = [F.lit(1.0), *[self.scale.apply(n) for n in self.names]]
        out = F.lit(0.0)
        for i in range(self.k):
            for j in range(self.k):
                out = out + F.lit(float(self.inverse[i, j])) * z[i] * z[j]
        return out

    def with_diagnostics(self, df: DataFrame) -> DataFrame:
        """Fitted value, residual, leverage, internally studentised residual and Cook's distance of each row."""
        s2 = self.rss / (self.n - self.k)
        base = df.dropna(subset=[self.outcome, *self.names]).withColumns({"fitted_value": self.fitted(), "leverage": self.leverage()})
        base = base.withColumn("residual", F.col(self.outcome).cast("double") - F.col("fitted_value"))
        base = base.withColumn("standardized_residual", F.col("residual") / F.sqrt(F.lit(s2) * (1 - F.col("leverage"))))
        return base.withColumn("cooks_distance", F.col("standardized_residual") ** 2 * F.col("leverage") / ((1 - F.col("leverage")) * self.k))

    def hc3(self, df: DataFrame) -> np.ndarray:
        """The heteroscedasticity-consistent covariance; a second aggregation, of x x' (e / (1 - h))^2."""
        weight = (F.col("residual") / (1 - F.col("leverage"))) ** 2
        meat = moments(self.with_diagnostics(df), self.names, scale=self.scale.of_names(self.names), weight=weight).total
        return self.back @ self.inverse @ meat @ self.inverse @ self.back.T


def solve_ols(gram: np.ndarray, m: Moments, outcome: str, names: Sequence[str]) -> Ols:
    """From a Gram of (1, names..., outcome); fails on collinear columns."""
    x, y = m.at("1", *names), m.at(outcome)[0]
    a, b = gram[np.ix_(x, x)], gram[x, y]
    if np.linalg.matrix_rank(a, tol=1e-10 * max(1.0, a.max())) < len(x):
        raise ValueError(f"collinear or constant: {', '.join(names)}")
    k = m.scale.names.index(outcome)
    n = int(round(gram[0, 0]))
    if n <= len(x):
        raise ValueError("too few rows")
    inverse = np.linalg.inv(a)
    beta = np.linalg.solve(a, b)
    rss = float(gram[y, y] - beta @ b)
    tss = float(gram[y, y] - gram[0, y] ** 2 / gram[0, 0])
    sd, mean = m.scale.sd[k], m.scale.mean[k]
    scaled = beta * sd
    scaled[0] += mean
    own = m.scale.of_names(names)
    with np.errstate(over="ignore", invalid="ignore"):
        rss, tss = max(rss, 0.0) * sd**2, tss * sd**2
    require_finite("the least-squares fit", rss, tss, own.back() @ scaled)
    return Ols(outcome, tuple(names), own, scaled, inverse, n, rss, tss)


def fit_ols(df: DataFrame, outcome: str, names: Sequence[str]) -> Ols:
    m = moments(df, [*names, outcome])
    return solve_ols(m.total, m, outcome, names)


@dataclass(frozen=True)
class Coefficient:
    term: str
    estimate: float
    standard_error: float
    statistic: float
    p_value: float
    ci_lower: float
    ci_upper: float


def coefficient_table(fit: Ols, covariance: np.ndarray, confidence: float = 0.95) -> list[Coefficient]:
    """Normal-reference inference for each term."""
    z, out = z_value(confidence), []
    for term, b, v in zip(fit.terms, fit.coefficients, np.diag(covariance)):
        se = math.sqrt(max(v, 0.0))
        t = b / se if se else math.nan
        out.append(Coefficient(term, float(b), se, t, two_sided_p(t) if se else math.nan, b - z * se, b + z * se))
    return out


#: A factor has so many levels at most: its levels are the fit's columns.
MOST_LEVELS = 1000


@dataclass(frozen=True)
class Contrasts:
    """A factor's levels and reference as they were fitted; every other level is a 0/1 column."""

    column: str
    levels: tuple[str, ...]
    reference: str

    @classmethod
    def of(cls, df: DataFrame, column: str, reference: str | None = None, preferred: str | None = None) -> Contrasts:
        """From the observed levels, trimmed, in order.

        The reference is the one given, which has to be observed; else the
        preferred one if it is; else the first.
        """
        rows = df.select(strip(F.col(column).cast("string")).alias("v")).where(F.col("v").isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
        levels = tuple(sorted(r[0] for r in rows))
        if not levels or len(levels) > MOST_LEVELS:
            raise ValueError(f"{column} has no level, or more than {MOST_LEVELS}")
        if reference is not None and reference.strip() not in levels:
            raise ValueError(f"the reference of {column} must be an observed level")
        return cls(column, levels, reference.strip() if reference is not None else preferred if preferred in levels else levels[0])

    @property
    def others(self) -> tuple[str, ...]:
        return tuple(v for v in self.levels if v != self.reference)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f"{self.column}[{v}]" for v in self.others)

    def apply(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """``df`` with the contrasts' columns; a missing value's are missing, an unseen level fails the query."""
        own = strip(F.col(self.column).cast("string"))
        seen = own.isin(*self.levels)
        unseen = F.raise_error(F.concat(F.lit(f"unseen level of {self.column}: "), own)).cast("double")
        columns = {n: F.when(own.isNull(), F.lit(None).cast("double")).when(~seen, unseen).otherwise((own == v).cast("double")) for n, v in zip(names or self.names, self.others)}
        return df.withColumns(columns) if columns else df.where(F.when(own.isNull() | seen, True).otherwise(unseen.isNull()))


@dataclass(frozen=True)
class Factored:
    """A fitted model with its factors: new members are coded as the fitted ones were."""

    fit: Ols | Gls
    contrasts: tuple[Contrasts, ...]

    def predict_last_weight(self, df: DataFrame, out: str = "predicted_last_weight", first: str = "first_weight") -> DataFrame:
        """``df`` with the expected last weight; an unseen level, or a first weight that is missing or not positive, fails the query."""
        for c in self.contrasts:
            df = c.apply(df)
        w = F.col(first).cast("double")
        checked = F.when((w > 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("a first weight must be positive and finite")).cast("double"))
        own = df.withColumn(first, checked)
        if isinstance(self.fit, Gls):
            own = own.withColumn(out, self.fit.predicted_last(F.col(first)))
        else:
            own = own.withColumn(out, F.col(first) * (1 - self.fit.fitted() / 100))
        return own.drop(*[n for c in self.contrasts for n in c.names])


def fit_percentage_loss(df: DataFrame, factors: Sequence[Contrasts], names: Sequence[str] = ("first_weight",), outcome: str = "percentage_loss") -> Factored:
    """Least squares of the percentage loss on ``names`` and the factors' contrasts."""
    for c in factors:
        df = c.apply(df)
    return Factored(fit_ols(df, outcome, [*names, *[n for c in factors for n in c.names]]), tuple(factors))


def fit_two_occasions(df: DataFrame, factors: Sequence[Contrasts], **options: object) -> Factored:
    """:func:`fit_gls` on the factors' contrasts."""
    for c in factors:
        df = c.apply(df)
    return Factored(fit_gls(df, [n for c in factors for n in c.names], **options), tuple(factors))


# Two occasions

COVARIANCES = {"iid": 1, "diagonal": 2, "compound_symmetry": 2, "unstructured": 3}


@dataclass(frozen=True)
class Gls:
    """y0 = B beta, y1 - y0 = D delta with a 2 x 2 covariance, by maximum likelihood."""

    scale_name: str
    structure: str
    names: tuple[str, ...]
    change_names: tuple[str, ...]
    beta: np.ndarray
    delta: np.ndarray
    v00: float
    v01: float
    v11: float
    n: int
    log_likelihood: float
    raw_log_likelihood: float
    standard_errors: np.ndarray

    @property
    def parameters(self) -> int:
        return len(self.beta) + len(self.delta) + COVARIANCES[self.structure]

    @property
    def deviance(self) -> float:
        return -2 * self.raw_log_likelihood

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.parameters

    @property
    def bic(self) -> float:
        return self.deviance + math.log(self.n) * self.parameters

    def predicted_last(self, first: Column) -> Column:
        """The last weight's expectation given the first; on the log scale that of the weight itself."""
        y0 = F.log(first) if self.scale_name == "log" else first.cast("double")
        mean0 = _linear(self.beta, self.names)
        mean1 = mean0 + _linear(self.delta, self.change_names)
        mu = mean1 + F.lit(self.v01 / self.v00) * (y0 - mean0)
        return F.exp(mu + F.lit(0.5 * (self.v11 - self.v01**2 / self.v00))) if self.scale_name == "log" else mu


def _linear(b: np.ndarray, names: Sequence[str]) -> Column:
    out = F.lit(float(b[0]))
    for v, n in zip(b[1:], names):
        out = out + F.lit(float(v)) * F.col(n)
    return out


def gls_columns(df: DataFrame, scale_name: str, first: str = "first_weight", last: str = "last_weight") -> DataFrame:
    """``df`` with y0, the change d and the log weights' sum, on the raw or log scale."""
    a, b = F.col(first).cast("double"), F.col(last).cast("double")
    y0, y1 = (F.log(a), F.log(b)) if scale_name == "log" else (a, b)
    return df.withColumns({"_y0": y0, "_d": y1 - y0, "_logs": F.log(a) + F.log(b)})


def _residual(gram: np.ndarray, x: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, residual cross products) of columns y on columns x."""
    a, b = gram[np.ix_(x, x)], gram[np.ix_(x, y)]
    coef = np.linalg.solve(a, b)
    return coef, gram[np.ix_(y, y)] - b.T @ coef


def solve_gls(gram: np.ndarray, m: Moments, names: Sequence[str], *, scale_name: str, structure: str, interaction: bool, jacobian: float) -> Gls:
    """From a Gram of (1, names..., _y0, _d).

    The mid-point and the change, or the first value given the change, have
    independent likelihoods, so that each structure is regressions of
    combinations of y0 and d on B and on D, all read off one Gram.
    """
    if structure not in COVARIANCES:
        raise ValueError(f"structure must be one of {', '.join(COVARIANCES)}")
    # back to raw coordinates
    lift = np.eye(len(gram))
    for k, (mean, sd) in enumerate(zip(m.scale.mean, m.scale.sd), start=1):
        lift[k, 0], lift[k, k] = mean, sd
    centred = lift.copy()
    y0, d = m.at("_y0", "_d")
    centred[y0, 0] = centred[d, 0] = 0.0  # the outcomes' means are added at the end
    g = centred @ gram @ centred.T
    shift0, shift_d = m.scale.mean[y0 - 1], m.scale.mean[d - 1]
    b = m.at("1", *names)
    dd = b if interaction else [0]
    n = g[0, 0]
    delta, rss_d = _residual(g, dd, [d])
    delta, rss_d = delta[:, 0], float(rss_d[0, 0])
    _, s = _residual(g, b, [y0, d])
    coef = np.linalg.solve(g[np.ix_(b, b)], g[np.ix_(b, [y0, d])])
    wide = np.zeros(len(b))
    wide[: len(dd)] = delta
    if rss_d <= 0 or s[0, 0] <= 0:
        raise ValueError("an outcome does not vary")

    def combined(weight: float) -> float:
        """Residual sum of squares of y0 + weight * d on B."""
        return float(s[0, 0] + 2 * weight * s[0, 1] + weight**2 * s[1, 1])

    if structure in ("compound_symmetry", "iid"):
        rss_m = combined(0.5)
        if structure == "iid":
            v = (2 * rss_m + 0.5 * rss_d) / (2 * n)
            v00, v01, v11 = v, 0.0, v
            log_l = -n * (math.log(2 * math.pi * v) + 1)
        else:
            vm, vd = rss_m / n, rss_d / n
            v00 = v11 = vm + vd / 4
            v01 = vm - vd / 4
            log_l = -n / 2 * (math.log(2 * math.pi * vd) + math.log(2 * math.pi * vm) + 2)
        beta = coef[:, 0] + 0.5 * coef[:, 1] - 0.5 * wide
    else:
        if structure == "unstructured":
            # y0 on B and the change's residual, which differs from d by columns of D, which are in B's span
            kappa = float(s[0, 1] / s[1, 1])
            vd = rss_d / n
            vc = combined(-kappa) / n
            log_l = -n / 2 * (math.log(2 * math.pi * vd) + math.log(2 * math.pi * vc) + 2)
            v00, v01 = vc + kappa**2 * vd, vc + kappa**2 * vd + kappa * vd
            v11 = v00 + 2 * kappa * vd + vd
        else:
            def cost(k: float) -> float:
                q = -k * (1 + k)
                return math.log(q) + 2 * math.log(rss_d + combined(-k) / q)

            lo, hi, golden = -1 + 1e-12, -1e-12, (math.sqrt(5) - 1) / 2
            a1, a2 = hi - golden * (hi - lo), lo + golden * (hi - lo)
            c1, c2 = cost(a1), cost(a2)
            for _ in range(200):
                if hi - lo < 1e-12:
                    break
                if c1 <= c2:
                    hi, a2, c2 = a2, a1, c1
                    a1 = hi - golden * (hi - lo)
                    c1 = cost(a1)
                else:
                    lo, a1, c1 = a1, a2, c2
                    a2 = lo + golden * (hi - lo)
                    c2 = cost(a2)
            kappa = (lo + hi) / 2
            edge = math.sqrt(np.finfo(float).eps)
            if kappa < -1 + edge or kappa > -edge:
                raise ValueError("a variance is at the boundary")
            q = -kappa * (1 + kappa)
            vd = (rss_d + combined(-kappa) / q) / (2 * n)
            v00, v01, v11 = -kappa * vd, 0.0, (1 + kappa) * vd
            log_l = -n / 2 * (math.log(2 * math.pi * vd) + math.log(2 * math.pi * q * vd) + 2)
        beta = coef[:, 0] - kappa * (coef[:, 1] - wide)
    v = np.array([[v00, v01], [v01, v11]])
    if np.linalg.eigvalsh(v)[0] <= math.sqrt(np.finfo(float).eps) * np.linalg.eigvalsh(v)[1]:
        raise ValueError("the covariance is not positive definite")
    w = np.linalg.inv(v)
    bb, bd, d_d = g[np.ix_(b, b)], g[np.ix_(b, dd)], g[np.ix_(dd, dd)]
    information = np.block([[bb * w.sum(), bd * (w[0, 1] + w[1, 1])], [bd.T * (w[0, 1] + w[1, 1]), d_d * w[1, 1]]])
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    require_finite("the two-occasion fit", beta, delta, v, log_l, se)
    beta, delta = beta.copy(), delta.copy()
    beta[0] += shift0
    delta[0] += shift_d
    return Gls(
        scale_name, structure, tuple(names), tuple(names) if interaction else (), beta, delta, float(v00), float(v01), float(v11),
        int(round(n)), float(log_l), float(log_l - jacobian), se
    )


def fit_gls(df: DataFrame, names: Sequence[str], *, scale_name: str = "raw", structure: str = "unstructured", interaction: bool = False) -> Gls:
    """B is 1 and ``names``; the change depends on 1, or with ``interaction`` on B."""
    if scale_name not in ("raw", "log"):
        raise ValueError("scale_name must be raw or log")
    own = gls_columns(df, scale_name)
    m = moments(own, [*names, "_y0", "_d"])
    logs = own.dropna(subset=[*names, "_y0", "_d"]).agg(F.sum("_logs")).first()[0] if scale_name == "log" else 0.0
    return solve_gls(m.total, m, names, scale_name=scale_name, structure=structure, interaction=interaction, jacobian=logs)
