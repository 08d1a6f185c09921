"""Partially penalised LASSO on a Gram matrix, its tuning and its stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import Moments, Scale, moments, require_finite

RATIOS = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)


@dataclass(frozen=True)
class Lasso:
    """Minimises RSS / 2n + lambda * sum(w |theta|) with unpenalised base columns.

    ``theta`` are of candidates with unit population SD, ``coefficients`` of
    raw candidates; ``base`` are raw, the intercept first.
    """

    base_names: tuple[str, ...]
    names: tuple[str, ...]
    theta: np.ndarray
    coefficients: np.ndarray
    base: np.ndarray
    lam: float
    lam_max: float
    objective: float
    excluded: tuple[str, ...]
    sweeps: int

    def predicted(self) -> Column:
        out = F.lit(float(self.base[0]))
        for b, n in zip([*self.base[1:], *self.coefficients], [*self.base_names, *self.names]):
            out = out + F.lit(float(b)) * F.col(n)
        return out


def solve_lasso(
    gram: np.ndarray, m: Moments, outcome: str, base_names: Sequence[str], names: Sequence[str], ratio: float,
    weights: Sequence[float] | None = None, tolerance: float = 1e-10, most: int = 10_000
) -> Lasso:
    """Coordinate descent on the candidates' Gram after the base columns are projected out.

    Means and scales are those of the Gram's own rows.  Candidates that are
    constant, or within the base columns' span, are excluded.  Fails if the
    optimality conditions are not met within ``most`` sweeps.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must lie between 0 and 1")
    w = np.ones(len(names)) if weights is None else np.asarray(weights, float)
    if (w < 0).any():
        raise ValueError("weights must not be negative")
    b, z, y = m.at("1", *base_names), m.at(*names), m.at(outcome)[0]
    n = gram[0, 0]
    mean, square = gram[0, z] / n, np.diag(gram)[z] / n
    sd = np.sqrt(np.maximum(square - mean**2, 0))
    constant = sd <= 1e-12 * np.maximum(1.0, np.abs(mean))
    safe = np.where(constant, 1.0, sd)
    gbb = gram[np.ix_(b, b)]
    proj_z, proj_y = np.linalg.solve(gbb, gram[np.ix_(b, z)]), np.linalg.solve(gbb, gram[b, y])
    s = (gram[np.ix_(z, z)] - gram[np.ix_(z, b)] @ proj_z) / np.outer(safe, safe) / n
    c = (gram[z, y] - gram[np.ix_(z, b)] @ proj_y) / safe / n
    rest = gram[y, y] - gram[b, y] @ proj_y
    out = constant | (np.diag(s) <= 1e-10)
    live = np.flatnonzero(~out)
    free = live[w[live] == 0]
    theta = np.zeros(len(names))
    if len(free):  # unpenalised candidates first
        theta[free] = np.linalg.lstsq(s[np.ix_(free, free)], c[free], rcond=None)[0]
    grad = c - s @ theta
    penal = live[w[live] > 0]
    lam_max = float(np.max(np.abs(grad[penal]) / w[penal])) if len(penal) else 0.0
    lam = ratio * lam_max
    sweeps, limit = 0, tolerance * max(1.0, np.abs(c).max(initial=0.0))
    while len(live):
        g = c - s @ theta
        off = np.where(theta[live] != 0, np.abs(g[live] - lam * w[live] * np.sign(theta[live])), np.maximum(np.abs(g[live]) - lam * w[live], 0))
        if off.max() <= limit:
            break
        if sweeps == most:
            raise ValueError("coordinate descent has not converged")
        for j in live:
            r = c[j] - s[j] @ theta + s[j, j] * theta[j]
            theta[j] = np.sign(r) * max(abs(r) - lam * w[j], 0.0) / s[j, j]
        sweeps += 1
    k = m.scale.names.index(outcome)
    unit = m.scale.sd[k]
    order_z, order_b = [m.scale.names.index(x) for x in names], [m.scale.names.index(x) for x in base_names]
    scaled = theta / safe
    base = proj_y - proj_z @ scaled
    coef = scaled * unit / m.scale.sd[order_z]
    base = base * unit
    raw = base.copy()
    raw[1:] = base[1:] / m.scale.sd[order_b]
    raw[0] = base[0] + m.scale.mean[k] - raw[1:] @ m.scale.mean[order_b] - coef @ m.scale.mean[order_z]
    with np.errstate(over="ignore", invalid="ignore"):
        fit = (rest / n - 2 * theta @ c + theta @ s @ theta) * unit**2
        objective = float(fit / 2 + lam * unit * (w * np.abs(theta) * unit).sum())
    require_finite("the penalised fit", coef, raw, theta * unit, lam * unit, lam_max * unit, objective)
    return Lasso(tuple(base_names), tuple(names), theta * unit, coef, raw, lam * unit, lam_max * unit, objective, tuple(n for n, x in zip(names, out) if x), sweeps)


def fit_lasso(
    df: DataFrame, outcome: str, base_names: Sequence[str], names: Sequence[str], ratio: float, weights: Sequence[float] | None = None, scale: Scale | None = None
) -> Lasso:
    m = moments(df, [*base_names, *names, outcome], scale=scale)
    return solve_lasso(m.total, m, outcome, base_names, names, ratio, weights)


# Folds and subsamples


def numbered(df: DataFrame, by: Sequence[str], key: Column, out: str) -> DataFrame:
    """Rows numbered from 0 within ``by`` in the order of a hex key.

    A group is numbered in 4,096 parts by the key's first digits, with the
    parts' sizes added up, so that no group is one sort.
    """
    keyed = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    sizes = keyed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.withColumn(
        "_first",
        F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key"))
    # null-safe: a missing stratum is one of its own
    renamed = first.select(*[F.col(c).alias(f"_by_{k}") for k, c in enumerate([*by, "_part"])], "_first")
    same = F.lit(True)
    for k, c in enumerate([*by, "_part"]):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{k}"))
    return keyed.withColumn("_own", own).join(renamed, same).drop(*[f"_by_{k}" for k in range(len(by) + 1)]).withColumn(out, (F.col("_own") - 1 + F.col("_first")).cast("bigint")).drop("_key", "_part", "_own", "_first")


def assign_folds(df: DataFrame, group: str, stratum: str, *, folds: int, repeats: int, seed: int) -> DataFrame:
    """(group, stratum, repeat, fold): whole groups dealt over folds, stratum after stratum.

    Within a repeat each stratum's groups stand in the order of a hash and are
    dealt round robin, from where the stratum before stopped.
    """
    if folds < 2 or repeats < 1:
        raise ValueError("at least two folds and one repeat")
    groups = df.select(F.col(group).cast("string").alias(group), stratum).distinct()
    counts = groups.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    offset = counts.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first(stratum)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    rows = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(group)))
    placed = numbered(rows, ["repeat", stratum], key, "_place").join(F.broadcast(offset.withColumnRenamed(stratum, "_stratum")), F.col(stratum).eqNullSafe(F.col("_stratum")))
    return placed.select(group, stratum, "repeat", ((F.col("_place") + F.col("_offset")) % folds).cast("int").alias("fold"))


def quotas(counts: dict[str, int], fraction: float) -> dict[str, int]:
    """Members of each stratum in a subsample: proportional, at least one, largest remainders first."""
    n = sum(counts.values())
    size = round(fraction * n)
    if size < len(counts):
        raise ValueError("the fraction is too small to keep every stratum")
    ideal = {k: size * v / n for k, v in counts.items()}
    out = {k: max(1, int(ideal[k])) for k in counts}
    while sum(out.values()) != size:
        more = sum(out.values()) < size
        open_ = [k for k in counts if (out[k] < counts[k] if more else out[k] > 1)]
        best = max(open_, key=lambda k: (ideal[k] - out[k]) * (1 if more else -1))
        out[best] += 1 if more else -1
    return out


@dataclass(frozen=True)
class Subsamples:
    """Stratified samples of groups without replacement, as thresholds on a hash.

    A group is in a resample if its key is at most the resample's threshold
    of its stratum, so that any row can tell by itself; ``cutoffs`` is a row
    a resample and stratum.
    """

    group: str
    stratum: str
    n: int
    seed: int
    cutoffs: DataFrame

    def spread(self, df: DataFrame) -> DataFrame:
        """``df``'s rows once for each ``resample`` that they are in; no row is shuffled."""
        rows = _keyed(df, self.group, self.n, self.seed)
        few = F.broadcast(self.cutoffs.withColumnsRenamed({self.stratum: "_stratum", "resample": "_resample"}))
        same = (F.col(self.stratum) == F.col("_stratum")) & (F.col("resample") == F.col("_resample")) & (F.col("_key") <= F.col("_cutoff"))
        return rows.join(few, same).drop("_key", "_stratum", "_resample", "_cutoff")

    def moments(self, df: DataFrame, names: Sequence[str], scale: Scale) -> Moments:
        """:func:`moments` of each resample, without a row for each that a row is in.

        A batch's products are multiplied by its rows' 0/1 columns of the
        resamples; a task sends one row of sums a resample.
        """
        n, seed, ends = self.n, self.seed, {}
        for r in self.cutoffs.collect():
            ends.setdefault(r[self.stratum], [""] * n)[r["resample"]] = r["_cutoff"]
        p = len(names) + 1
        i, j = np.triu_indices(p)
        rows = df.dropna(subset=list(names)).where(F.col(self.stratum).isNotNull())
        z = rows.select(F.col(self.group).cast("string").alias("_group"), F.col(self.stratum).alias("_stratum"), *[scale.apply(c).alias(f"z{k}") for k, c in enumerate(names)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n, len(i)))
            for b in batches:
                own = np.zeros((n, b.num_rows))
                for k, (g, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if t in ends:
                        # as concat_ws does, without a group that is missing
                        tail = "" if g is None else f"|{g}"
                        own[:, k] = [md5(f"{seed}|{r}{tail}".encode()).hexdigest() <= end for r, end in enumerate(ends[t])]
                v = np.column_stack([np.ones(b.num_rows), *[c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]])
                sums += own @ (v[:, i] * v[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(c) for c in sums.T.copy()]], names=["resample", *places])

        places = [f"g{a}_{b}" for a, b in zip(i, j)]
        parts = z.mapInArrow(run, ", ".join(["resample int", *[f"{c} double" for c in places]]))
        grams = {}
        for r in parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in places]).collect():
            if r["g0_0"]:
                g = np.zeros((p, p))
                g[i, j] = g[j, i] = [r[c] for c in places]
                grams[(r["resample"],)] = g
        return Moments(scale, grams)

    def members(self, df: DataFrame) -> DataFrame:
        """(group, stratum, resample) of the samples."""
        return self.spread(df.select(F.col(self.group).cast("string").alias(self.group), self.stratum).distinct())


def _keyed(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("resample"))
    return rows.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), F.col(group).cast("string"))))


def subsamples(df: DataFrame, group: str, stratum: str, *, fraction: float, n: int, seed: int) -> Subsamples:
    """Of each stratum its quota of groups, those of the smallest keys; a missing stratum takes no part.

    Keys are counted in 4,096 parts by their first digits; the part in which
    a quota ends is the only one that is sorted.
    """
    groups = df.select(F.col(group).cast("string").alias(group), stratum).distinct()
    counts = {r[0]: r[1] for r in groups.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    table = F.broadcast(df.sparkSession.createDataFrame(list(quotas(dict(sorted(counts.items())), fraction).items()), f"`{stratum}` string, _quota int"))
    rows = _keyed(groups, group, n, seed).withColumn("_part", F.substring("_key", 1, 3))
    by = ["resample", stratum]
    sizes = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sizes.withColumn("_end", F.sum("_n").over(up_to)).join(table, stratum).where((F.col("_end") >= F.col("_quota")) & (F.col("_end") - F.col("_n") < F.col("_quota")))
    last = ends.select(*by, "_part", (F.col("_quota") - F.col("_end") + F.col("_n")).alias("_left"))
    inside = rows.join(F.broadcast(last), [*by, "_part"]).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_key")))
    return Subsamples(group, stratum, n, seed, inside.where(F.col("_place") == F.col("_left")).select(*by, F.col("_key").alias("_cutoff")))


@dataclass(frozen=True)
class Tuning:
    ratios: tuple[float, ...]
    scores: np.ndarray
    mean: np.ndarray
    error: np.ndarray
    best: int

    @property
    def ratio(self) -> float:
        return self.ratios[self.best]


def tune(
    df: DataFrame, folds: DataFrame, outcome: str, base_names: Sequence[str], names: Sequence[str], *, group: str = "member_id",
    ratios: Sequence[float] = RATIOS, rule: str = "one_standard_error", scale: Scale | None = None
) -> Tuning:
    """Test MSE of each ratio by grouped folds: one aggregation by (repeat, fold).

    A fold's training moments are its repeat's total less its own.  The rule
    takes the best ratio (``minimum``), or the largest within one standard
    error of it; ties go to the larger ratio.
    """
    if rule not in ("minimum", "one_standard_error"):
        raise ValueError("unknown rule")
    own = [*base_names, *names, outcome]
    joined = df.withColumn(group, F.col(group).cast("string")).join(folds.select(group, "repeat", "fold"), group)
    m = moments(joined, own, by=["repeat", "fold"], scale=scale or Scale.of(df.dropna(subset=own), own))
    keys = sorted(m.grams)
    totals = {r: sum(g for k, g in m.grams.items() if k[0] == r) for r in {k[0] for k in keys}}
    scores = np.zeros((len(keys), len(ratios)))
    for i, key in enumerate(keys):
        train, test = totals[key[0]] - m.grams[key], m.grams[key]
        for j, ratio in enumerate(ratios):
            scores[i, j] = test_mse(solve_lasso(train, m, outcome, base_names, names, ratio), test, m, outcome)
    mean = scores.mean(0)
    error = scores.std(0, ddof=1) / np.sqrt(len(keys)) if len(keys) > 1 else np.zeros(len(ratios))
    r = np.asarray(ratios)
    ties = np.flatnonzero(np.isclose(mean, mean.min(), rtol=1e-12, atol=1e-15))
    best = int(ties[np.argmax(r[ties])])
    if rule == "one_standard_error":
        near = np.flatnonzero(mean <= mean[best] + error[best])
        best = int(near[np.argmax(r[near])])
    return Tuning(tuple(ratios), scores, mean, error, best)


def test_mse(fit: Lasso, gram: np.ndarray, m: Moments, outcome: str) -> float:
    """Mean squared error on the rows of a Gram."""
    names = [*fit.base_names, *fit.names]
    order = [m.scale.names.index(x) for x in names]
    b = np.concatenate([[fit.base[0]], fit.base[1:], fit.coefficients])
    k = m.scale.names.index(outcome)
    v = np.zeros(len(gram))
    v[0] = m.scale.mean[k] - b[0] - b[1:] @ m.scale.mean[order]
    v[m.at(*names)] = -b[1:] * m.scale.sd[order]
    v[m.at(outcome)[0]] += m.scale.sd[k]
    return float(v @ gram @ v / gram[0, 0])


test_mse.__test__ = False  # not a test


def stability(
    df: DataFrame, samples: Subsamples, outcome: str, base_names: Sequence[str], names: Sequence[str], ratio: float, *,
    least: float = 1e-12, scale: Scale | None = None
) -> tuple[dict[str, int], int]:
    """How many subsamples select each candidate (a standardised coefficient beyond ``least``), and their number.

    Every row is added to its resamples' sums where it stands; what is
    shuffled are these sums.
    """
    own = [*base_names, *names, outcome]
    rows = df.dropna(subset=own)
    m = samples.moments(rows, own, scale or Scale.of(rows, own))
    counts = dict.fromkeys(names, 0)
    for gram in m.grams.values():
        for n, t in zip(names, solve_lasso(gram, m, outcome, base_names, names, ratio).theta):
            counts[n] += abs(t) > least
    return {k: int(v) for k, v in counts.items()}, len(m.grams)
