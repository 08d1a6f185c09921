"""Second moments of named columns, by one aggregation, as small matrices on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Beyond these a column's squares may leave the range of doubles.
LARGE, SMALL = 1e100, 1e-100


def require_finite(what: str, *values: object) -> None:
    """Fails on a number that is not finite: what was fitted can't be represented."""
    if not all(np.isfinite(np.asarray(v, float)).all() for v in values):
        raise ValueError(f"{what} is not finite: the columns' values overflow")


@dataclass(frozen=True)
class Scale:
    """Means and population standard deviations of columns; ``apply`` centres and scales them.

    Moments are of such columns, so that squares of large values do not
    swallow small ones.  A constant column keeps its scale of 1.  Columns of
    extreme size are multiplied by ``unit``, a power of two, before anything
    is added up or squared.
    """

    names: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    unit: np.ndarray | None = None

    @classmethod
    def of(cls, df: DataFrame, names: Sequence[str]) -> Scale:
        """One pass; a second one for columns whose values are extreme, which the first one tells."""
        most, mean, sd = cls._told(df, names, np.ones(len(names)))
        unit = np.ones(len(names))
        with np.errstate(all="ignore"):
            far = np.flatnonzero((most > LARGE) | ((most > 0) & (most < SMALL)))
        if len(far):
            require_finite("a column", most)
            # unit times the largest value lies between 1/2 and 1; two factors, as one may overflow
            unit[far] = np.exp2(np.clip(-np.frexp(most[far])[1], -1022, 1022))
            some = [names[k] for k in far]
            own, mean[far], sd[far] = cls._told(df, some, unit[far])
            low, high = cls._ends(df, some)
            with np.errstate(over="ignore"):
                mean[far], sd[far] = mean[far] / unit[far], sd[far] / unit[far]
                require_finite("a centred column", mean, sd, high - mean[far], low - mean[far])
        tiny = sd <= np.finfo(float).eps * 100 * most
        return cls(tuple(names), mean, np.where(tiny, 1 / unit, sd), unit if len(far) else None)

    @staticmethod
    def _told(df: DataFrame, names: Sequence[str], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest absolute value, mean and population standard deviation of the columns times ``unit``."""
        own = [F.col(c).cast("double") if u == 1 else F.col(c).cast("double") * F.lit(float(u)) for c, u in zip(names, unit)]
        aggs = [a for v in own for a in (F.max(F.abs(v)), F.avg(v), F.stddev_pop(v))]
        row = df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()
        return tuple(np.array([row[3 * k + j] or 0.0 for k in range(len(names))]) for j in range(3))

    @staticmethod
    def _ends(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{f.__name__}") for k, c in enumerate(names) for f in (F.min, F.max)]).first()
        return np.array([row[2 * k] for k in range(len(names))]), np.array([row[2 * k + 1] for k in range(len(names))])

    def of_names(self, names: Sequence[str]) -> Scale:
        """The scale of some of the columns."""
        at = [self.names.index(n) for n in names]
        return Scale(tuple(names), self.mean[at], self.sd[at], None if self.unit is None else self.unit[at])

    def apply(self, name: str) -> Column:
        k = self.names.index(name)
        v, u = F.col(name).cast("double"), 1.0 if self.unit is None else float(self.unit[k])
        return ((v if u == 1 else v * F.lit(u)) - F.lit(float(self.mean[k]) * u)) / F.lit(float(self.sd[k]) * u)

    def back(self) -> np.ndarray:
        """T with raw coefficients = T @ scaled ones, the intercept first."""
        n = len(self.names)
        out = np.eye(n + 1)
        out[np.arange(1, n + 1), np.arange(1, n + 1)] = 1 / self.sd
        out[0, 1:] = -self.mean / self.sd
        return out


@dataclass(frozen=True)
class Moments:
    """Gram matrices of (1, columns...), one for each key; ``total`` is their sum."""

    scale: Scale
    grams: dict[tuple, np.ndarray]

    @property
    def total(self) -> np.ndarray:
        return sum(self.grams.values(), np.zeros((len(self.scale.names) + 1,) * 2))

    def without(self, key: tuple) -> np.ndarray:
        return self.total - self.grams[key]

    def at(self, *names: str) -> list[int]:
        return [0 if n == "1" else 1 + self.scale.names.index(n) for n in names]


def moments(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), scale: Scale | None = None, weight: Column | None = None) -> Moments:
    """Grams of centred and scaled columns, by key; rows with a missing value take no part.

    One aggregation of p (p + 1) / 2 sums for p columns.
    """
    whole = df.dropna(subset=list(names))
    scale = scale or Scale.of(whole, names)
    w = F.lit(1.0) if weight is None else weight
    z = [F.lit(1.0), *[scale.apply(n) for n in names]]
    p = len(z)
    sums = [F.sum(w * z[i] * z[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    rows = whole.groupBy(*by).agg(*sums).collect() if by else whole.agg(*sums).collect()
    grams = {}
    for r in rows:
        if r["g0_0"] is None:
            continue
        g = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        grams[tuple(r[b] for b in by)] = g
    return Moments(scale, grams)


#: Groups of R factors at each step up the tree.
TREE = (1024, 32, 1)


def tall_qr(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """R of the QR decomposition of (rows x columns): each task's R, combined up a tree on the executors.

    The driver gets one R.  A step combines at most 32 factors, the first one
    a thousandth of the tasks'.
    """
    n = len(columns)
    names = [f"c{k}" for k in range(n)]
    named = df.select(*[c.cast("double").alias(k) for c, k in zip(columns, names)]).dropna()

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, n))
        for f in frames:
            r = np.linalg.qr(np.concatenate([r, f.to_numpy()]), mode="r")
        if len(r):
            yield pd.DataFrame(r, columns=names).assign(g=TaskContext.get().partitionId())

    def combined(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(np.linalg.qr(f[names].to_numpy(), mode="r"), columns=names).assign(g=int(f["g"].iloc[0]))

    schema = ", ".join([*(f"{k} double" for k in names), "g int"])
    parts = named.mapInPandas(local, schema)
    for groups in TREE:
        parts = parts.withColumn("g", F.col("g") % groups).groupBy("g").applyInPandas(combined, schema)
    rows = parts.select(*names).collect()
    # the rows of one triangle, in whatever order they come
    return np.linalg.qr(np.array(rows, float), mode="r") if rows else np.zeros((0, n))


@dataclass(frozen=True)
class Collinearity:
    names: tuple[str, ...]
    singular_values: tuple[float, ...]
    rank: int
    null_space: tuple[tuple[float, ...], ...]

    @property
    def condition_number(self) -> float:
        return self.singular_values[0] / self.singular_values[-1] if self.singular_values[-1] else float("inf")


def diagnose_collinearity(df: DataFrame, columns: Sequence[Column], names: Sequence[str]) -> Collinearity:
    """Singular values, rank (to the tolerance max(shape) * eps * largest) and the right null space."""
    n_rows = df.count()
    _, s, vt = np.linalg.svd(tall_qr(df, columns))
    s = np.concatenate([s, np.zeros(len(names) - len(s))])
    tolerance = max(n_rows, len(names)) * np.finfo(float).eps * (s[0] if len(s) else 0)
    rank = int((s > tolerance).sum())
    return Collinearity(tuple(names), tuple(s.tolist()), rank, tuple(map(tuple, vt[rank:].tolist())))
