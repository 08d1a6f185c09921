"""The longitudinal design, whitened by a fitted covariance, and its exploratory LASSO."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lasso import Lasso, solve_lasso
from .models import Gls, fit_gls
from .moments import moments, tall_qr

#: The exploratory fit's fixed share of the largest penalty.
RATIO = 0.2


def require_same_fit(df: DataFrame, gls: Gls) -> None:
    """Fail unless the model is the one that these members give: a covariance of others must not whiten them."""
    again = fit_gls(df, list(gls.names), scale_name=gls.scale_name, structure=gls.structure, interaction=bool(gls.change_names))
    same = again.n == gls.n and all(
        np.allclose(a, b, rtol=1e-10, atol=1e-10) for a,
        b in ((again.beta, gls.beta), (again.delta, gls.delta), ((again.v00, again.v01, again.v11), (gls.v00, gls.v01, gls.v11)))
    )
    if not same:
        raise ValueError("the model must have been fitted to the same members")


def whitened(df: DataFrame, gls: Gls, candidates: Sequence[str], *, group: str = "member_id", stratum: str = "member_type") -> DataFrame:
    """Two rows a member: group, stratum, occasion, outcome and the design's columns, times the inverse Cholesky factor.

    ``time`` and the model's types (and their products with time, if the model
    has them) and each candidate's main effect are the base, beside an
    intercept; ``time:candidate`` are the candidates.  Members with a missing
    value take no part.
    """
    v = np.array([[gls.v00, gls.v01], [gls.v01, gls.v11]])
    low = np.linalg.inv(np.linalg.cholesky(v))
    first, last = (F.col(c).cast("double") for c in ("first_weight", "last_weight"))
    y = (F.log(first), F.log(last)) if gls.scale_name == "log" else (first, last)
    zero, one = F.lit(0.0), F.lit(1.0)
    pairs: dict[str, tuple[Column, Column]] = {"outcome": y, "intercept": (one, one), "time": (zero, one)}
    for t in gls.names:
        pairs[t] = (F.col(t).cast("double"),) * 2
    for t in gls.change_names:
        pairs[f"time:{t}"] = (zero, F.col(t).cast("double"))
    for c in candidates:
        pairs[c] = (F.col(c).cast("double"),) * 2
    for c in candidates:
        pairs[f"time:{c}"] = (zero, F.col(c).cast("double"))
    rows = [
        F.struct(F.lit(occasion).alias("occasion"), *[(F.lit(float(low[k, 0])) * a + (F.lit(float(low[k, 1])) * b if k else zero)).alias(n) for n, (a, b) in pairs.items()])
        for k, occasion in enumerate(("first", "last"))
    ]
    whole = df.dropna(subset=["first_weight", "last_weight", *gls.names, *candidates])
    return whole.select(group, stratum, F.inline(F.array(*rows)))


def estimable(rows: DataFrame, base: Sequence[str], candidates: Sequence[str]) -> list[str]:
    """The candidates, in order, whose main effect raises the rank of the columns before it."""
    names = [*base, *candidates]
    r = tall_qr(rows, [F.col(f"`{n}`") for n in names])
    n = rows.count()

    def rank(columns: list[int]) -> int:
        s = np.linalg.svd(r[:, columns], compute_uv=False)
        return int((s > max(n, len(columns)) * np.finfo(float).eps * s[0]).sum()) if len(s) and s[0] > 0 else 0

    kept, own = [], list(range(len(base)))
    for k in range(len(base), len(names)):
        if rank([*own, k]) > rank(own):
            own.append(k)
            kept.append(names[k])
    return kept


def longitudinal_lasso(df: DataFrame, gls: Gls, candidates: Sequence[str], ratio: float = RATIO) -> tuple[Lasso, list[str]]:
    """(fit, kept candidates): time by candidate penalised, everything else not.

    The covariance is that of the whole sample and is not fitted again, so the
    fit is exploratory: it claims no significance and no performance.
    Candidates that are constant or aliased are left out with their products.
    """
    require_same_fit(df, gls)
    rows = whitened(df, gls, candidates)
    base = ["time", *gls.names, *[f"time:{t}" for t in gls.change_names]]
    kept = estimable(rows, ["intercept", *base], candidates)
    if not kept:
        raise ValueError("no candidate is estimable")
    # the constant that moments add spans, with time, what the whitened intercept does
    own = [*base, *kept, *[f"time:{c}" for c in kept], "outcome"]
    plain = rows.select(*[F.col(f"`{n}`").alias(n.replace(":", "__")) for n in own])
    own = [n.replace(":", "__") for n in own]
    m = moments(plain, own)
    fit = solve_lasso(m.total, m, "outcome", own[: len(base) + len(kept)], own[len(base) + len(kept) : -1], ratio)
    return fit, kept


def exploratory_records(df: DataFrame, gls: Gls, candidates: Sequence[str], ratio: float = RATIO) -> list[dict]:
    """A row a candidate: its coefficient (0 if it is left out or shrunk to that) and whether it is selected."""
    fit, kept = longitudinal_lasso(df, gls, candidates, ratio)
    own = dict(zip(kept, zip(fit.coefficients, fit.theta)))
    return [dict(variable=f"time:{c}", count=int(abs(own[c][1]) > 1e-12) if c in own else 0, value=float(own[c][0]) if c in own else 0.0, estimable=c in own) for c in candidates]
