"""Paired cross-validation of the two base models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lasso import assign_folds
from .models import gls_columns, solve_gls, solve_ols
from .moments import moments

GLS_MODEL = "longitudinal_log_gls"
OLS_MODEL = "percentage_loss_ols"


def base_model_cv(df: DataFrame, types: Sequence[str], *, folds: int, repeats: int, seed: int, group: str = "member_id", stratum: str = "member_type") -> DataFrame:
    """(repeat, fold, model, n_test, rmse, mae) of both models' predicted last weights on the same folds.

    Training moments are the repeat's total less the fold's; the fitted
    coefficients are a relation of one row a fold, joined to the test rows.
    """
    plan = assign_folds(df, group, stratum, folds=folds, repeats=repeats, seed=seed)
    rows = gls_columns(df.withColumn(group, F.col(group).cast("string")), "log").join(plan.select(group, "repeat", "fold"), group)
    names = ["first_weight", *types, "percentage_loss", "_y0", "_d"]
    m = moments(rows, names, by=["repeat", "fold"])
    totals: dict[int, np.ndarray] = {}
    for (r, _), g in m.grams.items():
        totals[r] = totals.get(r, 0) + g
    fitted = []
    for (r, k), g in sorted(m.grams.items()):
        train = totals[r] - g
        ols = solve_ols(train, m, "percentage_loss", ["first_weight", *types])
        gls = solve_gls(train, m, types, scale_name="log", structure="compound_symmetry", interaction=False, jacobian=0.0)
        fitted.append((r, k, ols.coefficients.tolist(), gls.beta.tolist(), float(gls.delta[0]), gls.v01 / gls.v00, 0.5 * (gls.v11 - gls.v01**2 / gls.v00)))
    table = df.sparkSession.createDataFrame(fitted, "repeat int, fold int, _ols array<double>, _beta array<double>, _delta double, _slope double, _half double")
    test = rows.join(F.broadcast(table), ["repeat", "fold"])
    loss = sum((F.col("_ols")[2 + i] * F.col(t) for i, t in enumerate(types)), F.col("_ols")[0] + F.col("_ols")[1] * F.col("first_weight"))
    mean0 = sum((F.col("_beta")[1 + i] * F.col(t) for i, t in enumerate(types)), F.col("_beta")[0])
    gls_last = F.exp(mean0 + F.col("_delta") + F.col("_slope") * (F.col("_y0") - mean0) + F.col("_half"))
    both = F.array(F.struct(F.lit(GLS_MODEL).alias("model"), gls_last.alias("p")), F.struct(F.lit(OLS_MODEL).alias("model"), (F.col("first_weight") * (1 - loss / 100)).alias("p")))
    e = F.col("last_weight") - F.col("p")
    return test.select("repeat", "fold", "last_weight", F.inline(both)).groupBy("repeat", "fold", "model").agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def winner(scores: DataFrame) -> str:
    """Least mean RMSE, then least mean MAE, then percentage-loss OLS; exact comparisons."""
    means = scores.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    return means.orderBy("rmse", "mae", F.when(F.col("model") == OLS_MODEL, 0).otherwise(1), "model").first()["model"]
