"""One regression for each event type, all from two grouped aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import two_sided_p, z_value
from ..operators.features import MOST_TYPES
from .moments import moments

SCHEMA = "event_type string, n_reached bigint, test_status string, estimate double, standard_error double, test_statistic double, p_value double, ci_lower double, ci_upper double"


def activity_associations(
    members: DataFrame, counts: DataFrame, types: DataFrame, names: Sequence[str], *, outcome: str = "percentage_loss", baseline: str = "first_weight",
    days: str = "weight_days", least_reach: int = 30
) -> DataFrame:
    """Percentage loss on baseline, ``names``, centred days and their square, and the event's standardised log count.

    ``counts`` holds the members' counts of the event types that they have;
    those of others are 0.  HC3, normal reference.  Types that fewer than
    ``least_reach`` members reached are not tested; those whose columns are
    collinear are not estimable.

    The members' moments are the same for all types, and of a log count only
    what is not 0 adds to its sums, so all regressions come from the members
    and the counts, once each.  Only the HC3 weights differ for every member
    and type: each member carries its counts as a map, meets the tested types
    in place, and adds its part to the types' sums.
    """
    spark = members.sparkSession
    day = members.agg(F.avg(days)).first()[0] or 0.0
    base = [baseline, *names, "_days", "_days2"]
    own = members.select("member_id", outcome, baseline, *names, (F.col(days) - F.lit(float(day))).alias("_days")).withColumn("_days2", F.col("_days") ** 2)
    own = own.dropna(subset=[outcome, *base])
    m = moments(own, [*base, outcome])
    total, scale, p = m.total, m.scale, len(base) + 2
    columns = [F.lit(1.0), *[scale.apply(c) for c in [*base, outcome]]]
    log = F.log1p(F.col("event_count").cast("double"))
    held = counts.where("event_count > 0").select("member_id", "event_type", log.alias("_log"))
    sums = [F.sum(F.col("_log") * c).alias(f"s{k}") for k, c in enumerate(columns)]
    rows = held.join(own, "member_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_log") ** 2).alias("square"), *sums).collect()
    told = {r["event_type"]: r for r in rows}
    known = [r[0] for r in types.select("event_type").distinct().limit(MOST_TYPES + 1).collect()]
    if len(known) > MOST_TYPES:
        raise ValueError(f"over {MOST_TYPES} event types: the column is no vocabulary")
    reach = {k: told[k]["n"] if k in told else 0 for k in known}
    x, y = [*range(p - 1), p], p - 1
    solved: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    status: dict[str, str] = {}
    unit: dict[str, tuple[float, float]] = {}
    n = total[0, 0]
    for event in known:
        if reach[event] < least_reach:
            status[event] = "insufficient_reach"
            continue
        r = told[event]
        across, square = np.array([r[f"s{k}"] for k in range(p)]), r["square"]
        mean = across[0] / n
        sd = math.sqrt(max(square / n - mean**2, 0.0))
        g = np.zeros((p + 1, p + 1))
        g[:p, :p] = total
        # the log count, centred and scaled over all members
        g[p, :p] = g[:p, p] = (across - mean * total[0]) / (sd or 1.0)
        g[p, p] = (square - n * mean**2) / (sd**2 or 1.0)
        a = g[np.ix_(x, x)]
        if n <= len(x) or np.linalg.matrix_rank(a, tol=1e-9 * a.max()) < len(x):
            status[event] = "not_estimable"
        else:
            status[event] = "tested"
            solved[event] = (np.linalg.solve(a, g[x, y]), np.linalg.inv(a))
            unit[event] = (mean, sd)
    meats: dict[str, np.ndarray] = {}
    if solved:
        table = F.array(*[
            F.struct(
                F.lit(e).alias("event_type"), F.lit(unit[e][0]).alias("mean"), F.lit(unit[e][1]).alias("sd"),
                F.array(*[F.lit(float(v)) for v in b]).alias("b"), F.array(*[F.lit(float(v)) for v in i.ravel()]).alias("i")
            ) for e, (b, i) in solved.items()
        ])
        maps = held.groupBy("member_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "_log"))).alias("_logs"))
        met = own.join(maps, "member_id", "left").select(F.array(*columns[:-1]).alias("_x"), columns[-1].alias("_y"), "_logs", F.explode(table).alias("_t"))
        raw = F.coalesce(F.try_element_at("_logs", F.col("_t.event_type")), F.lit(0.0))
        z = F.concat("_x", F.array((raw - F.col("_t.mean")) / F.col("_t.sd")))
        k = len(x)
        met = met.select(F.col("_t.event_type").alias("event_type"), F.col("_t.b").alias("b"), F.col("_t.i").alias("i"), z.alias("z"), "_y")
        fitted = sum((F.col("b")[j] * F.col("z")[j] for j in range(1, k)), F.col("b")[0] * F.col("z")[0])
        h = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                h = h + F.col("i")[i * k + j] * F.col("z")[i] * F.col("z")[j]
        met = met.withColumn("w", ((F.col("_y") - fitted) / (1 - h)) ** 2)
        places = [(i, j) for i in range(k) for j in range(i, k)]
        for r in met.groupBy("event_type").agg(*[F.sum(F.col("w") * F.col("z")[i] * F.col("z")[j]).alias(f"g{i}_{j}") for i, j in places]).collect():
            g = np.zeros((k, k))
            for i, j in places:
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
            meats[r["event_type"]] = g
    out = []
    for event in sorted(status):
        if status[event] != "tested":
            out.append((event, reach.get(event, 0), status[event], None, None, None, None, None, None))
            continue
        b, inverse = solved[event]
        cov = inverse @ meats[event] @ inverse
        # the coefficient is per sample standard deviation of the log count
        per = scale.sd[-1] * math.sqrt(n / (n - 1))
        estimate, se = b[-1] * per, math.sqrt(cov[-1, -1]) * per
        t, z95 = estimate / se, z_value()
        out.append((event, reach[event], "tested", float(estimate), float(se), float(t), two_sided_p(t), float(estimate - z95 * se), float(estimate + z95 * se)))
    return spark.createDataFrame(out, SCHEMA)
