"""Literal values, invariants and brute-force versions for the cohort engine."""

from __future__ import annotations

import json
import math
import os
import shutil
from dataclasses import replace
from types import SimpleNamespace
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import stats
from cohortspark.functions.quantiles import aggregate_with_quantiles
from cohortspark.operators import cohort as c
from cohortspark.operators import describe as d
from cohortspark.operators import features as f
from cohortspark.operators.quality import key_quality, require_keys
from cohortspark.plans import analysis, catalog, contract, evidence, figures, lasso, longitudinal, models, moments, publish, store
from cohortspark.plans.schemas import SCHEMAS
from cohortspark.sources.extracts import MODULES, load_study, read_extract

from .study import TREATED, write_study

RULES = c.Rules()
CLASSES = {"WEIGHT": "member_behavior", "MEAL": "member_behavior", "LOGIN": "clinical_or_administrative"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("extracts")
    write_study(path)
    return path


@pytest.fixture(scope="module")
def study(spark, folder):
    return load_study(spark, str(folder))


def test_wilson():
    assert stats.wilson_interval(5, 10) == pytest.approx((0.236593, 0.763407), abs=1e-6)
    assert all(map(math.isnan, stats.wilson_interval(0, 0)))
    with pytest.raises(ValueError):
        stats.wilson_interval(3, 2)


def test_summary_and_fdr(spark):
    row = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "value double")
    row = d.summarize(row, []).first()
    assert (row["n_total"], row["n_observed"], row["n_missing"]) == (5, 4, 1)
    assert [row[k] for k in ("standard_deviation", "q1", "median", "q3")] == pytest.approx([1.290994449, 1.75, 2.5, 3.25])
    tests = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    got = {r["k"]: r["fdr_adjusted_p_value"] for r in stats.adjust_p(tests, "p").collect()}
    assert got[4] is None and [got[k] for k in (1, 2, 3)] == pytest.approx([0.03, 0.04, 0.04])


def test_extracts_are_strict(spark, folder, tmp_path):
    rows = read_extract(spark, str(folder / MODULES.filename), MODULES)
    assert rows.columns == ["member_id", "questionnaire_title", "answered_at"] and rows.where("answered_at is null").count() == 0
    with pytest.raises(FileNotFoundError):
        load_study(spark, str(tmp_path))
    (tmp_path / MODULES.filename).write_text("Readable Id\tx\n1\t2\n", encoding="utf-16")
    with pytest.raises(ValueError, match="Questionnaire"):
        read_extract(spark, str(tmp_path / MODULES.filename), MODULES)
    header = "\t".join(MODULES.columns)
    (tmp_path / MODULES.filename).write_text(f"{header}\na\tb\tnot a day\n", encoding="utf-16")
    with pytest.raises(Exception, match="not a date"):
        read_extract(spark, str(tmp_path / MODULES.filename), MODULES).collect()


def test_funnel_reconciles(study):
    counts = {r["stage"]: r["n"] for r in c.stage_counts(study, RULES).collect()}
    assert sum(counts.values()) == study.demographics.count() == 64
    assert counts == {0: 58, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1} | {0: counts[0]}
    assert counts[0] == 64 - sum(counts[k] for k in range(1, 8))
    flow = c.cohort_flow(study, RULES).orderBy("flow_order").collect()
    assert flow[-1]["retained_n"] == counts[0] == c.members(study, RULES).count()
    assert c.orphan_weights(study).count() == 1
    assert c.excluded_types(study, RULES).first()["member_type"] == "Null"
    assert c.long_weights(c.members(study, RULES)).count() == 2 * counts[0]


def test_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (" ",), (" b",)], "k string")
    assert tuple(key_quality(df, "k").first()) == (5, 1, 1, 2, 2)
    with pytest.raises(ValueError):
        require_keys(df, "k", "x")


def test_classification_ignores_the_cohort_and_cutoff_is_inclusive(spark):
    events = [(f"m{k}", "2024-01-01", "often") for k in range(30) for _ in range(2)] + [(f"m{k}", "2024-01-01", "few") for k in range(29) for _ in range(2)] + [("m0", "2024-01-05", "often"), ("m0", None, "often")]
    engagement = spark.createDataFrame(events, "member_id string, activity_at string, event_type string").withColumn("activity_at", F.to_timestamp("activity_at").cast("timestamp_ntz"))
    types = {r["event_type"]: r["is_repeatable"] for r in f.classify_events(engagement, RULES).collect()}
    assert types == {"often": True, "few": False}
    cohort = spark.createDataFrame([("m0", "2024-01-01", 3.0)], "member_id string, last_weight_at string, tenure_days double").withColumn("last_weight_at", F.to_timestamp("last_weight_at").cast("timestamp_ntz"))
    audit = f.cutoff_audit(engagement, cohort, "activity_at").first()
    assert (audit["cohort_rows"], audit["kept_rows"], audit["late_rows"], audit["undated_rows"]) == (6, 4, 1, 1)
    row = f.engagement_features(cohort, f.event_counts(engagement, cohort, RULES), RULES).first()
    assert (row["engagement_breadth"], row["engagement_volume_repeatable"]) == (2, 2)
    assert row["engagement_volume_repeatable_rate"] == pytest.approx(2 / 7)


def test_module_titles(spark):
    titles = ["01_a", "05_a", "12_a", "02_a", "13_a", "MINDSET W01: x", "MINDSET W05: x", "x MINDSET W01: x", "NUTRITION W04: y", "PHYSICAL ACTIVITY W02: z", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(f.module_domain(F.col("t"), RULES)).collect()]
    assert got == ["core", "core", "core", None, None, "mindset", None, None, "nutrition", "physical_activity", None]


def test_event_classes_fail_closed(spark):
    types = spark.createDataFrame([("a",), (None,)], "event_type string")
    with pytest.raises(ValueError):
        d.classify_strictly(types, {"a": "x"})
    with pytest.raises(ValueError):
        d.classify_strictly(types.where("event_type is not null"), {"a": "x", "b": "y"})


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(80):
        g, w = k % 2, 150 + rng.normal(0, 20)
        z = rng.normal(size=3)
        y = 2 + 0.05 * w + 3 * g + 2.5 * z[0] + rng.normal()
        rows.append((f"m{k:02d}", "AB"[g], float(g), float(w), float(w * (1 - y / 100)), float(y), *map(float, z), 7.0))
    return spark.createDataFrame(rows, "member_id string, member_type string, g double, w double, last double, y double, z0 double, z1 double, z2 double, c double")


def test_ols_and_hc3(points):
    fit = models.fit_ols(points, "y", ["w", "g"])
    p = points.toPandas()
    x, y = np.column_stack([np.ones(len(p)), p.w, p.g]), p.y.to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e, inv = y - x @ b, np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    assert fit.coefficients == pytest.approx(b) and fit.rss == pytest.approx(e @ e)
    assert fit.hc3(points) == pytest.approx(inv @ (x.T * (e / (1 - h)) ** 2 @ x) @ inv)
    got = fit.with_diagnostics(points).agg(F.max("leverage"), F.max("cooks_distance")).first()
    s2 = e @ e / (len(p) - 3)
    assert got[0] == pytest.approx(h.max()) and got[1] == pytest.approx((e**2 / s2 / (1 - h) * h / (1 - h) / 3).max())
    with pytest.raises(ValueError):
        models.fit_ols(points, "y", ["w", "c"])


@pytest.mark.parametrize("structure", list(models.COVARIANCES))
@pytest.mark.parametrize("interaction", [False, True])
def test_gls_is_the_maximum(points, structure, interaction):
    own = points.select("g", F.col("w").alias("first_weight"), F.col("last").alias("last_weight"))
    fit = models.fit_gls(own, ["g"], structure=structure, interaction=interaction)
    p = own.toPandas()
    y = p[["first_weight", "last_weight"]].to_numpy()

    def log_l(beta, delta, v):
        m0 = beta[0] + beta[1] * p.g
        m1 = m0 + delta[0] + (delta[1] * p.g if interaction else 0)
        r = y - np.column_stack([m0, m1])
        return -0.5 * (np.einsum("ij,jk,ik->", r, np.linalg.inv(v), r) + len(r) * (math.log(np.linalg.det(v)) + 2 * math.log(2 * math.pi)))

    v = np.array([[fit.v00, fit.v01], [fit.v01, fit.v11]])
    best = log_l(fit.beta, fit.delta, v)
    assert best == pytest.approx(fit.log_likelihood, rel=1e-9)
    for k in range(2):
        for step in (-0.01, 0.01):
            assert log_l(fit.beta + step * np.eye(2)[k], fit.delta, v) < best
    assert log_l(fit.beta, fit.delta * 1.001, v) < best
    for scale in (0.99, 1.01):
        assert log_l(fit.beta, fit.delta, v * scale) < best
    assert fit.parameters == 2 + (2 if interaction else 1) + models.COVARIANCES[structure]


def test_gls_log_jacobian_and_prediction(points):
    own = points.select("g", F.col("w").alias("first_weight"), F.col("last").alias("last_weight"))
    fit = models.fit_gls(own, ["g"], scale_name="log", structure="compound_symmetry")
    p = own.toPandas()
    assert fit.raw_log_likelihood == pytest.approx(fit.log_likelihood - np.log(p.first_weight).sum() - np.log(p.last_weight).sum())
    m0 = fit.beta[0] + fit.beta[1] * p.g
    mu = m0 + fit.delta[0] + fit.v01 / fit.v00 * (np.log(p.first_weight) - m0)
    expected = np.exp(mu + 0.5 * (fit.v11 - fit.v01**2 / fit.v00))
    got = [r[0] for r in own.select(fit.predicted_last(F.col("first_weight"))).collect()]
    assert sorted(got) == pytest.approx(sorted(expected))


def test_weighted_lasso_literals(spark):
    rows = [(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)]
    df = spark.createDataFrame([(a, b, 4 * a + 2 * b) for a, b in rows], "a double, b double, y double")
    fit = lasso.fit_lasso(df, "y", [], ["a", "b"], 0.25, [2.0, 0.5])
    assert fit.lam_max == pytest.approx(4) and fit.lam == pytest.approx(1)
    assert fit.theta == pytest.approx([2, 1.5]) and fit.objective == pytest.approx(6.875)


def row_lasso(x, z, y, lam):
    """Coordinate descent on rows, for comparison."""
    z = (z - z.mean(0)) / z.std(0)
    q, _ = np.linalg.qr(x)
    z, y = z - q @ (q.T @ z), y - q @ (q.T @ y)
    t = np.zeros(z.shape[1])
    for _ in range(3000):
        for j in range(len(t)):
            r = y - z @ t + z[:, j] * t[j]
            a = z[:, j] @ r / len(y)
            t[j] = np.sign(a) * max(abs(a) - lam, 0) / (z[:, j] @ z[:, j] / len(y))
    return t


def test_lasso_against_rows(points):
    names = ["z0", "z1", "z2", "c"]
    fit = lasso.fit_lasso(points, "y", ["w", "g"], names, 0.2)
    p = points.toPandas()
    assert fit.excluded == ("c",)
    t = row_lasso(np.column_stack([np.ones(len(p)), p.w, p.g]), p[names[:3]].to_numpy(), p.y.to_numpy(), fit.lam)
    assert fit.theta[:3] == pytest.approx(t, abs=1e-9) and fit.theta[3] == 0
    assert fit.lam == pytest.approx(0.2 * fit.lam_max)


def test_longitudinal_lasso_against_whitened_rows(spark):
    rng = np.random.default_rng(6)
    n = 50
    g, z = np.arange(n) % 2, rng.normal(size=(n, 2))
    first = 180 + 10 * g + rng.normal(0, 9, n)
    last = first * np.exp(-0.05 - 0.06 * z[:, 0] + rng.normal(0, 0.03, n))
    rows = [(f"m{k}", "ab"[g[k]], float(first[k]), float(last[k]), float(g[k]), *map(float, z[k]), float(2 * z[k, 0]), 3.0) for k in range(n)]
    df = spark.createDataFrame(rows, "member_id string, member_type string, first_weight double, last_weight double, g double, z0 double, z1 double, twice double, c double")
    gls = models.fit_gls(df, ["g"], scale_name="log", structure="compound_symmetry")
    fit, kept = longitudinal.longitudinal_lasso(df, gls, ["z0", "c", "twice", "z1"])
    assert kept == ["z0", "z1"]
    low = np.linalg.inv(np.linalg.cholesky([[gls.v00, gls.v01], [gls.v01, gls.v11]]))
    block = lambda a, b: (low @ np.stack([a, b])).T.ravel()
    one, zero = np.ones(n), np.zeros(n)
    base = np.column_stack([block(one, one), block(zero, one), block(g, g), block(z[:, 0], z[:, 0]), block(z[:, 1], z[:, 1])])
    t = row_lasso(base, np.column_stack([block(zero, z[:, 0]), block(zero, z[:, 1])]), block(np.log(first), np.log(last)), fit.lam)
    assert fit.theta == pytest.approx(t, abs=1e-8) and abs(fit.theta[0]) > 0.01
    records = longitudinal.exploratory_records(df, gls, ["z0", "c", "twice", "z1"])
    assert [r["estimable"] for r in records] == [True, False, False, True] and records[0]["count"] == 1
    with pytest.raises(ValueError, match="same members"):
        longitudinal.longitudinal_lasso(df.where("member_id <> 'm3'"), gls, ["z0"])


def test_folds_tuning_and_stability(points):
    folds = lasso.assign_folds(points, "member_id", "member_type", folds=4, repeats=2, seed=1)
    got = folds.collect()
    assert len(got) == 160 and len({(r["member_id"], r["repeat"]) for r in got}) == 160
    assert {sum(r["repeat"] == 0 and r["fold"] == k for r in got) for k in range(4)} == {20}
    again = lasso.assign_folds(points.repartition(7), "member_id", "member_type", folds=4, repeats=2, seed=1)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
    tuned = lasso.tune(points, folds, "y", ["w", "g"], ["z0", "z1", "z2"], ratios=(1.0, 0.3, 0.05), rule="minimum")
    p = points.join(folds, ["member_id", "member_type"]).where("repeat = 0").toPandas()
    train, test = p[p.fold != 0], p[p.fold == 0]
    spark = points.sparkSession
    fit = lasso.fit_lasso(spark.createDataFrame(train.drop(columns=["repeat", "fold"])), "y", ["w", "g"], ["z0", "z1", "z2"], 0.3)
    y = fit.base[0] + test[["w", "g"]].to_numpy() @ fit.base[1:] + test[["z0", "z1", "z2"]].to_numpy() @ fit.coefficients
    assert tuned.scores[0, 1] == pytest.approx(((test.y - y) ** 2).mean())
    samples = lasso.subsamples(points, "member_id", "member_type", fraction=0.7, n=10, seed=2)
    drawn = samples.members(points)
    assert drawn.count() == 560 and drawn.distinct().count() == 560
    counts, n = lasso.stability(points, samples, "y", ["w", "g"], ["z0", "z1", "z2"], 0.5)
    assert n == 10 and counts["z0"] == 10 and counts["z1"] <= 3
    assert lasso.quotas({"a": 90, "b": 9, "c": 1}, 0.1) == {"a": 8, "b": 1, "c": 1}


def test_collinearity(points):
    names = ["one", "w", "g", "twice"]
    got = moments.diagnose_collinearity(points, [F.lit(1.0), F.col("w"), F.col("g"), 2 * F.col("g")], names)
    assert got.rank == 3 and len(got.null_space) == 1 and got.null_space[0][:2] == pytest.approx([0, 0], abs=1e-9)


def test_whole_analysis_is_published_whole_or_not_at_all(spark, study, folder, tmp_path):
    config = analysis.Config(cv_folds=2, cv_repeats=1, resamples=4, lambda_ratios=(1.0, 0.2))
    result = analysis.run_analysis(study, config=config, actionability=CLASSES)
    assert result.winner == analysis.OLS_MODEL and list(result.tables) == list(SCHEMAS)
    assert len(result.tables["cohort_flow"]) == 8 and len(result.tables["outcomes_by_member_type"]) == 18 and len(result.tables["limitations"]) == 10
    out = tmp_path / "out"
    ids = [r[0] for r in study.demographics.select("member_id").collect()]
    paths = publish.write_outputs(result, str(out), source=str(folder), identifiers=ids)
    assert len(paths) == 25 and all(p.exists() for p in paths) and sorted(p.name for p in paths) == result.metadata["output_files"]
    drawn = figures.figures(result.tables)
    assert tuple(drawn) == figures.FIGURES and all(ElementTree.fromstring(x).tag.endswith("svg") for x in drawn.values())
    contract.check_metadata(result.metadata, result.tables, analysis.source_rows(study))
    for key, value in dict(included_members=1, lambda_ratios=[2.0], lasso_fold_plan_id="other", seed=-1, stability_selection_threshold=float("nan")).items():
        with pytest.raises(ValueError):
            contract.check_metadata(result.metadata | {key: value}, result.tables)
    with pytest.raises(ValueError, match="unknown"):
        contract.check_metadata(result.metadata | {"more": 1}, result.tables)
    # whatever key is altered, the run is not published
    for key, value in result.metadata.items():
        kind = type(value)
        others = {str: ["other", ""], int: [value + 1 if kind is int else 0, float(value) if kind is int else 0], float: [value / 2 if kind is float else 0], bool: [True, 0], list: [[], value[:-1] if kind is list else []], dict: [{}, {k: -1 for k in value} if kind is dict else {}]}[kind]
        if key == "lambda_ratios":  # the tables tell which were chosen, not which others were tried
            others = [[], [0.123], [1.0, 1.0], [2.0], "1"]
        for other in others:
            with pytest.raises(ValueError):
                contract.check_metadata(result.metadata | {key: other}, result.tables, analysis.source_rows(study) if key == "source_row_counts" else None)
    t = result.tables["hypothesis_evidence"]
    assert set(t["result_status"]) <= set(evidence.SAYINGS) and (t["evidence_filter"] != "").all() and not (set(result.tables["findings_and_implications"]["finding"]) & set(t["question"]))
    every = t.set_index("hypothesis_id")["result_status"]
    assert every["treatment_loss"] == evidence.interval(*result.tables["locked_model_coefficients_hc3"].set_index(["model_id", "term"]).loc[("locked_primary", "treated"), ["ci_lower", "ci_upper"]])
    assert list(result.models["model_id"])[-1] == analysis.OLS_MODEL and json.loads(result.models["coefficients"].iloc[-1]).keys() == {"intercept", "first_weight", "treated"}
    assert len(result.longitudinal) == len(result.specifications["mean"].candidates)
    before = {p.name: p.read_bytes() for p in paths}
    again = analysis.run_analysis(load_study(spark, str(folder)), config=config, actionability=CLASSES)
    publish.write_outputs(again, str(out), identifiers=ids)
    assert {p.name: p.read_bytes() for p in paths} == before
    with pytest.raises(ValueError):
        publish.write_outputs(result, str(folder / "in"), source=str(folder))
    with pytest.raises(ValueError):
        publish.write_outputs(result, str(out), identifiers=["member type"] + [TREATED])
    broken = dict(result.tables)
    broken["limitations"] = broken["limitations"].drop(columns="severity")
    with pytest.raises(ValueError):
        publish.check_tables(broken)
    assert {p.name: p.read_bytes() for p in paths} == before
    shutil.rmtree(out)


def test_event_types_without_a_class_stop_the_run(study):
    with pytest.raises(ValueError, match="without a class"):
        d.classify_strictly(f.classify_events(study.engagement, RULES), d.ACTIONABILITY)


def test_contrasts_that_are_not_canonical_are_reported_but_not_locked():
    names = ("tenure_days", "sex[MALE]", "sex[OTHER]")
    fit = SimpleNamespace(excluded=(), lam=1.0, lam_max=2.0, coefficients=[0.1] * 3, theta=[0.1] * 3)
    spec = analysis.Specification("mean", names, None, fit, dict.fromkeys(names, 9), 10)
    assert analysis.locked_candidates(spec, 0.75) == ("tenure_days", "sex[MALE]")
    assert [analysis.canonical(n) for n in names] == [True, True, False]


def test_files_that_cannot_be_restored_are_kept(study, tmp_path, monkeypatch):
    """If a published file can't be taken back, what stood there before stays in the stage folder."""
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.csv").write_text("before")
    moves, real = [], os.replace

    def replace_(a, b):
        moves.append((a, b))
        if len(moves) > 1:
            raise OSError("no more")
        real(a, b)

    monkeypatch.setattr(publish, "SCHEMAS", {"a": ("x",)})
    monkeypatch.setattr(publish, "figures", lambda tables: {})
    monkeypatch.setattr(publish.os, "replace", replace_)
    result = SimpleNamespace(tables={"a": pd.DataFrame({"x": [1]})}, metadata={})
    with pytest.raises(RuntimeError, match="not restored"):
        publish.write_outputs(result, str(out))
    assert [p.read_text() for p in tmp_path.glob(".stage-*/a.csv.before")] == ["before"]


def test_identifiers_of_any_form_and_table_are_found(spark, study):
    for text, i in [("case 12 left", "12"), ("a 48213 b", "48213"), (r'{"k": ["\u0041B9"]}', "ab9"), (r'"\u0034\u0032"', "42"), ("Member x7", " X7 ")]:
        with pytest.raises(ValueError):
            publish.check_privacy(["clean", 3, text], [i])
    with pytest.raises(ValueError):
        publish.check_privacy([{"a": {"id 77": 1}}], ["77"])
    publish.check_privacy(["clean", 48213, 0.12, None], ["48213", "12", " ", None])
    extra = study.weights.limit(1).withColumn("member_id", F.lit("only-in-weights"))
    made = replace(study, weights=study.weights.unionByName(extra))
    ids = publish.member_ids(made)
    assert "only-in-weights" in {r[0] for r in ids.collect()}
    publish.check_privacy(["clean", 48213, None], ids)
    for text in ("seen: ONLY-in-weights.", '{"k": ["\\u006fnly-in-weights"]}'):
        with pytest.raises(ValueError) as e:
            publish.check_privacy(["clean", text], ids)
        assert "only" not in str(e.value)


def test_needles_find_what_a_search_finds():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abé\n\U0001f600"), 3000))
    for _ in range(300):
        size = int(rng.integers(1, 12))
        at = int(rng.integers(0, 2900))
        own = ["".join(rng.choice(list("abé"), size)), text[at : at + size] if rng.random() < 0.3 else "zz"]
        assert (publish.Needles(text).first_in(own) is not None) == any(x in text for x in own)
    long = text[100:500]
    assert publish.Needles(text).first_in(["", long]) == long and publish.Needles(text).first_in([text + "a"]) is None


@pytest.mark.parametrize("scheme", ["file", "viewfs"])
def test_a_killed_publication_leaves_one_whole_set(spark, tmp_path, monkeypatch, scheme):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shop.link./out", f"file://{tmp_path}")
    url = f"file://{tmp_path}/r" if scheme == "file" else "viewfs://shop/out/r"
    old, new = {"a.csv": "x\n1\n", "b.json": "{}\n"}, {"a.csv": "x\n2\né", "c.csv": ""}
    assert store.published(spark, url) is None
    store.publish(spark, old, url)
    assert store.published(spark, url) == old
    steps = [f"{n}" for n in ("write", "replace", "delete")]
    seen = []
    for kill in range(1, 20):
        count = [0]

        def step(real):
            def own(self, *a):
                count[0] += 1
                if count[0] == kill:
                    raise KeyboardInterrupt
                return real(self, *a)

            return own

        with monkeypatch.context() as m:
            for n in steps:
                m.setattr(store.Store, n, step(getattr(store.Store, n)))
            try:
                store.publish(spark, new, url)
                done = True
            except KeyboardInterrupt:
                done = False
        now = store.published(spark, url)
        assert now in (old, new)
        seen.append(now == new)
        if done:
            break
        store.publish(spark, old, url)  # the next run clears what is left
        assert store.published(spark, url) == old and len(store.Store(spark, url).names("sets")) == 1 and store.Store(spark, url).names() == ["manifest.json", "sets"]
    assert done and seen[0] is False and seen[-1] is True
    other = store.Store(spark, url)
    name = f"sets/{other.names('sets')[0]}/a.csv"
    other.delete(name)
    other.write(name, b"other")
    with pytest.raises(ValueError, match="not as it was"):
        store.published(spark, url)


def test_tall_qr_is_combined_on_the_executors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(60)
    monkeypatch.setattr(moments, "TREE", (16, 4, 1))
    r = moments.tall_qr(df, [F.col(c) for c in "abc"])
    assert r.shape == (3, 3) and np.abs(r.T @ r) == pytest.approx(np.abs(x.T @ x))
    assert moments.tall_qr(df.limit(0), [F.col("a")]).shape == (0, 1)


def test_members_that_do_not_belong_together_are_counted(spark):
    own = "member_id string, member_type string"
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], own)
    features = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "y")], own)
    counts = spark.createDataFrame([("a", "e"), ("a", "e"), ("z", "e")], "member_id string, event_type string")
    row = contract.member_consistency(members, features, counts).first()
    assert row.asDict() == dict(only_in_members=1, only_in_features=1, type_differs=1, counts_of_no_member=1, repeated_pairs=1)


def test_selection_tables_must_be_whole():
    good = pd.DataFrame(dict(candidate=["a", "b"], candidate_order=[1, 2], selection_count=[3, 9], n_resamples=10, selection_frequency=[0.3, 0.9], selection_threshold=0.75, selected_at_threshold=[False, True], module_spec="mean", selected_lambda_ratio=0.2, cv_mean_mse=1.0, fold_plan_id="f", is_winning_specification=True, locked_model_status=["below_stability_threshold", "locked"]))
    contract.check_selection(good, ("a", "b"))
    for column, values in dict(selection_count=[3, 8], selected_at_threshold=[True, True], candidate_order=[2, 1], cv_mean_mse=[1.0, 2.0], is_winning_specification=False).items():
        with pytest.raises(ValueError):
            contract.check_selection(good.assign(**{column: values}), ("a", "b"))


def test_rank_positions(spark):
    df = spark.createDataFrame([(float(k * 7 % 31), k) for k in range(31)] + [(3.0, 99)], "v double, k int").repartition(5)
    got = [r["v"] for r in stats.rank_positions(df, "v", "k").orderBy("position").collect()]
    assert got == sorted(got) and stats.rank_positions(df, "v", "k").agg(F.sum("position")).first()[0] == pytest.approx(16)


def test_configuration():
    with pytest.raises(ValueError):
        analysis.Config(cv_folds=1)
    with pytest.raises(ValueError):
        analysis.Config(lambda_ratios=(2.0,))


def test_the_contract_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "q01_outcomes_by_member_type" in e.queries()


def test_exact_quantiles_without_a_group_in_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}" if g else None, None if rng.random() < 0.1 else float(rng.choice([rng.integers(0, 4), rng.normal()]))) for g in range(40) for _ in range(g)]
    rows += [("wide", float(x)) for x in rng.normal(size=60_000)] + [("ties", float(x)) for x in rng.integers(0, 3, 30_000)] + [("none", None), (None, -1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    exact = F.percentile("v", F.array(*map(F.lit, at)))
    got = {r["k"]: (r["n"], r["q"]) for r in aggregate_with_quantiles(df, ["k"], "v", at, [F.count(F.lit(1)).alias("n")]).collect()}
    wanted = {r["k"]: (r["n"], r["q"]) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), exact.alias("q")).collect()}
    assert set(got) == set(wanted) and got["none"] == (1, None)
    for k, (n, q) in wanted.items():
        if k != "none":
            assert got[k][0] == n and got[k][1] == pytest.approx(q, rel=1e-12)
    assert aggregate_with_quantiles(df, [], "v", at).first()["q"] == pytest.approx(df.agg(exact).first()[0], rel=1e-12)
    assert aggregate_with_quantiles(df.limit(0), ["k"], "v", at).count() == 0


def test_quantile_plans_hold_no_percentile(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, value double")
    plan = d.summarize(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan


def test_places_keep_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(None if x > 2.3 else float(round(x, 1)), k) for k, x in enumerate(rng.normal(size=5000))]
    df = spark.createDataFrame(rows, "v double, t bigint").repartition(6)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    out, n = stats.placed(df, "v", "t")
    got = {r["t"]: r["place"] for r in out.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    assert n == len(rows) and [got[t] for _, t in order] == list(range(n))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert stats.placed(df.limit(0), "v", "t")[0].count() == 0


def test_huge_values_are_scaled_before_they_are_squared(spark):
    largest = float(np.finfo(float).max)
    frame = lambda rows: spark.createDataFrame([tuple(map(float, r)) for r in rows], "y double, z double")
    df = frame([(5, largest), (5, largest), (-1, -largest), (-1, -largest)])
    fit = lasso.fit_lasso(df, "y", [], ["z"], 0.0)
    assert moments.Scale.of(df, ["z"]).sd[0] == largest and np.isfinite(fit.coefficients).all() and not fit.excluded
    assert [r[0] for r in df.orderBy("y").select(fit.predicted()).collect()] == pytest.approx([-1, -1, 5, 5], abs=1e-12)
    small = df.withColumn("z", F.col("z") * 1e-308 * 1e-300)
    assert small.orderBy("y").select(lasso.fit_lasso(small, "y", [], ["z"], 0.0).predicted()).first()[0] == pytest.approx(-1)
    for rows in ([(1, largest), (2, -largest), (3, -largest), (4, -largest)], [(largest, -1), (-largest, 1), (largest, -1), (-largest, 1)], [(1, math.inf), (2, 1), (3, 2), (4, 3)]):
        with pytest.raises(ValueError, match="finite|overflow"):
            lasso.fit_lasso(frame(rows), "y", [], ["z"], 0.5)
    with pytest.raises(ValueError, match="finite"):
        models.fit_ols(frame([(largest, -1), (-largest, 1), (largest, -1), (-largest, 1)]), "y", ["z"])


def test_fitted_levels_code_new_members(spark, points):
    rows = [(f"m{k}", [" A", "B", "C ", None][k % 4], 80.0 + k % 17, 79.0 + k % 17 - (k % 4) * 2 + (k % 5) / 7) for k in range(80)]
    df = spark.createDataFrame(rows, "member_id string, member_type string, first_weight double, last_weight double")
    df = df.withColumn("percentage_loss", 100 * (F.col("first_weight") - F.col("last_weight")) / F.col("first_weight"))
    own = models.Contrasts.of(df, "member_type", preferred="B")
    assert own == models.Contrasts("member_type", ("A", "B", "C"), "B") and own.names == ("member_type[A]", "member_type[C]")
    assert models.Contrasts.of(df, "member_type", reference=" C").reference == "C"
    with pytest.raises(ValueError, match="observed"):
        models.Contrasts.of(df, "member_type", reference="D")
    assert [tuple(r) for r in own.apply(df).where("member_id in ('m0', 'm1', 'm3')").orderBy("member_id").select(*[f"`{n}`" for n in own.names]).collect()] == [(1, 0), (0, 0), (None, None)]
    new = spark.createDataFrame([("x", "A", 90.0), ("y", "B", 90.0)], "member_id string, member_type string, first_weight double")
    bad = spark.createDataFrame([("x", "Z", 90.0)], "member_id string, member_type string, first_weight double")
    zero = spark.createDataFrame([("x", "A", 0.0)], "member_id string, member_type string, first_weight double")
    for model in (models.fit_percentage_loss(df, [own]), models.fit_two_occasions(df, [own], scale_name="log")):
        told = {r["member_id"]: r["predicted_last_weight"] for r in model.predict_last_weight(new).collect()}
        assert told["x"] > told["y"] and all(80 < v < 95 for v in told.values())
        assert model.predict_last_weight(new).columns == [*new.columns, "predicted_last_weight"]
        for wrong, message in ((bad, "unseen level of member_type: Z"), (zero, "positive")):
            with pytest.raises(Exception, match=message):
                model.predict_last_weight(wrong).collect()
    same = models.fit_ols(own.apply(df), "percentage_loss", ["first_weight", *own.names])
    wanted = own.apply(new).select((F.col("first_weight") * (1 - same.fitted() / 100)).alias("v")).collect()
    assert [r["predicted_last_weight"] for r in models.fit_percentage_loss(df, [own]).predict_last_weight(new).collect()] == pytest.approx([r["v"] for r in wanted])


def test_subsamples_are_the_smallest_keys_of_each_stratum(points):
    import hashlib

    own = points.select(F.col("member_id").cast("string").alias("m"), "member_type").distinct().collect()
    samples = lasso.subsamples(points, "member_id", "member_type", fraction=0.3, n=4, seed=9)
    quota = lasso.quotas({t: sum(r[1] == t for r in own) for t in sorted({r[1] for r in own})}, 0.3)
    wanted = set()
    for k in range(4):
        for t, q in quota.items():
            order = sorted((hashlib.md5(f"9|{k}|{r[0]}".encode()).hexdigest(), r[0]) for r in own if r[1] == t)
            wanted |= {(m, t, k) for _, m in order[:q]}
    assert {tuple(r) for r in samples.members(points).collect()} == wanted
    twice = points.unionByName(points)
    assert samples.spread(twice).count() == 2 * len(wanted)
    plan = samples.spread(points)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_evidence_follows_the_tables():
    terms = lambda *rows: pd.DataFrame([dict(model_id=m, term=n, term_role=r, estimate=(a + b) / 2, ci_lower=a, ci_upper=b) for m, n, r, a, b in rows])
    selection = lambda *rows: pd.DataFrame([dict(candidate=c, candidate_role=r, is_winning_specification=w, locked_model_status=s, selection_frequency=0.8) for c, r, w, s in rows])
    none = pd.DataFrame(columns=["candidate", "candidate_role", "is_winning_specification", "locked_model_status", "selection_frequency"])
    for ends, status in (((1, 2), "supported"), ((-2, -1), "contrary"), ((-1, 1), "inconclusive"), ((math.nan, 1), "not_estimable")):
        t = {"locked_model_coefficients_hc3": terms(("locked_primary", "treated", "base", *ends))}
        assert evidence.treatment_loss(t).status == status
    both = lambda a, b: {"locked_model_coefficients_hc3": terms(("locked_primary", "treated", "base", *a), ("duration_sensitivity", "treated", "base", *b))}
    assert [evidence.duration(both((1, 2), b)).status for b in ((1, 3), (-1, 3), (-3, -1))] == ["robust", "sensitive", "sensitive"]
    assert evidence.duration({"locked_model_coefficients_hc3": terms(("locked_primary", "x", "base", 1, 2))}).status == "not_estimable"
    rate = lambda *ends: {"outcomes_by_member_type": pd.DataFrame([dict(outcome="weight_loss_success", scope_order=k, scope=f"s{k}", percentage=50.0, ci_lower=a, ci_upper=b) for k, (a, b) in enumerate(ends, 2)])}
    assert [evidence.treatment_response(rate(*x)).status for x in (((5, 6), (1, 2)), ((1, 2), (5, 6)), ((1, 4), (3, 6)), ((1, 2),))] == ["supported", "contrary", "inconclusive", "not_estimable"]
    for status, frame, ends in (("supported", "locked", (1, 2)), ("contrary", "locked", (-2, -1)), ("not_selected", "below_stability_threshold", (1, 2)), ("not_estimable", "inestimable_full_fit", (1, 2))):
        t = {"lasso_mean_selection": selection(("v", "engagement", True, frame)), "lasso_domain_selection": none, "locked_model_coefficients_hc3": terms(("locked_primary", "v", "selected", *ends))}
        assert evidence.engagement(t).status == status
        t["modules_by_member_type"] = pd.DataFrame([dict(scope="B", scope_order=3, module_variable="m", zero_completion_group_flag=True)])
        assert evidence.modules(t).status == "not_comparable"
    act = lambda *p: {"engagement_activity_summary": pd.DataFrame([dict(event_type=f"e{k}", test_status="tested" if x is not None else "insufficient_reach", estimate=1.0, fdr_adjusted_p_value=x) for k, x in enumerate(p)])}
    assert [evidence.activities(act(*p)).status for p in ((0.01, 0.2), (0.2, None), (None,))] == ["supported", "inconclusive", "not_tested"]


def test_pairs_give_the_classes_and_counts(spark):
    day = "2025-01-0"
    rows = [(m, f"{day}{1 + k % 9}" if k % 5 else None, e) for k, (m, e) in enumerate([(m, e) for m in ("a", "b", "c", None) for e in ("X", "Y", None)] * 7)]
    engagement = spark.createDataFrame(rows, "member_id string, activity_at string, event_type string").withColumn("activity_at", F.to_date("activity_at"))
    cohort = spark.createDataFrame([("a", f"{day}4"), ("b", None), ("d", f"{day}9")], "member_id string, last_weight_at string").withColumn("last_weight_at", F.to_date("last_weight_at"))
    rules = replace(RULES, repeatable_ratio=1.0, repeatable_members=3)
    told = lambda df: sorted(map(repr, df.collect()))
    pairs = f.event_pairs(engagement, cohort)
    assert told(f.classify_pairs(pairs, rules)) == told(f.classify_events(engagement, rules))
    assert told(f.event_counts(engagement, cohort, rules, pairs)) == told(f.event_counts(engagement, cohort, rules)) != []


@pytest.mark.parametrize("name", ["q37_activity_associations", "q38_collinearity", "q40_activity_p_values", "q42_longitudinal_lasso", "q45_lasso_huge_candidate", "q48_model_summary", "q52_collinearity_identities"])
def test_sources_are_read_once(spark, monkeypatch, name):
    from __spark_entry__ import SMOKE_DIR, queries

    real, told = catalog.order_study, {}

    def counted(df, source):
        told[source] = (df.count(), spark.sparkContext.accumulator(0))

        def run(batches, seen=told[source][1]):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    def order_study(*args):
        s = real(*args)
        return replace(s, **{x: counted(getattr(s, x), x) for x in ("weights", "engagement", "modules")})

    monkeypatch.setattr(catalog, "order_study", order_study)
    queries()[name](spark, SMOKE_DIR).collect()
    assert len(told) == 3 and all(seen.value in (0, n) for n, seen in told.values())
    assert told["weights"][1].value > 0


def test_resample_moments_are_those_of_the_spread_rows(spark):
    rows = [(f"m{k}" if k else None, "ab"[k % 2] if k % 11 else None, float(k % 7), None if k == 5 else float(k * k % 13)) for k in range(90)]
    points = spark.createDataFrame(rows, "member_id string, kind string, x double, y double").repartition(3)
    samples = lasso.subsamples(points, "member_id", "kind", fraction=0.6, n=5, seed=4)
    scale = moments.Scale.of(points.dropna(subset=["x", "y"]), ["x", "y"])
    want = moments.moments(samples.spread(points), ["x", "y"], by=["resample"], scale=scale).grams
    got = samples.moments(points, ["x", "y"], scale).grams
    assert got.keys() == want.keys() and len(want) == 5
    assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)
