"""Fits against direct solutions, closed forms and simulations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.models.fit import fit_trend
from taxaflow.models.predict import epred_draws, residuals
from taxaflow.models.solve import Equations, Solution, Weights, curvature, layout, normals
from taxaflow.operators.frame import compress_patterns, model_frame, model_levels, term_selection
from taxaflow.plans.trends import change_since, list_length_model, model_results, occupancy_model, reporting_rate_model
from taxaflow.sources.model_store import pending_models, read_model, write_model


def simulate(seed=0, models=("m0", "m1"), n=400, sites=0, spread=0.0):
    rng = np.random.default_rng(seed)
    out = []
    for m in models:
        for c, (a, b) in {"A": (-1, 0.1), "B": (-0.5, -0.05)}.items():
            effect = rng.normal(0, spread, max(sites, 1))
            year, length, site = rng.integers(1990, 2020, n), rng.integers(1, 15, n), rng.integers(0, max(sites, 1), n)
            eta = a + b * (year - 2005) + 0.5 * np.log(length) + effect[site]
            y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
            out.append(pd.DataFrame({"model_id": m, "year": year, "geo": c, "list_length": length, "site": [f"{c}{s}" for s in site], "success": y}))
    return pd.concat(out)


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T * (mu * (1 - mu)) @ x, x.T @ (y - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T * (mu * (1 - mu)) @ x)))


@pytest.fixture(scope="module")
def data():
    return simulate()


@pytest.fixture(scope="module")
def fitted(spark, data):
    """Two ordinary models, one without data variation and one separable."""
    flat = pd.DataFrame({"model_id": "flat", "year": 2000, "geo": "A", "list_length": 3, "site": "A0", "success": [0, 1, 1, 1]})
    apart = pd.DataFrame({"model_id": "apart", "year": [1, 2, 3, 4], "geo": "A", "list_length": 3, "site": "A0", "success": [0, 0, 1, 1]})
    df = spark.createDataFrame(pd.concat([data, flat, apart]))
    return list_length_model(df, "model_id", "success", cat_col="geo", n_draws=400, prior_scale=100.0)


def coefs(fit, model):
    return {r.term: (r.estimate, r.sd) for r in fit.coef.where(F.col("model_id") == model).collect()}


def test_glm_matches_newton_on_raw_rows(fitted, data):
    one = data[data.model_id == "m1"]
    var, b = (one.year - np.median(one.year)).to_numpy(float), (one.geo == "B").to_numpy(float)
    want, sd = newton(np.c_[np.ones(len(one)), var, np.log(one.list_length), b, b * var], one.success.to_numpy())
    got = coefs(fitted[1], "m1")
    for name, w, s in zip(("(Intercept)", "var", "use_cov", "catB", "var:catB"), want, sd):
        assert got[name][0] == pytest.approx(w, abs=2e-4) and got[name][1] == pytest.approx(s, rel=1e-3)


def test_odd_models_leave_the_others_alone(fitted):
    spec = {r.model_id: r for r in fitted[1].spec.collect()}
    assert {m: spec[m].status for m in spec} == {"m0": "ok", "m1": "ok", "flat": "ok", "apart": "ok"}
    assert coefs(fitted[1], "flat")["(Intercept)"][0] == pytest.approx(np.log(3), abs=1e-6)
    assert "use_cov" not in coefs(fitted[1], "flat")
    assert np.isfinite(coefs(fitted[1], "apart")["var"][0]) and coefs(fitted[1], "apart")["var"][0] > 1


def test_broken_model_gets_a_status(spark, data):
    bad = data[data.model_id == "m0"].assign(model_id="bad", success=float("inf"))
    df = spark.createDataFrame(pd.concat([data[data.model_id == "m0"], bad]))
    fit = list_length_model(df, "model_id", "success", cat_col="geo", family="gaussian", n_draws=5)[1]
    spec = {r.model_id: r for r in fit.spec.collect()}
    assert spec["bad"].status == "error" and spec["bad"].message and not spec["bad"].converged
    assert spec["m0"].status == "ok" and {r.model_id for r in fit.draws.collect()} == {"m0"}


def test_draws_have_the_right_mean_and_spread(fitted):
    draws = {(r.model_id, r.cat): np.array(r.draws) for r in fitted[1].draws.collect()}
    got = coefs(fitted[1], "m1")
    scale = fitted[1].design.where("model_id = 'm1'").first().var_scale
    slope = draws["m1", "A"][:, 1] / scale
    assert slope.mean() == pytest.approx(got["var"][0], abs=4 * got["var"][1] / 20)
    assert slope.std() == pytest.approx(got["var"][1], rel=0.15)
    other = draws["m1", "B"][:, 1] / scale
    assert other.mean() == pytest.approx(got["var"][0] + got["var:catB"][0], abs=4 * got["var"][1] / 20 * 2)


def test_model_results_path(fitted, data):
    frame, fit = fitted
    out = model_results(frame, fit, ref=-10, n_draws=400)["res"].where("model_id = 'm0'").collect()
    rows = {(r.cat, r.year): r for r in out}
    assert all(r.check == 0 for r in out) and rows["A", 1995].diff_q50 is None
    one = data[data.model_id == "m0"]
    for c, sign in (("A", 1), ("B", -1)):
        last = rows[c, 2019]
        assert np.sign(last.diff_q50) == sign and last.positive + last.negative + last.stable == pytest.approx(1)
        near = one[(one.geo == c) & (abs(one.year - 2010) <= 2)]
        assert rows[c, 2010].q50 == pytest.approx(near.success.mean(), abs=0.15)


def test_change_and_residuals(fitted):
    frame, fit = fitted
    wide = change_since(frame, fit, 1995, 2015, "geo", cov_col="cov").where("model_id in ('m0', 'm1', 'flat')")
    got = {(r.model_id, r.geo): np.mean(r.diff) for r in wide.collect()}
    assert set(got) == {(m, g) for m in ("m0", "m1") for g in "AB"} and got["m0", "A"] > 0.2 > 0 > got["m0", "B"]
    means = residuals(fit, frame).where("model_id = 'm0'").agg(F.avg("residual"), F.count("residual")).first()
    assert means[0] == pytest.approx(0, abs=5e-3) and means[1] == 800


def test_same_result_for_any_layout_and_alone(spark, data):
    df = spark.createDataFrame(data)
    both = list_length_model(df.repartition(7), "model_id", "success", cat_col="geo", n_draws=3, prior_scale=100.0)[1]
    alone = list_length_model(df.where("model_id = 'm1'"), "model_id", "success", cat_col="geo", n_draws=3, prior_scale=100.0)[1]
    a, b = coefs(both, "m1"), coefs(alone, "m1")
    assert all(a[t] == pytest.approx(b[t], rel=1e-7) for t in a)
    x, y = (np.array(f.draws.where("model_id = 'm1' and cat = 'B'").first().draws) for f in (both, alone))
    assert np.allclose(x, y, rtol=1e-6)


def test_random_intercepts_recover_their_variance(spark):
    data = simulate(3, ("m0",), 3000, sites=40, spread=0.8)
    fit = list_length_model(spark.createDataFrame(data), "model_id", "success", cat_col="geo", random_col="site", rand_slope=False, n_draws=50)[1]
    spec = fit.spec.first()
    assert spec.converged and spec.sigma[0] == pytest.approx(0.64, rel=0.4) and fit.levels.count() == 80
    got = coefs(fit, "m0")
    assert got["var"][0] == pytest.approx(0.1, abs=0.02) and got["(Intercept)"][1] > 0.1
    grid = spark.createDataFrame([("m0", "A", s, 0.0, 1.0) for s in ("A0", "A1", "unseen")], "model_id string, cat string, rand string, var double, use_cov double")
    middle = lambda df: {r.rand: r.m for r in df.select("rand", D.mean(F.col("pred")).alias("m")).collect()}
    with_levels, without = middle(epred_draws(fit, grid, include_random=True)), middle(epred_draws(fit, grid))
    assert with_levels["unseen"] == pytest.approx(without["unseen"]) and len(set(without.values())) == 1
    assert with_levels["A0"] != pytest.approx(with_levels["A1"], abs=1e-3)


def test_random_slopes_run_and_shrink(spark):
    data = simulate(4, ("m0",), 1500, sites=20, spread=0.5)
    fit = list_length_model(spark.createDataFrame(data), "model_id", "success", cat_col="geo", random_col="site", n_draws=5, max_iter=6)[1]
    spec = fit.spec.first()
    assert spec.status == ("ok" if spec.converged else "not converged") and len(spec.sigma) == 4 and spec.sigma[3] < spec.sigma[0]


def crossed(spark, n=300, levels=6, slope=False):
    """Gaussian records whose levels occur in both categories, with the design of all coefficients and effects."""
    rng = np.random.default_rng(8)
    x, c, s = rng.normal(size=n).round(2), rng.integers(0, 2, n), rng.integers(0, levels, n)
    y = 1 + 0.5 * x + 0.3 * c + rng.normal(0, 0.7, levels)[s] + (rng.normal(0, 0.5, levels)[s] * x if slope else 0) + rng.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"model_id": "m", "var": x, "cat": [f"c{v}" for v in c], "rand": [f"s{v}" for v in s], "y": y}))
    return df, x, c, np.eye(levels)[s], y


def test_the_fit_with_crossed_levels_equals_the_joint_solution(spark):
    """At the end, coefficients and effects solve the full ridge system, and the variance is the mean of b^2 + v."""
    df, x, c, z, y = crossed(spark)
    fit = fit_trend(compress_patterns(df, "model_id"), family="gaussian", rand_slope=False, prior_scale=None, n_draws=4000, tol=1e-9)
    spec, scale = fit.spec.first(), fit.design.first().var_scale
    assert spec.converged and spec.sigma[0] > 0.05
    full = np.c_[np.ones(len(y)), x / scale, c, c * x / scale, z]
    h = full.T @ full / spec.dispersion + np.diag([0.0] * 4 + [1 / spec.sigma[0]] * 6)
    theta, cov = np.linalg.solve(h, full.T @ y / spec.dispersion), np.linalg.inv(h)
    levels = {r.rand: (r.b[0], r.v[0]) for r in fit.levels.collect()}
    b, v = np.array([levels[f"s{i}"] for i in range(6)]).T
    assert np.allclose(b, theta[4:], atol=1e-6) and spec.sigma[0] == pytest.approx(np.mean(b * b + v), rel=1e-5)
    got = coefs(fit, "m")
    assert got["catc1"] == pytest.approx((theta[2], np.sqrt(cov[2, 2])), abs=1e-6)
    # predictions for a level: coefficients and effect are drawn together
    grid = spark.createDataFrame([("m", "c1", f"s{i}", 0.4) for i in range(6)], "model_id string, cat string, rand string, var double")
    for r in epred_draws(fit, grid, include_random=True).collect():
        row = np.r_[1, 0.4 / scale, 1, 0.4 / scale, np.eye(6)[int(r.rand[1])]]
        assert np.mean(r.pred) == pytest.approx(row @ theta, abs=4 * np.sqrt(row @ cov @ row / 4000))
        assert np.var(r.pred) == pytest.approx(row @ cov @ row, rel=0.1)
    # apart from their coefficients, the effects alone would be more certain, and the sum less
    assert np.sqrt(cov[4, 4]) > 1.2 * np.sqrt(v[0])


def test_random_slopes_end_where_the_score_of_their_covariance_is_zero(spark):
    df, x, c, z, y = crossed(spark, 900, 12, slope=True)
    fit = fit_trend(compress_patterns(df, "model_id"), family="gaussian", prior_scale=None, n_draws=2, tol=1e-8)
    spec = fit.spec.first()
    sigma = np.array(spec.sigma).reshape(2, 2)
    rows = fit.levels.collect()
    moments = np.mean([np.outer(r.b, r.b) + np.array(r.v).reshape(2, 2) for r in rows], axis=0)
    assert spec.converged and len(rows) == 12 and np.allclose(moments, sigma, atol=1e-5) and np.linalg.eigvalsh(sigma).min() > 0


def test_models_without_level_effects_end_at_zero_variance(spark):
    """Effects drawn with opposite signs are less spread than chance: no variance is best, and is reached."""
    rows = [("m0", f"s{s}", float(v), int((s + v + i) % 2)) for s in range(40) for v in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "model_id string, rand string, var double, y int").withColumn("cat", F.lit("all"))
    for slope, size in ((False, 1), (True, 4)):
        spec = fit_trend(compress_patterns(df, "model_id"), rand_slope=slope, n_draws=2).spec.first()
        assert spec.converged and spec.sigma == [0.0] * size and spec.iterations < 30


def test_blocks_give_the_same_as_the_whole_matrix():
    rng = np.random.default_rng(4)
    for k, q, n in ((None, 3, 4), (6, 7, 3)):
        root = rng.normal(size=(n, 3 * q, q))
        h, g = root.transpose(0, 2, 1) @ root, rng.normal(size=(n, q))
        shape, bend = layout([f"c{i}" for i in range(n)], q, k), None if k is None else curvature(np.linspace(0, 1, k))
        weights = Weights(2.0, np.array([3.0, 0.5, 7.0, 1.0])[:n])
        tiny = {(0, 1): np.full((q, q), 1e-13), (1, 0): np.full((q, q), 1e-13)}
        block, whole = (Solution(Equations(h, g, x), shape, bend, weights, 2.5) for x in ({}, tiny))
        assert whole.whole is not None and block.whole is None
        for name in ("shared", "own", "cov", "cov_across", "cov_own", "beta"):
            assert np.allclose(getattr(block, name), getattr(whole, name), atol=1e-8), name
        assert block.degrees(Equations(h, g, {})) == pytest.approx(whole.degrees(Equations(h, g, tiny)), rel=1e-8)
        noise = rng.normal(size=(block.parameters(), 20_000))
        for solution in (block, whole):
            spread = np.cov(solution.draws(noise)[1])
            want = solution.cov.copy()
            want[:-1, :] += solution.cov_across[1]
            want[:, :-1] += solution.cov_across[1].T
            want[:-1, :-1] += solution.cov_own[1]
            assert np.allclose(spread, want, atol=0.05 * np.abs(want).max())


def test_very_many_categories_take_little_memory():
    import tracemalloc

    n, rng = 5000, np.random.default_rng(1)
    root = rng.normal(size=(n, 9, 3))
    equations = Equations(root.transpose(0, 2, 1) @ root, rng.normal(size=(n, 3)), {})
    tracemalloc.start()
    solution = Solution(equations, layout([f"c{i}" for i in range(n)], 3, None), None, Weights(1.0, np.ones(n)), 2.5)
    assert solution.beta.shape == (n, 3) and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_each_category_has_a_penalty_of_its_own(spark):
    rng = np.random.default_rng(12)
    year = np.repeat(np.arange(1990, 2020), 60)
    rows = [pd.DataFrame({"model_id": "m", "year": year, "geo": g, "success": (rng.random(len(year)) < p).astype(int)})
            for g, p in (("curved", 0.15 + 0.7 * np.exp(-(((year - 2005) / 4) ** 2))), ("flat a", np.full(len(year), 0.4)), ("flat b", np.full(len(year), 0.5)))]
    frame, fit = list_length_model(spark.createDataFrame(pd.concat(rows)), "model_id", "success", cat_col="geo", cov_col=None, mod_type="gam", n_draws=50)
    own = {r.cat: r.weight_own for r in fit.weights.collect()}
    assert fit.spec.first().converged and own["curved"] < 0.1 * min(own["flat a"], own["flat b"])


def test_spline_follows_a_curve_and_flattens_noise(spark):
    rng = np.random.default_rng(6)
    year = np.repeat(np.arange(1990, 2020), 40)
    rows = [pd.DataFrame({"model_id": m, "year": year, "success": (rng.random(len(year)) < p).astype(int)})
            for m, p in (("curve", 0.2 + 0.6 * np.exp(-(((year - 2005) / 5) ** 2))), ("flat", np.full(len(year), 0.4)))]
    frame, fit = list_length_model(spark.createDataFrame(pd.concat(rows)), "model_id", "success", cov_col=None, mod_type="gam", n_draws=100)
    grid = frame.select("model_id", "year", "var").distinct()
    got = {(r.model_id, r.year): r.m for r in epred_draws(fit, grid).select("model_id", "year", D.mean(F.col("pred")).alias("m")).collect()}
    assert got["curve", 2005] - got["curve", 1992] > 0.35 and got["curve", 2005] - got["curve", 2018] > 0.35
    flat = [got["flat", y] for y in range(1990, 2020)]
    assert max(flat) - min(flat) < 0.12
    weights = {r.model_id: r.weight_all for r in fit.spec.collect()}
    assert weights["flat"] > weights["curve"]


def test_reporting_rate_and_occupancy_models(spark):
    rng = np.random.default_rng(9)
    rows = []
    for g, slope in (("north", 0.25), ("south", -0.25)):
        for y in range(2000, 2009):
            psi = 1 / (1 + np.exp(-slope * (y - 2004) * 2))
            for s in range(60):
                here = rng.random() < psi
                rows += [("x", y, g, f"{g}{s}", int(here and rng.random() < 0.6)) for _ in range(3)]
    df = spark.createDataFrame(rows, "taxa string, year int, geo string, grid_l string, success int")
    counts = df.groupBy("taxa", "year", "geo", "grid_l").agg(F.sum("success").alias("success"), F.count("success").alias("trials"))
    frame, fit = reporting_rate_model(counts, "taxa", ["geo"], n_draws=50, max_iter=6)
    change = {r.geo: np.mean(r.diff) for r in change_since(frame, fit, 2001, 2007, "geo").collect()}
    assert change["north"] > 0.2 and change["south"] < -0.2
    cells, frame, fit = occupancy_model(df, "taxa", ["geo"], n_draws=50)
    assert cells.count() == 18
    change = {r.geo: np.mean(r.diff) for r in change_since(frame, fit, 2001, 2007, "geo").collect()}
    assert change["north"] > 0.4 and change["south"] < -0.4


def test_frame_terms_and_patterns(spark, data):
    df = spark.createDataFrame(data).withColumn("one", F.lit(1)).withColumn("list_length", F.expr("if(model_id = 'm1', 0, list_length)"))
    frame = model_frame(df, "model_id", "success", "one", "year", "geo", "list_length", "site")
    levels = {r.model_id: r for r in model_levels(frame, "model_id").collect()}
    assert (levels["m0"].n_cov, levels["m0"].n_cat, levels["m1"].n_bad_cov) == (14, 2, 800)
    terms = {r.model_id: (r.terms, r.message) for r in term_selection(frame, "model_id").collect()}
    assert terms["m0"] == (["var", "use_cov", "cat", "var:cat", "(var | rand)"], None)
    assert terms["m1"][0] == ["var", "cat", "var:cat", "(var | rand)"] and terms["m1"][1].startswith("800 rows")
    gam = term_selection(frame.drop("rand"), "model_id", "gam").where("model_id = 'm0'").first().terms
    assert gam == ["s(var)", "use_cov", "cat", "s(var, by=cat)"]
    with pytest.raises(ValueError):
        term_selection(frame, "model_id", "tree")
    sums = compress_patterns(frame, "model_id").agg(F.sum("y"), F.sum("n_rows")).first()
    assert tuple(sums) == (data.success.sum(), len(data))
    beta = model_frame(df, "model_id", "success", None, "year", None, None, None, beta=True)
    assert {r.y for r in beta.select("y").distinct().collect()} == {1e-6, 1 - 1e-6}


def test_solver_pieces():
    shape = layout(["A", "B"], 3, None)
    assert shape.labels == ["(Intercept)", "var", "use_cov"] and [x[2] for x in shape.own_names()] == ["catB", "var:catB"]
    bend = curvature(np.linspace(0, 10, 6))
    assert np.allclose(bend, bend.T) and np.linalg.eigvalsh(bend).min() > 0
    assert np.array_equal(normals(1, "a", (3,)), normals(1, "a", (3,))) and not np.array_equal(normals(1, "a", (3,)), normals(1, "b", (3,)))


def test_model_store(spark, fitted, tmp_path):
    fit = fitted[1]
    write_model({"coef": fit.coef, "spec": fit.spec}, str(tmp_path))
    back = read_model(spark, str(tmp_path), ["coef", "spec"], ["m0"])
    assert {r.model_id for r in back["coef"].collect()} == {"m0"} and back["coef"].count() == 5
    write_model({"coef": fit.coef.where("model_id = 'm0'").withColumn("estimate", F.lit(0.0))}, str(tmp_path))
    coef = read_model(spark, str(tmp_path), ["coef"])["coef"]
    assert coef.where("model_id = 'm0' and estimate <> 0").count() == 0 and coef.where("model_id = 'm1'").count() == 5
    done = read_model(spark, str(tmp_path), ["spec"], ["m0", "m1"])["spec"]
    assert {r.model_id for r in pending_models(fit.spec, done).collect()} == {"flat", "apart"}
    assert pending_models(fit.spec, done, force_new=True).count() == 4


def test_level_effects_are_joint_draws(spark):
    """The spread of a difference between two times follows from intercept and slope together, and depends on model and seed."""
    from taxaflow.models.predict import _effects

    v = [0.5, 0.3, 0.3, 0.4]
    row = spark.range(1).select(
        _effects(F.array(F.lit(1.0), F.lit(-1.0)), F.array(*map(F.lit, v)), F.lit(20_000), F.xxhash64(F.lit(1))).alias("a"),
        _effects(F.array(F.lit(1.0), F.lit(-1.0)), F.array(*map(F.lit, v)), F.lit(20_000), F.xxhash64(F.lit(2))).alias("b"),
    ).first()
    a, b = (np.array([(x.b0, x.b1) for x in r]) for r in (row.a, row.b))
    assert np.cov(a.T) == pytest.approx(np.array(v).reshape(2, 2), abs=0.02) and a.mean(axis=0) == pytest.approx([1, -1], abs=0.02)
    assert abs(np.corrcoef(a[:, 0], b[:, 0])[0, 1]) < 0.03
    single = spark.range(1).select(_effects(F.array(F.lit(1.0)), F.array(F.lit(0.25)), F.lit(5000), F.lit(3)).alias("a")).first().a
    assert np.std([x.b0 for x in single]) == pytest.approx(0.5, abs=0.02) and {x.b1 for x in single} == {0.0}


def test_a_single_level_is_no_random_term(spark):
    data = simulate(6, ("m0", "one"), 300, sites=8, spread=0.5)
    data.loc[data.model_id == "one", "site"] = "only"
    fit = list_length_model(spark.createDataFrame(data), "model_id", "success", cat_col="geo", random_col="site", rand_slope=False, n_draws=5, max_iter=8)[1]
    spec = {r.model_id: r for r in fit.spec.collect()}
    assert spec["one"].n_level_effects == 0 and spec["one"].sigma == [0.0] and spec["m0"].n_level_effects > 1
    assert max(abs(r.b[0]) for r in fit.levels.where("model_id = 'one'").collect()) < 1e-6


def test_pace_falls_where_steps_turn_back_and_grows_where_they_go_on():
    from taxaflow.models.solve import PACES, Equations, next_pace

    equations = Equations(np.array([[[2.0, 0.5], [0.5, 1.0]]]), np.zeros((1, 2)), {})
    step = np.array([[1.0, -0.5]]), 0.2
    back = -step[0], -step[1]
    aside = np.array([[0.0, 0.0]]), 0.0
    assert next_pace(1.0, step, back, equations, 9) == 0.5
    assert next_pace(1.0, step, step, equations, 9) == 1.3
    assert next_pace(1.0, step, aside, equations, 9) == 1.0
    assert next_pace(PACES[0], step, back, equations, 9) == PACES[0]
    assert next_pace(PACES[1], step, step, equations, 9) == PACES[1]


def test_equal_levels_are_worked_on_once(spark):
    """300 sites of one visit each are two kinds of levels, by success; the fit has all sites, with the effects of their kinds."""
    from taxaflow.models import fit as module

    rows = [(m, 2000 + i % 2, "A", 3, f"{m}{i}", int(i % 3 == 0)) for m in ("m0", "m1") for i in range(300)]
    same = spark.createDataFrame(rows, "model_id string, year int, geo string, list_length int, site string, success int")
    patterns = compress_patterns(model_frame(same, "model_id", "success", None, "year", "geo", "list_length", "site"), "model_id")
    kinds, members = module._kinds(patterns, "model_id")
    assert sorted((r.model_id, r.times) for r in kinds.collect()) == [(m, n) for m in ("m0", "m1") for n in (50, 50, 100, 100)]
    assert members.count() == 600 and members.select("model_id", "rand").distinct().count() == 600
    fit = fit_trend(patterns, rand_slope=False, n_draws=2, max_iter=2)
    assert {(r.n_rand, r.n_data) for r in fit.spec.collect()} == {(300, 300)}
    assert fit.levels.count() == 600 and len({(r.model_id, round(r.b[0], 9)) for r in fit.levels.collect()}) <= 8 and fit.links.count() == 600


def test_counted_records_give_what_the_records_give(spark):
    from taxaflow.operators.explore import residual_stats
    from taxaflow.operators.grid import cov_quantiles, cov_values, prediction_grid

    df = spark.createDataFrame(simulate(5, n=60))
    df = df.unionByName(df).unionByName(df.where("year % 2 = 0")).withColumns({"cat": F.col("geo"), "cov": F.col("list_length").cast("double")})
    often = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("often"))
    out = []
    for rows, times in ((df, None), (often, "often")):
        grid = prediction_grid(rows, ["model_id"], "year", covariates=cov_quantiles(rows, ["model_id"], "cov", [0.1, 0.5], times), times=times)
        named = cov_values(rows, ["model_id"], [2, 7], times=times)
        frame = model_frame(rows, "model_id", "success", None, "year", "geo", "list_length", times=times)
        stats = residual_stats(frame.withColumn("residual", F.col("y") - 0.3), ["model_id"], times=times)
        out.append([sorted(t.collect(), key=str) for t in (grid, named, compress_patterns(frame, "model_id", times), stats)])
    for one, other in zip(*out):
        assert len(one) == len(other) > 0
        assert all(y == (pytest.approx(x, rel=1e-9) if isinstance(x, float) else x) for a, b in zip(one, other) for x, y in zip(a, b))


def test_queries_join_the_records_once(spark, tmp_path):
    """Results of models and grids come from one stored table of counted records, not from a join of the records for each use."""
    from taxaflow.plans import explore_queries, model_queries, record_queries

    rng, n, read = np.random.default_rng(8), 2000, []
    pdf = pd.DataFrame({"taxa": "t", "list": rng.integers(0, n // 4, n), "success": rng.integers(0, 2, n)})
    pdf["year"], pdf["region"] = 1990 + pdf["list"] % 9, [f"r{x % 2}" for x in pdf["list"]]
    path, real = str(tmp_path / "records"), record_queries.occurrences
    spark.createDataFrame(pdf).write.parquet(path)

    def records(*_):
        read.append(1)
        return spark.read.parquet(path)

    record_queries.occurrences = records
    try:
        grid = explore_queries.query.__globals__["QUERIES"]["prediction_grid"](spark, "none")
        frame, fit = model_queries.list_length_fit(spark, "none", n_draws=5)
        res = model_results(frame, fit, ref=-3, n_draws=5, times="times")["res"]
    finally:
        record_queries.occurrences = real
    assert len(read) == 2 and grid.count() > 0
    assert not any(path in "".join(x.inputFiles()) for x in (grid, res, frame))
    off = model_queries.scores(frame, fit).first().off
    assert off < 0.01
