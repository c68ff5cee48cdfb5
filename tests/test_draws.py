"""Summaries, contrasts and charts on draws with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow.operators import charts as C
from taxaflow.operators import contrast as K
from taxaflow.operators import diagnostics as G
from taxaflow.operators import explore as X
from taxaflow.operators import summary as S
from taxaflow.operators.grid import cov_quantiles, cov_values, prediction_grid, time_grid


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(0)
    rows = [(m, c, y, [float(v) for v in rng.normal(5 + 0.3 * y + (c == "B"), 1, 40)]) for m in "mn" for c in "AB" for y in range(6) if (c, y) != ("B", 3)]
    return spark.createDataFrame(rows, "model_id string, cat string, year int, pred array<double>")


def find(df):
    return {(r.model_id, r.cat, r.year): r for r in df.collect()}


def test_contrasts_pair_draw_by_draw(pred):
    base = find(pred)
    lag = find(K.contrast(pred, -2, "year", "cat", ["model_id"]))
    assert lag["m", "A", 1].diff is None and lag["m", "B", 5].ref is None
    assert np.allclose(lag["m", "A", 4].diff, np.subtract(base["m", "A", 4].pred, base["m", "A", 2].pred))
    cat = find(K.contrast(pred, "A", "year", "cat", ["model_id"]))
    assert np.allclose(cat["n", "B", 4].diff_prop, np.divide(base["n", "B", 4].pred, base["n", "A", 4].pred))
    fixed = find(K.contrast(pred, 2, "year", "cat", ["model_id"]))
    assert np.allclose(fixed["m", "B", 5].ref, base["m", "B", 2].pred)
    with pytest.raises(ValueError):
        K.contrast_lag(pred, 1, "year", "cat", ["model_id"])


def test_centred_reference(pred):
    centred = pred.withColumn("var", F.col("year") - 3.0)
    out = find(K.contrast(centred, 1, "year", "cat", ["model_id"], ref_centred=True))
    assert out["m", "A", 0].ref == find(pred)["m", "A", 4].pred


def test_posterior_summary_against_numpy(pred):
    keys = ["model_id", "cat", "year"]
    table = K.contrast(pred, -2, "year", "cat", ["model_id"])
    rows, base = find(S.posterior_summary(table, keys, 40)), find(pred)
    for (m, c, y), r in rows.items():
        assert r.check == 0 and r.n_draws == 40
        assert np.allclose([r.q10, r.q50, r.q90], np.quantile(base[m, c, y].pred, [0.1, 0.5, 0.9]))
        if (m, c, y - 2) not in base:
            assert (r.pd, r.ps, r.diff_prop_gm, r.diff_q50, r.positive, r.stable) == (None,) * 6
            continue
        d = np.subtract(base[m, c, y].pred, base[m, c, y - 2].pred)
        assert r.pd == max((d > 0).mean(), (d < 0).mean()) and r.ps == max((d > 0.05).mean(), (d < -0.05).mean())
        assert r.diff_prop_gm == pytest.approx(np.exp(np.log(np.divide(base[m, c, y].pred, base[m, c, y - 2].pred)).mean()))
        assert r.positive + r.negative + r.stable == pytest.approx(1)
        assert (r.positive == r.ps) == (np.median(d) > 0)


def test_median_change_of_zero_is_stable(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0],), ([None, None, None],)], "diff array<double>").select(
        F.monotonically_increasing_id().alias("id"), "diff", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("pred"), F.col("diff").alias("diff_prop")
    )
    out = S.posterior_summary(df, ["id"], 3).orderBy("id").collect()
    assert (out[0].positive, out[0].negative, out[0].stable) == (0.0, 0.0, 1.0)
    assert (out[1].positive, out[1].stable, out[1].pd) == (None, None, None)


def test_divergent_draws_apart(pred):
    flags = F.transform("pred", lambda x, i: i % 4 == 0)
    table = K.contrast(pred, -1, "year", "cat", ["model_id"]).withColumn("divergent", flags)
    out = S.divergent_summary(table, ["model_id", "cat", "year"], 40).where("divergent").collect()
    base = find(pred)
    assert {r.n_draws for r in out} == {10} and {r.check for r in out} == {-30}
    assert all(r.q50 == pytest.approx(np.median(base[r.model_id, r.cat, r.year].pred[::4])) for r in out)


def test_arrays_and_rows_round_trip(spark, pred):
    rows = S.to_rows(pred, ["model_id", "cat", "year"])
    assert rows.count() == pred.count() * 40
    missing = S.to_arrays(rows.where("draw <> 7"), ["model_id", "cat", "year"], 40)
    got = find(missing)["m", "A", 0].pred
    assert got[7] is None and got[8] == find(pred)["m", "A", 0].pred[8]


def test_year_diff_needs_data_on_both_sides(spark, pred):
    data = spark.createDataFrame(
        [("full", 2000), ("full", 2010), ("short", 2000), ("short", 2009), ("single", 2010)], "geo string, year int"
    )
    draws = data.select("geo").distinct().crossJoin(spark.createDataFrame([(2000, [1.0, 2.0, 3.0]), (2010, [3.0, 1.0, None])], "year int, pred array<double>"))
    out = K.year_diff(draws, data, ["geo"], 2000, 2010).collect()
    assert [(r.geo, r.diff) for r in out] == [("full", [2.0, -1.0, None])]
    assert K.year_diff(draws, data, ["geo"], 2000, 2010, limit_preds=False).count() == 3
    wide = K.year_diff(draws, data, ["geo"], 2000, 2010)
    assert K.year_diff_draws(wide).count() == 2
    r = S.change_summary(wide, ["geo"]).first()
    assert (r.n_check, r.lower, r.higher, r.median_diff, r.likelihood) == (2, 0.5, 0.5, 0.5, "About as likely as not")
    assert r.text == "about as likely as not to be lower in full (50% chance)"
    assert K.year_diff(draws, data, ["geo"], 1990, 2010).count() == 0


def test_overall(spark):
    rows = [("x", t, g, float(d)) for t in ("rr", "occ") for g in ("north", "south", "east") for d in range(-9, 2)]
    df = spark.createDataFrame(rows, "taxa string, type string, geo string, diff double")
    overall = S.overall_change(df)
    r = overall.first()
    assert (r.n, r.decline, r.median_effect) == (66, pytest.approx(9 / 11), -4.0) and r.text == "likely to be declining (82% chance)"
    text = S.overall_text(df, overall, "the region").first().overall_text
    assert text == (
        "_x_ was likely to be declining (82% chance) across the region based on 2 models (occ and rr) "
        "using data from 3 IBRA Subregions (east, north and south)"
    )


def test_sampled_draws_are_the_same_for_any_layout(pred):
    rows = S.to_rows(pred, ["model_id", "cat", "year"])
    picks = [
        {(r.model_id, r.draw) for r in S.sample_draws(rows.repartition(n), 5, ["model_id"]).select("model_id", "draw").distinct().collect()}
        for n in (1, 5)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 10
    other = {(r.model_id, r.draw) for r in S.sample_draws(rows, 5, ["model_id"], seed=2).select("model_id", "draw").distinct().collect()}
    assert other != picks[0]


def test_grid(spark):
    data = spark.createDataFrame(
        [("m", "A", y, 1.0 * c) for y, c in ((2000, 1), (2001, 2), (2004, 8))] + [("m", "B", 2002, 2.0)], "model_id string, cat string, year int, cov double"
    )
    grid = {(r.cat, r.year, r.var) for r in time_grid(data, ["model_id"], "year").collect()}
    assert grid == {("A", y, y - 2001.5) for y in range(2000, 2005)} | {("B", 2002, 0.5)}
    halves = time_grid(data.withColumn("year", F.col("year").cast("double")), ["model_id"], "year", pred_step=0.4).where("cat = 'A'").collect()
    assert sorted(r.year for r in halves) == pytest.approx([2000 + 0.4 * i for i in range(11)])
    q = {r.cov_q: r.cov for r in cov_quantiles(data, ["model_id"], "cov", [0.5, 1.0]).collect()}
    assert q == {"q50": 2.0, "q100": 8.0}
    named = {r.cov_q: (r.cov, r.ord) for r in cov_values(data, ["model_id"], [8, 1.5], "cov").collect()}
    assert named == {"q25": (1.5, 1), "q100": (8.0, 2)}
    full = prediction_grid(data, ["model_id"], "year", covariates=cov_values(data, ["model_id"], [0, 2], "cov"))
    assert full.count() == 6 and full.where("y_total = 100 and use_cov is not null").count() == 6


def test_rhat_and_effective_size(spark):
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(4, 500)), rng.normal(size=(4, 500)) + np.arange(4)[:, None]
    walk = np.zeros((4, 500))
    for i in range(1, 500):
        walk[:, i] = 0.9 * walk[:, i - 1] + rng.normal(size=4)
    rows = [(p, c, d, float(x[c, d])) for p, x in (("good", good), ("bad", bad), ("walk", walk)) for c in range(4) for d in range(500)]
    out = {r.parameter: r for r in G.parameter_summary(spark.createDataFrame(rows, "parameter string, chain int, draw int, value double").repartition(5)).collect()}
    assert out["good"].Rhat == pytest.approx(1, abs=0.01) and 1500 < out["good"].n_eff < 2600
    assert out["bad"].Rhat > 1.5 and out["bad"].n_eff < 50
    assert 60 < out["walk"].n_eff < 180
    assert out["good"].mean == pytest.approx(good.mean()) and out["good"].sd == pytest.approx(good.std(ddof=1))
    assert out["bad"].q90 == pytest.approx(np.quantile(bad, 0.9))
    check = {r.diagnostic: r for r in G.diagnostics_check(spark.createDataFrame([tuple(out[p][c] for c in ("Rhat", "n_eff")) for p in out], "Rhat double, n_eff double")).collect()}
    assert (check["Rhat"].parameters, check["Rhat"].failed >= 1, check["n_eff"]["pass"]) == (3, True, False)


def test_density_integrates_to_one_and_matches_direct_sum(spark):
    rng = np.random.default_rng(4)
    x = rng.gamma(2, 1, 3000)
    out = X.density(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"]).orderBy("x").toPandas()
    assert np.trapezoid(out.density, out.x) == pytest.approx(1, abs=0.01)
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * 3000**-0.2
    direct = [np.exp(-0.5 * ((p - x) / bw) ** 2).sum() / (np.sqrt(2 * np.pi) * bw * 3000) for p in out.x]
    assert np.allclose(out.density, direct, atol=2e-3)


def test_charts(spark, pred):
    keys = ["model_id", "cat", "year"]
    table = K.contrast(pred, -2, "year", "cat", ["model_id"])
    res = S.posterior_summary(table, keys, 40)
    density = C.change_density(table, res, keys, "year", "positive", "cat", by=["model_id"])
    # Category B has no time 3, so its last time has nothing to compare with.
    assert {(r.model_id, r.cat) for r in density.select("model_id", "cat").distinct().collect()} == {("m", "A"), ("n", "A")}
    lines = C.spaghetti_table(pred, keys, 7, ["model_id"])
    assert lines.groupBy(*keys).count().where("count <> 7").count() == 0
    ribbon = C.ribbon_table(res, keys).collect()
    assert all(r.low <= r.middle <= r.high for r in ribbon)
    draws = spark.createDataFrame([("m", 0, False, [1.0, 2.0]), ("m", 1, True, [3.0, 4.0])], "model_id string, draw int, divergent boolean, beta array<double>")
    terms = spark.createDataFrame([("m", ["a", "b"])], "model_id string, coefficients array<string>")
    rows = {(r.draw, r.parameter): (r.value, r.divergent) for r in C.parameter_rows(draws, terms).collect()}
    assert rows == {(0, "a"): (1.0, False), (0, "b"): (2.0, False), (1, "a"): (3.0, True), (1, "b"): (4.0, True)}
    assert G.divergence_flags(draws, ["model_id"]).first().divergent == [False, True]


def test_explore_bundle_and_constant_columns(spark):
    df = spark.createDataFrame(
        [("A" if i % 3 else "B", "k", float(i % 7), 1.0, None, i % 2) for i in range(60)], "cat string, k string, x double, one double, nothing string, prop int"
    )
    slim = X.drop_constant(df)
    assert slim.columns == ["cat", "x", "prop"]
    bundle = X.explore(slim, "prop")
    assert set(bundle) == {"level_counts", "box_summary", "histogram", "density", "binned_mean", "pair_correlations"}
    assert {r.level: r.n for r in bundle["level_counts"].collect()} == {"A": 40, "B": 20}
    assert X.level_counts(df, ["cat"], max_levels=2).count() == 0
    assert X.histogram(df, ["one"]).collect()[0].bin == 1


def test_arrays_keep_any_numbering(spark):
    rows = [("m", i, float(i)) for i in range(1, 6)] + [("n", i, float(i)) for i in (1, 3, 5)]
    df = spark.createDataFrame(rows, "model_id string, draw int, pred double")
    found = {r.model_id: r.pred for r in S.to_arrays(df, "model_id", 5).collect()}
    assert found == {"m": [1.0, 2.0, 3.0, 4.0, 5.0], "n": [1.0, None, 3.0, None, 5.0]}
    far = S.to_arrays(df.withColumn("draw", F.col("draw") + 1000), "model_id", 3).where("model_id = 'm'").first().pred
    assert far == [1.0, 2.0, 3.0, 4.0, 5.0]
