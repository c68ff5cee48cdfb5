"""Semantics of list lengths, filters, rates and detection on hand-made records."""

import math
from decimal import Decimal
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaflow.functions.likelihood import add_likelihood, count_classes
from taxaflow.functions.links import clamp_proportion, geo_mean, inverse_link
from taxaflow.functions.text import declining_text, interval_text, lower_text, plain_number, quantile_name, sentence_list
from taxaflow.operators import cooccur as C
from taxaflow.operators.detection import detection_history, number_visits, slices_of, visits_wide
from taxaflow.operators.lists import add_list_length
from taxaflow.operators.occupancy import estimate, occupancy_fit
from taxaflow.operators.quantiles import group_quantiles
from taxaflow.operators.reporting import latest_time, reporting_rate
from taxaflow.operators.sufficiency import filter_list_df, filter_reasons

RECORDS = [
    ("a", "L1", 1, 2000), ("b", "L1", 1, 2000), (None, "L1", 1, 2000), ("a", "L1", 1, 2000), ("a", "L2", 0, 2001),
    ("b", "L2", None, 2001), ("a", None, 1, 2002), ("b", None, 1, 2002), ("z", "L3", 0, 2003), ("a", "L3", 1, 2003),
]
SCHEMA = "taxa string, list string, success int, year int"


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_list_length_counts_null_taxon_and_null_context(spark):
    out = add_list_length(spark.createDataFrame(RECORDS, SCHEMA), "taxa", ["list"], create_list_col=True)
    assert out.count() == len(RECORDS)
    lengths = {(r["list"], r["list_length"]) for r in out.collect()}
    assert lengths == {("L1", 3), ("L2", None), ("NA", 2), ("L3", 1)}


def test_list_length_replaces_an_existing_one_and_checks_names(spark):
    df = spark.createDataFrame(RECORDS, SCHEMA).withColumn("list_length", F.lit(99))
    assert add_list_length(df, "taxa", ["list"]).where("list_length = 99").count() == 0
    with pytest.raises(ValueError, match="unknown columns"):
        add_list_length(df, "taxon", ["list"])


def test_nan_is_not_a_presence(spark):
    df = spark.createDataFrame([("a", "L", float("nan")), ("b", "L", 1.0)], "taxa string, list string, success double")
    assert values(add_list_length(df, "taxa", ["list"]), "taxa", "list_length") == [("a", 1), ("b", 1)]


def taxon(name, years, length=10, per_year=4, success=1):
    return [(name, y, length, success) for y in years for _ in range(per_year)]


def kept(spark, rows, **rules):
    df = spark.createDataFrame(rows, "taxa string, year int, list_length int, success int")
    given = {"max_year": 2010, "min_year": 2005, "max_gap": 10, **rules}
    return {r.taxa for r in filter_list_df(df, "taxa", **given).select("taxa").distinct().collect()}


YEARS = [2000, 2004, 2008, 2011]


def test_each_rule_removes_on_equality_and_keeps_one_past(spark):
    rows = taxon("good", YEARS)
    rows += taxon("short", YEARS, length=3) + taxon("short_past", YEARS, length=4)
    rows += taxon("few", [2000, 2004, 2008, 2010, 2011], per_year=1) + taxon("few_past", [2000, 2002, 2004, 2008, 2010, 2011], per_year=1)
    rows += taxon("years", [2000, 2006, 2011]) + taxon("late", [2005, 2007, 2009, 2011]) + taxon("late_past", [2004, 2007, 2009, 2011])
    rows += taxon("early", [2000, 2004, 2008, 2010]) + taxon("gap", [1998, 2000, 2001, 2011]) + taxon("gap_past", [1999, 2000, 2002, 2011])
    assert kept(spark, rows) == {"good", "short_past", "few_past", "late_past", "gap_past"}


def test_taxon_with_zeros_only_stays_and_zero_rows_return(spark):
    rows = taxon("zeros", YEARS, success=0) + taxon("good", YEARS) + taxon("good", [1990], success=0)
    df = spark.createDataFrame(rows, "taxa string, year int, list_length int, success int")
    out = filter_list_df(df, "taxa", max_year=2010, min_year=2005, max_gap=10)
    assert out.count() == len(rows)


def test_unknown_length_or_time_escapes_its_rule_and_unknown_time_counts(spark):
    rows = [("a", y, None if y == 2000 else 1, 1) for y in YEARS] + [("b", None, 5, 1), ("b", 2000, 5, 1), ("b", 2001, 5, 1)]
    df = spark.createDataFrame(rows, "taxa string, year int, list_length int, success int")
    out = {r.taxa: r for r in filter_reasons(df, "taxa", max_year=2010, min_year=2005, remove_0=False).collect()}
    assert not out["a"].shortest_max and out["a"].longest_list is None
    assert out["b"].times == 3 and not out["b"].max_year and not out["b"].min_year


def test_zero_gap_limit_removes_every_taxon(spark):
    assert kept(spark, taxon("good", YEARS), max_gap=0) == set()


def test_result_does_not_depend_on_partitioning(spark):
    rows = taxon("good", YEARS) + taxon("short", YEARS, length=2)
    df = spark.createDataFrame(rows, "taxa string, year int, list_length int, success int")
    results = [
        values(filter_list_df(df.repartition(n), "taxa", max_year=2010, min_year=2005), "taxa", "year") for n in (1, 4, 16)
    ]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize(
    "data, na_rm, expected",
    [
        ([1.0, 4.0], False, 2.0), ([1.0, 4.0, None], False, None), ([1.0, 4.0, None], True, 2.0), ([1.0, float("nan")], False, None),
        ([1.0, float("nan")], True, 1.0), ([1.0, 0.0], False, None), ([None], True, None),
    ],
)
def test_geo_mean(spark, data, na_rm, expected):
    df = spark.createDataFrame([(v,) for v in data], "x double")
    got = df.agg(geo_mean(F.col("x"), na_rm).alias("g")).first().g
    assert got == (None if expected is None else pytest.approx(expected))


def test_likelihood_edges(spark):
    probs = [0.0, 0.01, 0.01 + 1e-9, 0.33, 0.66, 0.9, 1.0, -0.1, 1.1, None]
    out = add_likelihood(spark.createDataFrame([(p,) for p in probs], "p double"), "p").collect()
    assert [r.likelihood_ord for r in out] == [1, 1, 2, 4, 5, 6, 9, None, None, None]
    counts = count_classes(spark.createDataFrame([(0.95,), (0.96,)], "p double"), "p").collect()
    assert {r.likelihood_ord: r.rows for r in counts} == {**{i: 0 for i in range(1, 10)}, 7: 1, 8: 1}


def test_text_functions(spark):
    row = spark.range(1).select(
        plain_number(F.lit(0.125)).alias("half"), plain_number(F.lit(2.0)).alias("whole"), plain_number(F.lit(-0.001)).alias("zero"),
        interval_text(F.lit(0.5), F.lit(0.25), F.lit(100.0)).alias("interval"),
        lower_text(F.lit("Very likely"), F.lit(0.925), F.lit("An Island"), ["An Island"]).alias("island"),
        declining_text(F.lit("Likely"), F.lit(0.57)).alias("declining"),
        *[sentence_list(F.array(*map(F.lit, x))).alias(f"s{len(x)}") for x in (["a"], ["b", "a"], ["c", "a", "b"])],
    ).first()
    assert (row.half, row.whole, row.zero) == ("0.12", "2", "0")
    assert row.interval == "0.5 (0.25 to 100)"
    assert row.island == "very likely to be lower on An Island (92% chance)"
    assert row.declining == "likely to be declining (57% chance)"
    assert (row.s1, row.s2, row.s3) == ("a", "a and b", "a, b and c")
    assert [quantile_name(p) for p in (0.005, 0.025, 0.05, 0.5)] == ["q00_5", "q02_5", "q05", "q50"]


def test_links_and_clamp(spark):
    row = spark.range(1).select(
        inverse_link(F.lit(0.0)).alias("l"), inverse_link(F.lit(1.0), "log").alias("e"), clamp_proportion(F.lit(0.0)).alias("lo"),
        clamp_proportion(F.lit(1.0)).alias("hi"), clamp_proportion(F.lit(0.5)).alias("mid"),
    ).first()
    assert (row.l, row.e, row.lo, row.hi, row.mid) == (0.5, pytest.approx(math.e), 1e-6, 1 - 1e-6, 0.5)


@pytest.mark.parametrize("n", [1, 2, 5, 20_000])
def test_quantiles_of_large_skewed_and_tied_groups(spark, n):
    rng = np.random.default_rng(n)
    wild = np.exp(rng.normal(0, 3, n))
    tied = rng.integers(0, 3, n).astype(float)
    rows = [("wild", float(v)) for v in wild] + [("tied", float(v)) for v in tied] + [("tied", None)]
    probs = [0, 0.005, 0.1, 0.5, 0.9, 0.995, 1]
    out = group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v", probs, few_values=False).collect()
    for r in out:
        want = np.quantile(wild if r.g == "wild" else tied, probs)
        assert np.allclose([r[quantile_name(p)] for p in probs], want, rtol=1e-12)


def test_quantiles_without_group_and_with_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert {r.g: r.q50 for r in group_quantiles(df, "g", "v", [0.5]).collect()} == {None: 1.5, "a": 5.0}
    assert group_quantiles(df, None, "v", [0.5]).first().q50 == 2.0


def test_visits(spark):
    rows = [("s", d, i, s) for i, (d, s) in enumerate([(3, 1), (1, 0), (1, 1), (2, None)])] + [("t", 1, 9, 1)]
    df = spark.createDataFrame(rows, "site string, day int, id int, success int")
    assert values(number_visits(df, "site", ["day", "id"]), "site", "id", "visit") == [
        ("s", 0, 4), ("s", 1, 1), ("s", 2, 2), ("s", 3, 3), ("t", 9, 1)
    ]
    history = values(detection_history(df, [], "site", ["day", "id"]), "site", "visit", "success")
    assert history == [("s", 1, 0), ("s", 2, 1), ("s", 3, None), ("s", 4, 1), ("t", 1, 1)]
    wide = {r.site: (r.visit_1, r.visit_2, r.visit_3, r.visit_4) for r in visits_wide(df, [], "site", ["day", "id"]).collect()}
    assert wide == {"s": (0, 1, None, 1), "t": (1, None, None, None)}


def test_long_history_is_whole(spark):
    df = spark.range(2500).select(F.lit("s").alias("site"), F.col("id").alias("day"), (F.col("id") % 2).cast("int").alias("success"))
    rows = detection_history(df, [], "site", ["day"]).orderBy("visit").collect()
    assert [(r.visit, r.success) for r in rows] == [(i + 1, i % 2) for i in range(2500)]


def simulate_cell(rng, year, psi, p, sites, visits):
    rows = []
    for s in range(sites):
        here = rng.random() < psi
        rows += [("x", "g", year, f"s{s}", int(here and rng.random() < p)) for _ in range(visits)]
    return rows


def test_occupancy_recovers_and_reports_status(spark):
    rng = np.random.default_rng(1)
    rows = sum((simulate_cell(rng, y, 0.6, 0.5, 400, 4) for y in range(2000, 2003)), [])
    rows += simulate_cell(rng, 2003, 0.6, 0.5, 50, 1) + [("x", "g", 2004, f"s{i}", 0) for i in range(5)] + [("x", "g", 2005, "s1", 1)]
    df = spark.createDataFrame(rows, "taxa string, geo string, year int, site string, success int")
    out = {r.year: r for r in occupancy_fit(df, ["geo"], ["site"], ["taxa"]).collect()}
    assert set(out) == {2000, 2001, 2002, 2003, 2004}
    for year in (2000, 2001, 2002):
        assert out[year].occ == pytest.approx(0.6, abs=0.08) and out[year].det == pytest.approx(0.5, abs=0.06)
    assert (out[2003].occ, out[2003].status) == (None, "not separable")
    assert (out[2004].occ, out[2004].status) == (1e-8, "no detections")


def test_occupancy_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(5)
    rows = sum((simulate_cell(rng, y, 0.5, 0.4, 60, 3) for y in range(2000, 2004)), [])
    df = spark.createDataFrame(rows, "taxa string, geo string, year int, site string, success int")
    out = {r.year: r for r in occupancy_fit(df, ["geo"], ["site"], ["taxa"]).collect()}
    grid = np.linspace(0.001, 0.999, 999)
    psi, p = np.meshgrid(grid, grid, indexing="ij")
    for year, r in out.items():
        det = {}
        for _, _, y, s, x in rows:
            if y == year:
                det[s] = det.get(s, 0) + x
        total = sum(np.log(psi * p**d * (1 - p) ** (3 - d) + (1 - psi) * (d == 0)) for d in det.values())
        i, j = np.unravel_index(np.argmax(total), total.shape)
        assert r.occ == pytest.approx(grid[i], abs=2e-3) and r.det == pytest.approx(grid[j], abs=2e-3)


def log_likelihood(cell, psi, p):
    seen = cell["detected"] * np.log(psi) + cell["detections"] * np.log(p)
    gone = cell["detected_visits"] - cell["detections"]
    seen += gone * np.log1p(-p) if gone else 0
    return seen + sum(c * np.log1p(-psi * (1 - (1 - p) ** n)) for n, c in cell["missed"])


def test_profile_steps_reach_the_maximum_everywhere(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        visits = rng.integers(2, 9, size=rng.integers(3, 80))
        psi, p = rng.choice([0.02, 0.3, 0.9, 1.0]), rng.choice([0.003, 0.05, 0.4, 0.97, 1.0])
        found = [(int(n), int(rng.binomial(n, p)) if rng.random() < psi else 0) for n in visits]
        rows.append(cell(i, found))
    rows.append(cell(60, [(500, 1)] + [(500, 0)] * 4000))  # detections are rare: p near 0
    rows.append(cell(61, [(4, 4)] * 5 + [(1, 0)] * 100))  # no miss at a detected site
    rows.append(cell(62, [(3, 1), (2, 1)]))  # no undetected site
    schema = "id int, n_sites long, detected long, detected_visits long, detections long, visits long, most_visits long, missed array<struct<n:double,c:double>>"
    for r in estimate(spark.createDataFrame(rows, schema)).collect():
        if r.detections == 0:
            continue
        assert (r.status, r.converged) == ("ok", True), r
        c = r.asDict()
        best = log_likelihood(c, r.psi, r.p) if r.p < 1 or c["detected_visits"] == c["detections"] else -np.inf
        for dpsi in (0.9, 0.999, 1, 1.001, 1.1):
            for dp in (0.9, 0.999, 1, 1.001, 1.1):
                psi, p = min(r.psi * dpsi, 1.0), r.p * dp
                if p < 1:
                    assert log_likelihood(c, psi, p) <= best + 1e-9 * (1 + abs(best)), (r, dpsi, dp)


def cell(i, found):
    """Sufficient counts of a cell from ``(visits, detections)`` of its sites."""
    hit, lost = [f for f in found if f[1]], [n for n, d in found if not d]
    missed = [(float(n), float(lost.count(n))) for n in sorted(set(lost))]
    visits = [n for n, _ in found]
    return i, len(found), len(hit), sum(n for n, _ in hit), sum(d for _, d in hit), sum(visits), max(visits), missed


def hypergeometric(n, a, b, obs):
    pmf = {j: math.comb(a, j) * math.comb(n - a, b - j) / math.comb(n, b) for j in range(max(0, a + b - n), min(a, b) + 1)}
    return sum(v for j, v in pmf.items() if j <= obs), sum(v for j, v in pmf.items() if j >= obs), pmf.get(obs, 0)


def test_cooccurrence_against_full_enumeration(spark, monkeypatch):
    rng = np.random.default_rng(2)
    taxa = [f"t{i}" for i in range(9)]
    found = {t: {s for s in range(25) if rng.random() < 0.15 + 0.08 * i} for i, t in enumerate(taxa)}
    rows = [(t, f"s{s}", 2000) for t, sites in found.items() for s in sites] * 2
    df = spark.createDataFrame(rows, "taxa string, place string, year int")
    n = len(set().union(*found.values()))
    for block in (512, 2):
        monkeypatch.setattr(C, "BLOCK", block)
        monkeypatch.setattr(C, "TASK_ROWS", 10)
        out = C.cooccur_test(df, "taxa", ["place", "year"], thresh=False).collect()
        assert {(r.taxon_a, r.taxon_b) for r in out} == set(combinations(taxa, 2))
        for r in out:
            a, b = found[r.taxon_a], found[r.taxon_b]
            le, ge, _ = hypergeometric(n, len(a), len(b), len(a & b))
            assert (r.observed, r.all_sites, r.sites_a) == (len(a & b), n, len(a))
            assert r.p_lt == pytest.approx(le, abs=1e-12) and r.p_gt == pytest.approx(ge, abs=1e-12)


def test_shared_bits_equal_a_matrix_product():
    rng = np.random.default_rng(0)
    x, y = rng.random((12, 5000)) < 0.3, rng.random((9, 5000)) < 0.001
    y[4] = False
    y[5, 4999] = True
    rows = lambda m: [np.flatnonzero(line) for line in m if line.any()]
    for left, right in ((x, x), (x, y), (y, x), (y, y)):
        want = left[left.any(axis=1)].astype(int) @ right[right.any(axis=1)].astype(int).T
        a, b, count = C.shared_bits(rows(left), rows(right))
        assert len(a) == (want > 0).sum() and (want[a, b] == count).all()
    assert len(C.shared_bits([], rows(x))[0]) == 0


def test_extreme_tails_keep_their_digits(spark):
    rows = [
        (100_000, 30_000, 20_000, 12_000), (100_000, 30_000, 20_000, 1_000), (2_000, 900, 900, 900), (2_000, 900, 900, 0),
        (50, 50, 20, 20), (50, 1, 1, 0), (50, 1, 1, 1), (1, 1, 1, 1), (40, 30, 30, 20), (1_000_000, 2_000, 3_000, 6),
    ]
    got = C.add_tail_probabilities(spark.createDataFrame(rows, "all_sites long, sites_a long, sites_b long, observed long")).collect()
    for r in got:
        big, a, b, x = r.all_sites, r.sites_a, r.sites_b, r.observed
        low, high = max(0, a + b - big), min(a, b)
        # Exact whole numbers, as far from the observed count as they matter.
        term = comb(a, x) * comb(big - a, b - x)
        up, w = term, term
        for j in range(x, high):
            w = w * (a - j) * (b - j) // ((j + 1) * (big - a - b + j + 1))
            up += w
            if w * 10**25 < up:
                break
        down, w = term, term
        for j in range(x, low, -1):
            w = w * j * (big - a - b + j) // ((a - j + 1) * (b - j + 1))
            down += w
            if w * 10**25 < down:
                break
        small, total = min(up, down), comb(big, b)
        want = Decimal(small) / Decimal(total)
        have = Decimal(r.p_gt if up <= down else r.p_lt)
        if want > Decimal("1e-300"):
            assert abs(have / want - 1) < Decimal("1e-9"), (r, want)
        assert max(r.p_lt, r.p_gt) == pytest.approx(1 if want < 1e-12 else float(1 - want + Decimal(term) / Decimal(total)), abs=1e-11)


def test_cooccurrence_never_meets_in_one_partition(spark):
    df = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2"), (None, "s2")], "taxa string, place string")
    out = C.cooccur_test(df, "taxa", ["place"], thresh=False)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.taxon_a, r.taxon_b): r.observed for r in out.collect() if r.observed} == {("a", "b"): 1, (None, "c"): 1}


def test_cooccurrence_threshold_drops_rare_pairs_only(spark):
    rows = [("rare", "s0")] + [("common", f"s{i}") for i in range(8)] + [("half", f"s{i}") for i in range(4, 10)]
    df = spark.createDataFrame(rows, "taxa string, place string")
    every = {(r.taxon_a, r.taxon_b): r.expected for r in C.cooccur_pairs(df, "taxa", ["place"], thresh=False).collect()}
    some = {(r.taxon_a, r.taxon_b) for r in C.cooccur_pairs(df, "taxa", ["place"]).collect()}
    assert some == {pair for pair, e in every.items() if e >= 1} and len(every) == 3


def test_reporting_rate_and_latest_time(spark):
    df = spark.createDataFrame([("a", 1, 2, 4), ("a", 2, 1, 0), ("b", 5, 1, 2)], "g string, year int, success int, trials int")
    assert values(reporting_rate(df, ["g"], trials_col="trials"), "g", "prop") == [("a", 0.75), ("b", 0.5)]
    assert values(reporting_rate(df.where("trials = 0"), ["g"], trials_col="trials"), "prop") == [(None,)]
    assert values(latest_time(df, ["g"], "year"), "g", "year") == [("a", 2), ("b", 5)]


@pytest.mark.parametrize("lead", ["constant", "unique"])
def test_visits_of_one_site_are_numbered_in_even_slices(spark, lead):
    rows = spark.range(20_000).select(
        F.lit("hot").alias("site"), (F.lit(7) if lead == "constant" else F.col("id") * 7919 % 20_011).alias("first"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("then"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sliced = slices_of(rows.repartition(8), ["site"], ["first", "then"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in sliced.groupBy("__slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = number_visits(rows.repartition(8), ["site"], ["first", "then"]).orderBy("visit").collect()
    assert [r.visit for r in got] == list(range(1, 20_001))
    assert all((a["first"], a["then"]) <= (b["first"], b["then"]) for a, b in zip(got, got[1:]))
