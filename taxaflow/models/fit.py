"""Fitting trend models of all groups in the same passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.functions.keys import attach, join_same
from taxaflow.functions.links import inverse_link
from taxaflow.models.design import NO_CAT, build_design, dot, width, with_features
from taxaflow.models.solve import Solution, Weights, curvature, gather, layout, nearest_covariance, next_pace, normals, solve_with_weights
from taxaflow.session import discard, durable

LINKS = {"binomial": "logit", "gaussian": "identity", "beta": "logit"}
#: Variances that random effects start from.
START = 0.5


@dataclass(frozen=True)
class TrendFit:
    """Tables of fitted models.

    ``spec``: one row per model with status, dispersion, variances and the penalty of
    the shared curve.  ``coef``: estimates by name.  ``draws``: per model and category
    an array of draws, each the coefficients of a design row.  ``design``: scales and
    knots.  ``weights``: penalty of each category's own curve.  ``levels``: random
    effects with their covariance given the coefficients, and ``links``, per level and
    category, how the effects move with the coefficients; or None.
    """

    spec: DataFrame
    coef: DataFrame
    draws: DataFrame
    design: DataFrame
    weights: DataFrame
    levels: DataFrame | None
    links: DataFrame | None
    k: int | None
    link: str
    by: str


def _schema(df: DataFrame, by: str, rest: str) -> T.StructType:
    return T.StructType([df.schema[by], *T.StructType.fromDDL(rest).fields])


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Few bytes but much arithmetic per row: keep all shuffle partitions instead of merging small ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _working(family: str, eta: Column) -> tuple[Column, Column, Column]:
    """Weight, score residual and squared Pearson residual of a pattern, before dispersion."""
    n, y, y_sq = F.col("n_rows").cast("double"), F.col("y"), F.col("y_sq")
    if family == "gaussian":
        return n, y - n * eta, y_sq - 2 * eta * y + n * eta * eta
    mu = inverse_link(eta)
    unit = F.greatest(mu * (1 - mu), F.lit(1e-10))
    if family == "binomial":
        return F.col("y_total") * unit, y - F.col("y_total") * mu, F.lit(0.0)
    return n * unit, y - n * mu, (y_sq - 2 * mu * y + n * mu * mu) / unit


def _first_eta(family: str) -> Column:
    """Linear predictor to start from, out of the data of the pattern itself."""
    if family == "gaussian":
        return F.lit(0.0)
    trials = F.col("y_total") if family == "binomial" else F.col("n_rows").cast("double")
    share = (F.col("y") + 0.5) / (trials + 1)
    return F.ln(share / (1 - share))


def _sums(family: str, q: int) -> list[Column]:
    """Aggregates of a pass: cross products, right side, Pearson sum."""
    u, eta, phi = F.col("u"), F.col("__eta"), F.col("__phi")
    weight, score, pearson = _working(family, eta)
    weight, score = weight / phi, score / phi
    upper = {(i, j): F.sum(weight * u[i] * u[j]) for i in range(q) for j in range(i, q)}
    return [
        F.array(*[upper[min(i, j), max(i, j)] for i in range(q) for j in range(q)]).alias("h"),
        F.array(*[F.sum(u[i] * (weight * eta + score)) for i in range(q)]).alias("g"),
        F.sum(pearson).alias("pearson"),
    ]


def _pass_over(patterns: DataFrame, coef: DataFrame | None, levels: DataFrame | None, by: str, family: str, q: int, start_phi: DataFrame, t: int) -> DataFrame:
    """Normal equations per model, category and, with random effects, level."""
    keys = [by, "cat", *(["rand"] if t else [])]
    if coef is None:
        rows = attach(patterns, start_phi, [by]).withColumn("__eta", _first_eta(family))
    else:
        state = coef.select(by, "cat", "beta", F.col("phi").alias("__phi"))
        rows = attach(patterns, state, [by, "cat"], "inner").withColumn("__eta", dot(F.col("u"), F.col("beta"), q))
        if t:
            rows = join_same(rows, levels.select(by, "rand", "b"), [by, "rand"])
            extra = F.coalesce(F.col("b")[0], F.lit(0.0))
            if t == 2:
                extra = extra + F.coalesce(F.col("b")[1], F.lit(0.0)) * F.col("u")[1]
            rows = rows.withColumn("__eta", F.col("__eta") + extra)
        if family != "gaussian":
            rows = rows.withColumn("__eta", F.greatest(F.least("__eta", F.lit(30.0)), F.lit(-30.0)))
    return rows.groupBy(*keys).agg(*_sums(family, q), *([F.first("times").alias("times")] if t else []))


def _kinds(patterns: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Levels with equal patterns are one kind: patterns of one level of each kind, with how many there are (``times``), and all levels with their ``kind``.

    Such levels have the same equations and the same effects in every round.  The kind
    is named by its smallest level.  Levels are compared by 128 bits of hashes that are
    summed up pattern by pattern, so no level meets in one row.
    """
    cols = [c for c in ("cat", "var", "use_cov", "y", "y_total", "y_sq", "n_rows") if c in patterns.columns]
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *cols))
    marks = ["__one", "__two", "__n"]
    levels = durable(patterns.groupBy(by, "rand").agg(mark(1).alias("__one"), mark(2).alias("__two"), F.count(F.lit(1)).alias("__n")))
    kinds = durable(levels.groupBy(by, *marks).agg(F.min("rand").alias("kind"), F.count(F.lit(1)).alias("times")))
    first = kinds.select(by, F.col("kind").alias("rand"), "times")
    members = join_same(levels, kinds.select(by, *marks, "kind"), [by, *marks], "inner").select(by, "rand", "kind")
    return durable(join_same(patterns, first, [by, "rand"], "inner")), members


def _eliminate(stats: DataFrame, sigma: DataFrame, by: str, q: int, t: int) -> DataFrame:
    """Take the random levels out of the normal equations, level by level.

    A level adds a small block per pair of categories it occurs in (usually one);
    Spark sums the blocks of all levels, so a model with very many levels never
    meets in one task.  All levels of a batch are done at once, those of a kind as one.
    """
    per_level = _spread(stats, by, "rand").groupBy(by, "rand").agg(F.first("times").alias("times"), F.collect_list(F.struct("cat", "h", "g", "pearson")).alias("parts"))
    rows = join_same(per_level, sigma.select(by, "sigma"), [by], "inner").select(by, "times", "sigma", "parts")
    names = [f"h{i}" for i in range(q * q)] + [f"g{i}" for i in range(q)] + ["pearson"]
    key = stats.schema[by]
    schema = T.StructType(
        [key, T.StructField("cat_a", T.StringType()), T.StructField("cat_b", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def reduce_levels(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            sizes = np.diff(rows.column("parts").offsets.to_numpy())
            parts = rows.column("parts").flatten()
            level = np.repeat(np.arange(rows.num_rows), sizes)
            first = np.r_[0, np.cumsum(sizes)[:-1]]
            h, g, cov = (_numbers(x) for x in (parts.field("h"), parts.field("g"), rows.column("sigma")))
            h, g, cov = h.reshape(-1, q, q), g.reshape(-1, q), cov.reshape(-1, t, t)
            times = rows.column("times").to_numpy().astype(float)
            inner = np.add.reduceat(h[:, :t, :t], first)
            middle = cov @ np.linalg.inv(np.eye(t) + inner @ cov)
            side = h[:, :, :t] @ middle[level]
            right = g - np.einsum("nij,nj->ni", side, np.add.reduceat(g[:, :t], first)[level])
            # every part with every part of its level
            a = np.repeat(np.arange(len(parts)), sizes[level])
            b = np.arange(len(a)) - np.repeat(np.cumsum(sizes[level]) - sizes[level], sizes[level]) + first[level[a]]
            same = a == b
            block = h[a] * same[:, None, None] - side[a] @ h[b][:, :, :t].transpose(0, 2, 1)
            pearson = _numbers(parts.field("pearson"))
            values = np.concatenate([block.reshape(len(a), -1), right[a] * same[:, None], (pearson[a] * same)[:, None]], axis=1) * times[level[a]][:, None]
            models, cats = rows.column(by).dictionary_encode(), parts.field("cat").dictionary_encode()
            model, cat = models.indices.to_pandas().fillna(-1).to_numpy(np.int64), cats.indices.to_numpy()
            out = pd.DataFrame(values, columns=names).groupby([model[level[a]], cat[a], cat[b]], sort=False).sum()
            which = [pa.array(out.index.get_level_values(i).to_numpy()) for i in range(3)]
            none = pc.equal(which[0], -1)
            keys = [models.dictionary.take(pc.if_else(none, pa.scalar(None, pa.int64()), which[0])), *(cats.dictionary.take(x) for x in which[1:])]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(out[n].to_numpy()) for n in names)], [by, "cat_a", "cat_b", *names])

    blocks = rows.mapInArrow(reduce_levels, schema)
    summed = blocks.groupBy(by, "cat_a", "cat_b").agg(*[F.sum(n).alias(n) for n in names])
    return summed.select(
        by, "cat_a", "cat_b", F.array(*names[: q * q]).alias("h"), F.array(*names[q * q : -1]).alias("g"), "pearson"
    )


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers of a column of numbers or of arrays of numbers, missing ones as NaN."""
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).astype(float)


STATE = "cat string, beta array<double>, phi double, weight_all double, weight_own double, weights_settled boolean, delta double, pace double, step array<double>, step_phi double, message string"


def _with_state(equations: DataFrame, info: DataFrame, state: DataFrame | None, by: str) -> DataFrame:
    rows = join_same(equations, info, [by], "inner")
    if state is None:
        return rows
    kept = [F.col("cat").alias("cat_a"), F.col("beta").alias("old"), "weight_all", "weight_own", "weights_settled", "phi", "pace", "step", "step_phi", F.col("message").alias("before")]
    return join_same(rows, state.select(by, *kept), [by, "cat_a"], "inner")


def _solve_models(equations: DataFrame, design: DataFrame, state: DataFrame | None, by: str, q: int, k: int | None, family: str, prior_scale) -> DataFrame:
    """New effective coefficients of every category, from one group of small blocks per model."""
    rows = _with_state(equations, design.select(by, "knots", "n_data", "__phi0"), state, by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cats = sorted(set(pdf["cat_a"]))
        fitted = solve_group(pdf, cats, q, k, family, prior_scale, True)
        out = pd.DataFrame(
            {"cat": cats, "beta": list(fitted["beta"]), "phi": fitted["phi"], "weight_all": fitted["weights"].shared,
             "weight_own": fitted["weights"].own, "weights_settled": fitted["settled"], "delta": fitted["delta"], "pace": fitted["pace"],
             "step": fitted["step"], "step_phi": fitted["step_phi"], "message": fitted["message"]}
        )
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return _spread(rows, by).groupBy(by).applyInPandas(solve, _schema(equations, by, STATE))


def solve_group(pdf: pd.DataFrame, cats: list[str], q: int, k: int | None, family: str, prior_scale, update: bool) -> dict:
    """Solve one model; a failure becomes a message, and the model stays at its last good state.

    Without ``update`` the penalty weights stay as they are.  ``delta`` is the length of
    the whole step; with a Beta response, whose dispersion moves with the curve, only a
    share of it is taken, so that rounds don't swing between two states.
    """
    n = len(cats)
    bend = None if k is None else curvature(np.asarray(pdf["knots"].iloc[0], float))
    out = {"beta": np.zeros((n, q)), "phi": 1.0, "weights": Weights(1.0, np.ones(n)), "settled": k is None, "delta": 0.0, "message": None,
           "pace": 1.0, "step": None, "step_phi": None}
    before = None
    if "old" in pdf:
        own = pdf[pdf["cat_a"] == pdf["cat_b"]].set_index("cat_a").loc[cats]
        first = own.iloc[0]
        before = np.array(list(own["old"]), float)
        weights = Weights(float(first["weight_all"]), own["weight_own"].to_numpy(float))
        out.update(beta=before, phi=float(first["phi"]), weights=weights, settled=bool(first["weights_settled"]))
        if isinstance(first["before"], str):
            return out | {"message": first["before"]}
    try:
        equations, shape = gather(cats, q, zip(pdf["cat_a"], pdf["cat_b"], pdf["h"], pdf["g"])), layout(cats, q, k)
        solution, weights, settled = solve_with_weights(equations, shape, bend, out["weights"], prior_scale, update)
        beta, phi = solution.beta, 1.0
        if family != "binomial":
            free = float(pdf["n_data"].iloc[0]) - solution.degrees(equations)
            phi = max(float(pdf["pearson"].sum()) / max(free, 1.0), 1e-12)
        delta = 1.0 if before is None else max(equations.length(beta - before), abs(phi - out["phi"]) / phi)
        if not (np.isfinite(delta) and np.isfinite(beta).all()):
            raise ValueError("estimates are not finite")
        if family == "beta" and update and before is not None:
            step, pace = (beta - before, float(np.log(phi / out["phi"]))), float(first["pace"])
            if first["step"] is not None:
                last = np.array(list(own["step"]), float), float(first["step_phi"])
                pace = next_pace(pace, step, last, equations, float(pdf["n_data"].iloc[0]))
            beta, phi = before + pace * step[0], out["phi"] * float(np.exp(pace * step[1]))
            out.update(pace=pace, step=list(step[0]), step_phi=step[1])
        out.update(solution=solution, beta=beta, phi=phi, weights=weights, settled=settled if update else out["settled"], delta=delta)
    except (np.linalg.LinAlgError, ValueError, FloatingPointError) as error:
        out["message"] = str(error)
    return out


def _update_levels(stats: DataFrame, coef: DataFrame, sigma: DataFrame, by: str, q: int, t: int) -> DataFrame:
    """Random effects given the new coefficients, with their covariance, and the parts of the score of their variances.

    With the information ``m`` and the score ``r`` of a level, w = (1 + m sigma)^-1 r
    and p = (1 + m sigma)^-1 m: the effects are sigma w, and the score of sigma is half
    the sum of w w' - p.  Nothing is divided by sigma, which may be zero.
    """
    joined = join_same(stats, coef.select(by, "cat", "beta"), [by, "cat"], "inner")

    def left_over(i: int) -> Column:
        total = F.col("g")[i]
        for j in range(q):
            total = total - F.col("h")[i * q + j] * F.col("beta")[j]
        return total

    sums = [F.sum(left_over(i)).alias(f"r{i}") for i in range(t)]
    sums += [F.sum(F.col("h")[i * q + j]).alias(f"m{i}{j}") for i in range(t) for j in range(i, t)]
    per_level = join_same(joined.groupBy(by, "rand").agg(*sums, F.first("times").alias("times")), sigma.select(by, "sigma"), [by], "inner")
    s = F.col("sigma")
    if t == 1:
        rows = per_level.withColumn("__k", 1 + F.col("m00") * s[0]).withColumns({"w0": F.col("r0") / F.col("__k"), "p00": F.col("m00") / F.col("__k")})
        return rows.select(by, "rand", F.array(s[0] * F.col("w0")).alias("b"), F.array(s[0] / F.col("__k")).alias("v"), "w0", "p00", "times")
    m00, m01, m11 = (F.col(x) for x in ("m00", "m01", "m11"))
    k00, k01, k10, k11 = 1 + m00 * s[0] + m01 * s[1], m00 * s[1] + m01 * s[3], m01 * s[0] + m11 * s[1], 1 + m01 * s[1] + m11 * s[3]
    rows = per_level.withColumns({"k00": k00, "k01": k01, "k10": k10, "k11": k11, "__det": k00 * k11 - k01 * k10})
    i00, i01, i10, i11 = (F.col(x) / F.col("__det") for x in ("k11", "k01", "k10", "k00"))
    rows = rows.withColumns({
        "w0": i00 * F.col("r0") - i01 * F.col("r1"), "w1": i11 * F.col("r1") - i10 * F.col("r0"),
        "p00": i00 * m00 - i01 * m01, "p01": i00 * m01 - i01 * m11, "p11": i11 * m11 - i10 * m01,
    })
    v00, v01, v11 = s[0] * i00 - s[1] * i10, s[1] * i11 - s[0] * i01, s[3] * i11 - s[1] * i01
    b = F.array(s[0] * F.col("w0") + s[1] * F.col("w1"), s[1] * F.col("w0") + s[3] * F.col("w1"))
    return rows.select(by, "rand", b.alias("b"), F.array(v00, v01, v01, v11).alias("v"), "w0", "w1", "p00", "p01", "p11", "times")


def _update_sigma(levels: DataFrame, sigma: DataFrame, by: str, t: int) -> DataFrame:
    """Variances of the random effects by a scoring step of their likelihood, and its length in standard errors.

    The step is Newton's with expected information, so a few rounds do; it ends at the
    nearest covariance, which may have no spread in a direction, or none at all.  A
    model with one level has no random term: its variances stay at zero.
    """
    w0, p00, n = F.col("w0"), F.col("p00"), F.col("times")
    many = F.sum(n).alias("__levels")
    if t == 1:
        sums = levels.groupBy(by).agg(F.sum(n * (w0 * w0 - p00)).alias("score"), F.sum(n * p00 * p00).alias("info"), F.sum(n * p00 * (2 * w0 * w0 - p00)).alias("curve"), many)
        # Newton's step where the likelihood is curved as expected, at most three times as long as a scoring step elsewhere
        sums = sums.withColumn("info", F.greatest("curve", F.col("info") / 3))
        old = F.col("sigma")[0]
        # at most tenfold and a bit in one step: far from the end the information is a poor guide
        wanted = F.least(old + F.col("score") / F.col("info"), 10 * old + 0.1)
        new = F.when((F.col("__levels") < 2) | F.isnull("info") | (F.col("info") <= 0), F.lit(0.0)).otherwise(F.greatest(wanted, F.lit(0.0)))
        found = join_same(sums, sigma.select(by, "sigma"), [by], "inner").select(by, F.array(new).alias("sigma"), (F.abs(new - old) * F.sqrt(F.col("info") / 2)).alias("step"))
        return found.withColumn("step", F.coalesce("step", F.lit(0.0)))
    w1, p01, p11 = F.col("w1"), F.col("p01"), F.col("p11")
    sums = levels.groupBy(by).agg(
        *[F.sum(n * x).alias(name) for name, x in {
            "g0": w0 * w0 - p00, "g1": 2 * (w0 * w1 - p01), "g2": w1 * w1 - p11,
            "i00": p00 * p00, "i01": 2 * p00 * p01, "i02": p01 * p01, "i11": 2 * (p00 * p11 + p01 * p01), "i12": 2 * p01 * p11, "i22": p11 * p11,
        }.items()], many,
    )

    def step(batches):
        for rows in batches:
            covariances, lengths = [], []
            for row in rows.itertuples(index=False):
                old = np.array([row.sigma[0], row.sigma[1], row.sigma[3]])
                info = np.array([[row.i00, row.i01, row.i02], [row.i01, row.i11, row.i12], [row.i02, row.i12, row.i22]]) / 2
                new = np.zeros(3)
                if row[-2] >= 2 and np.isfinite(info).all():
                    info = info + 1e-9 * np.trace(info) * np.eye(3) + 1e-300 * np.eye(3)
                    wanted = old + np.linalg.solve(info, np.array([row.g0, row.g1, row.g2]) / 2)
                    most = 10 * max(old[0], old[2]) + 0.1
                    wanted *= min(1.0, most / max(abs(wanted).max(), 1e-300))
                    new = nearest_covariance(wanted, info)
                covariances.append([new[0], new[1], new[1], new[2]])
                moved = new - old
                lengths.append(float(np.sqrt(max(moved @ info @ moved, 0.0))) if np.isfinite(info).all() else 0.0)
            yield pd.DataFrame({by: rows[by], "sigma": covariances, "step": lengths})

    rows = join_same(sums, sigma.select(by, "sigma"), [by], "inner")
    return rows.mapInPandas(step, _schema(levels, by, "sigma array<double>, step double"))


def fit_trend(
    patterns: DataFrame,
    by: str = "model_id",
    family: str = "binomial",
    k: int | None = None,
    rand_slope: bool = True,
    prior_scale: float | None = 2.5,
    n_draws: int = 1000,
    seed: int = 1,
    max_iter: int = 200,
    tol: float | None = None,
) -> TrendFit:
    """Fit ``y ~ var [+ use_cov] [+ cat + var:cat] [+ (var | rand)]`` to every model.

    ``patterns`` comes from ``compress_patterns``.  ``k`` asks for a penalised
    natural spline of ``k`` knots instead of a straight line, shared and per
    category.  Binomial and Gaussian likelihoods are exact, the Beta response
    uses its mean and variance only (quasi-likelihood).  Draws are Laplace draws
    around the fit; random effects are integrated out of the coefficients.

    A model is ``converged`` when the length of a step in standard errors, of the
    coefficients and of the variances of random effects, is at most ``tol``: 1e-4,
    after which the error is about its square, 1e-5 with an estimated dispersion, or
    1e-3 with random effects, whose steps shrink by a factor each time.
    A model that has not got there after ``max_iter`` rounds has the status "not
    converged".  Failed models stay as they are.  Linear predictors of binomial and
    Beta responses are kept within 30 of zero, where probabilities are 0 or 1 to 13
    digits.

    Each round is one aggregate over the stored patterns, and its small result is
    stored too, so a lost executor repeats at most that round.  When half of the models
    that a round works on are done, the patterns of the others are stored on their own:
    a slow model doesn't make the rest be read again.  Random levels with equal patterns
    are worked on as one, which counts as often as there are such levels.
    """
    if family not in LINKS:
        raise ValueError(f"unknown family {family!r}")
    q = width(k)
    patterns = patterns if "cat" in patterns.columns else patterns.withColumn("cat", F.lit(NO_CAT))
    t = 0 if "rand" not in patterns.columns else 2 if rand_slope else 1
    tol = tol if tol is not None else 1e-3 if t else 1e-4 if family == "binomial" else 1e-5
    needed = [c for c in ("var", "use_cov", "cat", "rand", "y", "y_total") if c in patterns.columns]
    # The source is read once; every later pass starts from the compressed patterns.
    patterns = durable(patterns.dropna("any", subset=needed).withColumn("cat", F.col("cat").cast("string")))
    variance = (F.col("__y_sq") - F.col("__y") * F.col("__y") / F.col("n_data")) / F.col("n_data")
    phi0 = {"binomial": F.lit(1.0), "beta": F.lit(0.1), "gaussian": F.greatest(variance, F.lit(1e-12))}[family]
    source, members = patterns, None
    if t:
        patterns, members = _kinds(source, by)
        discard(source)
        counts = members.groupBy(by).agg(F.count(F.lit(1)).alias("n_rand"))
        source = patterns.groupBy(by, *[c for c in ("var", "use_cov", "cat") if c in patterns.columns])
        source = source.agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("n_rows", "y", "y_sq")])
    found = build_design(source, by, k).withColumn("__phi0", phi0)
    design = durable(join_same(found.drop("n_rand"), counts, [by]).select(*found.columns) if t else found)
    source, patterns = patterns, durable(with_features(patterns, design, by, k))
    discard(source)
    start_phi = design.select(by, F.col("__phi0").alias("__phi"))

    coef = levels = None
    first = F.when(F.col("n_rand") < 2, 0.0).otherwise(START)
    none = F.lit(0.0)
    sigma = design.select(by, F.array(first, *([none, none, first] if t == 2 else [])).alias("sigma")) if t else None
    working, done, rounds = patterns, [], 0
    while True:
        stats = _pass_over(working, coef, levels, by, family, q, start_phi, t)
        if t:
            stats = durable(stats)
            equations = _eliminate(stats, sigma, by, q, t)
        else:
            equations = stats.select(by, F.col("cat").alias("cat_a"), F.col("cat").alias("cat_b"), "h", "g", "pearson")
        old = coef, levels, sigma
        coef = durable(_solve_models(equations, design, coef, by, q, k, family, prior_scale))
        rounds += 1
        verdict = coef.groupBy(by).agg(F.max(F.nanvl("delta", F.lit(float("inf")))).alias("__delta"), F.max("message").alias("__message"))
        if t:
            levels = durable(_update_levels(stats, coef, sigma, by, q, t))
            sigma = durable(_update_sigma(levels, sigma, by, t))
            verdict = join_same(verdict, sigma.select(by, "step"), [by]).withColumn("__delta", F.greatest("__delta", "step"))
            discard(stats)
        discard(*old)  # the next round has been stored
        over = (F.col("__delta") <= tol) | F.col("__message").isNotNull()
        verdict = verdict.select(by, F.col("__delta").alias("largest"), over.alias("over"), F.lit(rounds).alias("rounds"))
        n_over, n = verdict.agg(F.count_if("over"), F.count("*")).first()
        last = n_over == n or rounds >= max_iter
        if not last and 2 * n_over < n:
            continue
        verdict = durable(verdict)
        finished = verdict if last else verdict.where("over")
        done.append([durable(join_same(x, finished.select(by), [by], "left_semi")) if x is not None else None for x in (coef, levels, sigma, verdict)])
        if last:
            break
        parts = coef, levels, sigma, working
        coef, levels, sigma, working = (None if x is None else durable(join_same(x, verdict.where("not over").select(by), [by], "left_semi")) for x in parts)
        discard(*parts[:3], verdict, parts[3] if parts[3] is not patterns else None)

    coef, levels, sigma, verdict = (None if any(x is None for x in parts) else reduce(DataFrame.unionByName, parts) for parts in zip(*done))
    coef = durable(join_same(coef.drop("delta"), verdict.select(by, F.col("largest").alias("delta"), "rounds"), [by]))
    stats = _pass_over(patterns, coef, levels, by, family, q, start_phi, t)
    links = None
    if t:
        stats = durable(stats)
        equations = _eliminate(stats, sigma, by, q, t)
        kinds = durable(_update_levels(stats, coef, sigma, by, q, t).select(by, "rand", "b", "v"))
        moves = durable(_links(stats, kinds, coef, by, q, t))
        # every level has what its kind has
        of_all = lambda table: join_same(members, table.withColumnRenamed("rand", "kind"), [by, "kind"], "inner")
        levels, links = of_all(kinds).select(*kinds.columns), of_all(moves).select(*moves.columns)
    else:
        equations = stats.select(by, F.col("cat").alias("cat_a"), F.col("cat").alias("cat_b"), "h", "g", "pearson")
    final = durable(_posterior(equations, design, coef, by, q, k, family, prior_scale, n_draws, seed))
    fit = _tables(final, coef, design, levels, links, sigma, by, family, k, t, tol)
    discard(patterns, stats, *[x for parts in done for x in parts[:2]], working if working is not patterns else None)
    return fit


def _links(stats: DataFrame, levels: DataFrame, coef: DataFrame, by: str, q: int, t: int) -> DataFrame:
    """How the effects of a level move with the coefficients of a category, as ``move`` (t x q), around ``beta``.

    Given other coefficients, the mean of the effects is lower by the covariance of the
    effects times the information they share with the coefficients.
    """
    rows = join_same(stats.select(by, "cat", "rand", "h"), levels.select(by, "rand", "v"), [by, "rand"], "inner")
    rows = join_same(rows, coef.select(by, "cat", "beta"), [by, "cat"], "inner")
    v, h = F.col("v"), F.col("h")
    move = [sum((-v[i * t + m] * h[m * q + j] for m in range(1, t)), -v[i * t] * h[j]) for i in range(t) for j in range(q)]
    return rows.select(by, "cat", "rand", F.array(*move).alias("move"), "beta")


def _posterior(equations, design, coef, by, q, k, family, prior_scale, n_draws, seed) -> DataFrame:
    """Estimates by name, spreads and draws; one row per category."""
    info = design.select(by, "knots", "n_data", "var_scale", "cov_centre", "cov_scale")
    rows = _with_state(equations, info, coef, by)
    schema = _schema(
        equations, by, "cat string, draws array<array<double>>, terms array<string>, estimate array<double>, sd array<double>, message string"
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        cats = sorted(set(pdf["cat_a"]))
        model = pdf[by].iloc[0]
        fitted = solve_group(pdf, cats, q, k, family, prior_scale, False)
        out = pd.DataFrame({"cat": cats})
        if fitted["message"] is None:
            solution = fitted["solution"]
            effective = solution.draws(normals(seed, str(model), (solution.parameters(), n_draws)))
            out["draws"] = [list(np.ascontiguousarray(one.T)) for one in effective]
            names, estimate, spread = natural_scale(solution, pdf.iloc[0])
            first = [True] + [False] * (len(cats) - 1)
            out["terms"] = [names if f else None for f in first]
            out["estimate"] = [estimate if f else None for f in first]
            out["sd"] = [spread if f else None for f in first]
        else:
            out["draws"] = out["terms"] = out["estimate"] = out["sd"] = None
        out["message"] = fitted["message"]
        out.insert(0, by, model)
        return out

    return _spread(rows, by).groupBy(by).applyInPandas(finish, schema)


def natural_scale(solution: Solution, info: pd.Series) -> tuple[list[str], list[float], list[float]]:
    """Names, estimates and standard deviations in the units of the model frame."""
    shape = solution.shape
    change = np.eye(shape.q)
    scale = info["cov_scale"]
    constant = pd.isna(scale)
    change[-1, -1] = 0.0 if constant else 1 / scale
    change[0, -1] = 0.0 if constant else -info["cov_centre"] / scale
    slope = 1 / info["var_scale"] if shape.k is None else 1.0
    if shape.k is None:
        change[1, 1] = slope
    shared, spread = change @ solution.shared, np.sqrt(np.einsum("ij,jk,ik->i", change, solution.cov, change))
    rows = [(name, shared[i], spread[i]) for i, name in enumerate(shape.labels) if not (name == "use_cov" and constant)]
    for c, i, name in shape.own_names():
        by_scale = slope if i else 1.0
        rows.append((name, solution.own[c, i] * by_scale, np.sqrt(solution.cov_own[c, i, i]) * by_scale))
    names, estimates, spreads = zip(*rows)
    return list(names), [float(x) for x in estimates], [float(x) for x in spreads]


def _tables(final, coef, design, levels, links, sigma, by, family, k, t, tol) -> TrendFit:
    named = final.where(F.col("terms").isNotNull())
    rows = F.arrays_zip(F.col("terms").alias("term"), F.col("estimate").alias("estimate"), F.col("sd").alias("sd"))
    table = named.select(by, F.inline(rows))
    state = coef.groupBy(by).agg(
        F.first("phi").alias("dispersion"), F.first("weight_all").alias("weight_all"), F.first("weights_settled").alias("weights_settled"),
        F.max("rounds").alias("iterations"),
        F.max("delta").alias("delta"), F.max("message").alias("message"),
    )
    names = final.groupBy(by).agg(F.first("terms", ignorenulls=True).alias("coefficients"), F.max("message").alias("__late"))
    spec = join_same(join_same(design.drop("__y", "__y_sq", "__phi0", "knots"), state, [by]), names, [by])
    if t:
        spec = join_same(spec, sigma.select(by, "sigma"), [by])
    message = F.coalesce("message", "__late")
    converged = F.coalesce((F.col("delta") <= tol) & message.isNull(), F.lit(False))
    spec = spec.withColumns(
        {
            "family": F.lit(family),
            "link": F.lit(LINKS[family]),
            "n_level_effects": F.when(F.col("n_rand") > 1, F.col("n_rand") * t).otherwise(F.lit(0).cast("long")),
            "converged": converged,
            "status": F.when(message.isNotNull(), "error").when(converged, "ok").otherwise("not converged"),
            "message": message,
        }
    ).drop("__late")
    draws = final.where(F.col("draws").isNotNull()).select(by, "cat", "draws")
    weights = coef.select(by, "cat", "weight_own")
    return TrendFit(spec, table, draws, design, weights, levels, links, k, LINKS[family], by)
