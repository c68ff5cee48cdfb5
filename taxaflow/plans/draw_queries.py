"""Queries on draws of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaflow.functions import draws as D
from taxaflow.functions.keys import join_same
from taxaflow.operators import charts as C
from taxaflow.operators import contrast as K
from taxaflow.operators import diagnostics as G
from taxaflow.operators import summary as S
from taxaflow.operators.explore import residual_stats
from taxaflow.plans.catalog import DRAWS, query, r
from taxaflow.plans.record_queries import _SCALE
from taxaflow.sources.occurrences import read_event_draws

N = 20
KEYS = ["taxa", "geo", "year"]


def draws(spark, folder):
    """Draws of one model type: the mean over types, per taxon, category, time and draw."""
    rows = read_event_draws(spark, folder, N)
    return rows.groupBy(*KEYS, "draw").agg(F.avg("pred").alias("pred"))


def arrays(spark, folder):
    return S.to_arrays(draws(spark, folder), KEYS, N)


_D = f"{DRAWS}, d AS (SELECT taxa, geo, year, draw, avg(pred) AS pred FROM draws GROUP BY ALL)"


def _contrasted(condition: str, ref_filter: str = "true") -> str:
    return f"""{_D}, c AS (SELECT p.taxa, p.geo, p.year, p.draw, p.pred, q.pred AS ref, p.pred - q.pred AS diff, p.pred / q.pred AS diff_prop
      FROM d p LEFT JOIN (SELECT * FROM d WHERE {ref_filter}) q ON p.taxa = q.taxa AND p.draw = q.draw AND {condition})"""


_LONG = f"SELECT taxa, geo, year, draw, {r('pred')} AS pred, {r('ref')} AS ref, {r('diff')} AS diff, {r('diff_prop')} AS diff_prop FROM c"
_LAG = _contrasted("p.geo = q.geo AND p.year = q.year + 7")


@query("draw_rows", f"WITH {_D} SELECT taxa, geo, year, draw, {r('pred')} AS pred FROM d")
def _(spark, folder):
    return S.to_rows(arrays(spark, folder), KEYS).where("pred is not null")


@query("contrast_category", f"WITH {_contrasted('p.year = q.year', chr(39).join(['geo = ', 'view', '']))} {_LONG}")
def _(spark, folder):
    return K.contrast_draws(K.contrast(arrays(spark, folder), "view", "year", "geo", ["taxa"]), KEYS)


@query("contrast_time", f"WITH {_contrasted('p.geo = q.geo', 'year = 10')} {_LONG}")
def _(spark, folder):
    return K.contrast_draws(K.contrast(arrays(spark, folder), 10, "year", "geo", ["taxa"]), KEYS)


@query("contrast_lag", f"WITH {_LAG} {_LONG}")
def _(spark, folder):
    return K.contrast_draws(K.contrast(arrays(spark, folder), -7, "year", "geo", ["taxa"]), KEYS)


_STATS = f"""{_LAG}, s AS (
  SELECT taxa, geo, year, count(*) - {N} AS chk, count(*) AS n_draws, count(diff) AS known,
    greatest(avg(CAST(diff > 0 AS INTEGER)), avg(CAST(diff < 0 AS INTEGER))) AS pd,
    greatest(avg(CAST(diff > 0.5 AS INTEGER)), avg(CAST(diff < -0.5 AS INTEGER))) AS ps,
    CASE WHEN count(diff_prop) = count(*) THEN exp(avg(ln(diff_prop))) END AS gm,
    quantile_cont(pred, 0.1) AS q10, quantile_cont(pred, 0.5) AS q50, quantile_cont(pred, 0.9) AS q90,
    quantile_cont(diff, 0.1) AS d10, quantile_cont(diff, 0.5) AS d50, quantile_cont(diff, 0.9) AS d90 FROM c GROUP BY taxa, geo, year),
v AS (SELECT *, CASE WHEN d50 > 0 THEN ps WHEN d50 < 0 THEN 1 - ps WHEN d50 = 0 THEN 0 END AS pos,
             CASE WHEN d50 < 0 THEN ps WHEN d50 > 0 THEN 1 - ps WHEN d50 = 0 THEN 0 END AS neg FROM s)"""


def lagged(spark, folder):
    return K.contrast(arrays(spark, folder), -7, "year", "geo", ["taxa"])


@query(
    "posterior_summary",
    f"""WITH {_STATS} SELECT taxa, geo, year, chk AS "check", n_draws, {r('pd')} AS pd, {r('ps')} AS ps, {r('gm')} AS diff_prop_gm,
        {r('q10')} AS q10, {r('q50')} AS q50, {r('q90')} AS q90, {r('d10')} AS diff_q10, {r('d50')} AS diff_q50, {r('d90')} AS diff_q90,
        {r('pos')} AS positive, {r('neg')} AS negative, {r('1 - pos - neg')} AS stable FROM v""",
)
def _(spark, folder):
    return S.posterior_summary(lagged(spark, folder), KEYS, N, ps_thresh=0.5)


@query("prob_direction", f"WITH {_STATS} SELECT taxa, geo, year, {r('pd')} AS pd FROM v WHERE known > 0")
def _(spark, folder):
    table = lagged(spark, folder).select(*KEYS, D.direction(F.col("diff")).alias("pd"))
    return table.where("pd is not null")


@query("practical_significance", f"WITH {_STATS} SELECT taxa, geo, year, {r('ps')} AS ps FROM v WHERE known > 0")
def _(spark, folder):
    table = lagged(spark, folder).select(*KEYS, D.significance(F.col("diff"), 0.5).alias("ps"))
    return table.where("ps is not null")



def _flags():
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: i % 7 == 0)


@query(
    "divergent_summary",
    f"""WITH {_LAG} SELECT taxa, geo, year, draw % 7 = 0 AS divergent, count(*) - {N} AS "check", count(*) AS n_draws,
        {r('quantile_cont(pred, 0.1)')} AS q10, {r('quantile_cont(pred, 0.5)')} AS q50, {r('quantile_cont(pred, 0.9)')} AS q90,
        {r('quantile_cont(diff, 0.1)')} AS diff_q10, {r('quantile_cont(diff, 0.5)')} AS diff_q50, {r('quantile_cont(diff, 0.9)')} AS diff_q90
        FROM c GROUP BY taxa, geo, year, draw % 7 = 0""",
)
def divergent(spark, folder):
    return S.divergent_summary(lagged(spark, folder).withColumn("divergent", _flags()), KEYS, N)


@query(
    "ribbon_table",
    f"""WITH {_LAG} SELECT taxa, geo, year, draw % 7 = 0 AS divergent, {r('quantile_cont(pred, 0.5)')} AS middle,
        {r('quantile_cont(pred, 0.1)')} AS low, {r('quantile_cont(pred, 0.9)')} AS high FROM c GROUP BY taxa, geo, year, draw % 7 = 0""",
)
def _(spark, folder):
    return C.ribbon_table(divergent(spark, folder), KEYS)


def _num(expression: str) -> str:
    text = f"CAST(CAST(round_even({expression}, 2) AS DECIMAL(30, 2)) AS VARCHAR)"
    return f"rtrim(rtrim({text}, '0'), '.')"


_POP = f"""{_D}, s AS (SELECT taxa, geo, year, count(*) AS n, avg(pred) AS mean, quantile_cont(pred, 0.5) AS median,
  quantile_cont(pred, 0.05) AS lo, quantile_cont(pred, 0.95) AS hi FROM d GROUP BY ALL)"""


@query(
    "population_summary",
    f"""WITH {_POP} SELECT taxa, geo, year, n, CAST({N} AS BIGINT) AS n_check, {r('mean')} AS mean, {r('median')} AS median,
        {r('lo')} AS ci90_low, {r('hi')} AS ci90_high FROM s""",
)
def _(spark, folder):
    return S.population_summary(arrays(spark, folder), KEYS, N).drop("text")


@query(
    "interval_text",
    f"""WITH {_D}, s AS (SELECT geo, round(avg(pred), 1) AS mid, round(min(pred), 1) AS lo, round(max(pred), 1) AS hi FROM d GROUP BY geo)
        SELECT geo, {_num('mid')} || ' (' || {_num('lo')} || ' to ' || {_num('hi')} || ')' AS text FROM s""",
)
def _(spark, folder):
    from taxaflow.functions.text import interval_text

    found = draws(spark, folder).groupBy("geo").agg(*[F.round(f("pred"), 1).alias(n) for f, n in ((F.avg, "mid"), (F.min, "lo"), (F.max, "hi"))])
    return found.select("geo", interval_text(F.col("mid"), F.col("lo"), F.col("hi")).alias("text"))


# Change between two times; the data decide which groups are eligible.
_CHANGE = f"""{_D}, ok AS (SELECT taxa, geo FROM d GROUP BY ALL HAVING min(year) <= 8 AND max(year) >= 22),
change AS (SELECT a.taxa, a.geo, a.draw, a.pred AS pred_reference, b.pred AS pred_recent, b.pred - a.pred AS diff
  FROM d a JOIN d b USING (taxa, geo, draw) JOIN ok USING (taxa, geo) WHERE a.year = 8 AND b.year = 22)"""


def change(spark, folder):
    pred = arrays(spark, folder)
    return K.year_diff(pred, pred, ["taxa", "geo"], 8, 22)


@query("eligible_contexts", f"WITH {_CHANGE}, e AS (SELECT taxa, geo, min(year) AS min, max(year) AS max FROM d GROUP BY ALL) SELECT e.* FROM e JOIN ok USING (taxa, geo)")
def _(spark, folder):
    return K.eligible_contexts(draws(spark, folder), ["taxa", "geo"], "year", 8, 22)


@query(
    "expand_tests",
    f"""WITH {_D}, c AS (SELECT DISTINCT taxa, geo FROM d)
        SELECT taxa, geo, unnest(['reference', 'recent']) AS type, CAST(unnest([8, 22]) AS INTEGER) AS year FROM c""",
)
def _(spark, folder):
    tests = K.years_to_test([21, 22], -14)
    return K.expand_tests(draws(spark, folder).select("taxa", "geo").distinct(), tests["reference"], tests["recent"])


@query(
    "year_diff",
    f"""WITH {_CHANGE} SELECT taxa, geo, draw, 8 AS year_reference, 22 AS year_recent, {r('pred_reference')} AS pred_reference,
        {r('pred_recent')} AS pred_recent, {r('diff')} AS diff FROM change""",
)
def _(spark, folder):
    return K.year_diff_draws(change(spark, folder))


def _word(share: str) -> str:
    return f"(SELECT likelihood FROM {_SCALE} WHERE {share} <= max_val ORDER BY ord LIMIT 1)"


def _ord(share: str) -> str:
    return f"(SELECT min(ord) FROM {_SCALE} WHERE {share} <= max_val)"


def _pct(share: str) -> str:
    return f"CAST(CAST(round(100 * round_even({share}, 2)) AS INTEGER) AS VARCHAR)"


_CHANGES = f"""{_CHANGE}, s AS (SELECT taxa, geo, count(*) AS n, avg(CAST(diff < 0 AS INTEGER)) AS lower, avg(CAST(diff > 0 AS INTEGER)) AS higher,
  avg(diff) AS mean, quantile_cont(diff, 0.5) AS med, quantile_cont(diff, 0.05) AS lo, quantile_cont(diff, 0.95) AS hi FROM change GROUP BY ALL)"""


@query(
    "year_diff_summary",
    f"""WITH {_CHANGES} SELECT taxa, geo, n AS n_check, {r('lower')} AS lower, {r('higher')} AS higher, {r('mean')} AS mean_diff,
        {r('med')} AS median_diff, {r('lo')} AS ci_low, {r('hi')} AS ci_high, 8 AS reference, 22 AS recent,
        {_word('lower')} AS likelihood, {_ord('lower')} AS likelihood_ord,
        lower({_word('lower')}) || ' to be lower' || CASE WHEN geo = 'click' THEN ' on ' ELSE ' in ' END || geo || ' (' || {_pct('lower')} || '% chance)' AS text
        FROM s""".replace("lower((SELECT", "lcase((SELECT"),
)
def _(spark, folder):
    return S.change_summary(change(spark, folder), ["taxa", "geo"], islands=["click"])


@query(
    "lower_share",
    f"""WITH {_CHANGE}, s AS (SELECT taxa, geo, avg(CAST(diff < 0 AS INTEGER)) AS lower FROM change GROUP BY ALL)
        SELECT taxa, geo, draw, {r('diff')} AS diff, {r('lower')} AS lower FROM change JOIN s USING (taxa, geo)""",
)
def _(spark, folder):
    rows = K.year_diff_draws(change(spark, folder)).select("taxa", "geo", "draw", "diff")
    return S.with_lower_share(rows, ["taxa", "geo"])


# Change draws of each model type, pooled per taxon.
_POOL = f"""{DRAWS}, change AS (SELECT a.type, a.taxa, a.geo, a.draw, b.pred - a.pred AS diff
  FROM draws a JOIN draws b USING (type, taxa, geo, draw) WHERE a.year <= 8 AND b.year = a.year + 20),
s AS (SELECT taxa, count(*) AS n, avg(CAST(diff > 0 AS INTEGER)) AS increase, avg(CAST(diff < 0 AS INTEGER)) AS decline, avg(diff) AS mean, """ + ", ".join(
    f"quantile_cont(diff, {p}) AS {name}" for p, name in
    ((0.005, "q00_5"), (0.025, "q02_5"), (0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"), (0.975, "q97_5"), (0.995, "q99_5"))
) + " FROM change GROUP BY taxa)"


def pooled(spark, folder):
    rows = read_event_draws(spark, folder, N)
    early = rows.where("year <= 8").withColumnRenamed("pred", "before").withColumn("year", F.col("year") + 20)
    keys = ["type", "taxa", "geo", "draw", "year"]
    both = join_same(early.select(*keys, "before"), rows, keys, "inner")
    per_type = {f"model {i}": both.where(F.col("type") == f"model {i}").drop("type") for i in range(3)}
    return S.stack_models(per_type).withColumn("diff", F.col("pred") - F.col("before")).select("taxa", "type", "geo", "draw", "year", "diff")


@query("stack_models", f"WITH {_POOL} SELECT taxa, type, geo, draw, count(*) AS n, {r('sum(diff)')} AS diff FROM change GROUP BY ALL")
def _(spark, folder):
    return pooled(spark, folder).groupBy("taxa", "type", "geo", "draw").agg(F.count(F.lit(1)).alias("n"), F.sum("diff").alias("diff"))


@query(
    "overall_change",
    f"""WITH {_POOL} SELECT taxa, n, {r('increase')} AS increase, {r('decline')} AS decline, {r('mean')} AS mean_effect, {r('q50')} AS median_effect,
        {', '.join(r(q) + ' AS ' + q for q in ('q00_5', 'q02_5', 'q05', 'q25', 'q50', 'q75', 'q95', 'q97_5', 'q99_5'))},
        {_word('decline')} AS likelihood, lcase({_word('decline')}) || ' to be declining (' || {_pct('decline')} || '% chance)' AS text FROM s""",
)
def _(spark, folder):
    return S.overall_change(pooled(spark, folder))


@query(
    "overall_text",
    f"""WITH {_POOL}, t AS (SELECT taxa, list(DISTINCT type ORDER BY type) AS ts, list(DISTINCT geo ORDER BY geo) AS gs FROM change GROUP BY taxa)
        SELECT taxa, {_word('decline')} AS likelihood, '_' || taxa || '_ was ' || lcase({_word('decline')}) || ' to be declining (' || {_pct('decline')}
          || '% chance) across the whole area based on ' || len(ts) || ' models (' || array_to_string(ts[:-2], ', ') || ' and ' || ts[-1]
          || ') using data from ' || len(gs) || ' event types (' || array_to_string(gs[:-2], ', ') || ' and ' || gs[-1] || ')' AS overall_text
        FROM s JOIN t USING (taxa)""",
)
def _(spark, folder):
    rows = pooled(spark, folder)
    text = S.overall_text(rows, S.overall_change(rows), "the whole area", geo_kind="event types")
    return text.select("taxa", "likelihood", "overall_text")


@query(
    "interval_table",
    f"""WITH {_D}, s AS (SELECT taxa, geo, year, {', '.join(f'quantile_cont(pred, {p}) AS {n}' for p, n in ((0.01, 'q01'), (0.99, 'q99'), (0.1, 'q10'), (0.9, 'q90'), (0.25, 'q25'), (0.75, 'q75'), (0.5, 'q50')))},
          avg(CAST(pred > 3.5 AS INTEGER)) AS pos FROM d GROUP BY ALL)
        SELECT taxa, geo, year, {', '.join(f'{r(n)} AS {n}' for n in ('q01', 'q99', 'q10', 'q90', 'q25', 'q75', 'q50'))}, {r('pos')} AS pos_raw,
               {_word('pos')} AS likelihood, {_ord('pos')} AS likelihood_ord FROM s""",
)
def intervals(spark, folder):
    pred = arrays(spark, folder).withColumn("o", D.ordered(F.col("pred")))
    probs = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    res = pred.select(*KEYS, *[c.alias(n) for n, c in D.quantile_columns(F.col("o"), probs).items()], D.share_of(F.col("o"), lambda x: x > 3.5).alias("pos_raw"))
    return C.interval_table(res, KEYS)


@query(
    "interval_points",
    f"""WITH {_D}, e AS (SELECT event_id, CAST(day(ts) AS INTEGER) AS year, value FROM events)
        SELECT event_id, year, value, 'all' AS facet FROM e WHERE year IN (SELECT year FROM d WHERE year % 3 = 0)""",
)
def _(spark, folder):
    raw = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.dayofmonth("ts").alias("year"), "value")
    return C.interval_points(raw, intervals(spark, folder).where("year % 3 = 0"), "year", "facet", "all")


@query(
    "spaghetti_rows",
    f"WITH {_D} SELECT taxa, geo, year, draw, {r('pred')} AS pred, draw % 7 = 0 AS divergent FROM d",
)
def _(spark, folder):
    return C.spaghetti_table(arrays(spark, folder).withColumn("divergent", _flags()), KEYS, n=N, by=["taxa"])


@query(
    "sample_draws",
    f"""WITH {_D}, n AS (SELECT DISTINCT taxa, draw FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY taxa ORDER BY md5('1:' || draw)) AS i FROM n)
        SELECT taxa, geo, year, draw, {r('pred')} AS pred FROM d JOIN o USING (taxa, draw) WHERE i <= 5""",
)
def _(spark, folder):
    return S.sample_draws(draws(spark, folder), 5, ["taxa"])


@query(
    "change_density",
    f"""WITH {_STATS}, mx AS (SELECT taxa, max(year) AS year FROM c WHERE diff IS NOT NULL GROUP BY taxa),
        z AS (SELECT c.taxa, c.geo, {_word('neg')} AS likelihood, diff AS value
              FROM c JOIN mx USING (taxa, year) JOIN v USING (taxa, geo, year) WHERE diff IS NOT NULL),
        t AS (SELECT taxa, geo, likelihood, count(*) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
              (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34e0 AS iqr FROM z GROUP BY ALL),
        b AS (SELECT *, 0.9e0 * (CASE WHEN iqr > 0 AND iqr < sd THEN iqr ELSE sd END) * pow(n, -0.2e0) AS bw FROM (SELECT * REPLACE (CASE WHEN sd > 0 THEN sd WHEN lo <> 0 THEN abs(lo) ELSE 1e0 END AS sd, CASE WHEN sd > 0 THEN iqr END AS iqr) FROM t)),
        k AS (SELECT taxa, geo, CASE WHEN hi > lo THEN CAST(least(floor((value - lo) / (hi - lo) * 512), 511) AS INTEGER) + 1 ELSE 1 END AS bin, count(*) AS c
              FROM z JOIN b USING (taxa, geo) GROUP BY ALL),
        g AS (SELECT k.*, likelihood, lo, hi, bw, n, CAST(unnest(range(0, 128)) AS INTEGER) AS point FROM k JOIN b USING (taxa, geo)),
        x AS (SELECT *, lo - 3 * bw + point * (hi - lo + 6 * bw) / 127 AS x, lo + (bin - 0.5e0) * (hi - lo) / 512 AS centre FROM g)
        SELECT taxa, geo, likelihood, point, {r('max(x)')} AS x,
               {r('sum(c * exp(-0.5e0 * pow((x - centre) / bw, 2)) / (2.5066282746310002e0 * bw * n))')} AS density
        FROM x GROUP BY taxa, geo, likelihood, point""",
)
def _(spark, folder):
    pred = lagged(spark, folder)
    res = S.posterior_summary(pred, KEYS, N, ps_thresh=0.5)
    return C.change_density(pred, res, KEYS, "year", "negative", "geo", by=["taxa"])


def chain_rows(spark, folder):
    """Event values as draws of one parameter in chains of 1000, a model to every 4000 events."""
    rows = spark.read.parquet(f"{folder}/events.parquet").withColumn("value", F.log1p("value"))
    block = F.floor(F.col("event_id") / 1000)
    return rows.select(
        F.floor(block / 4).alias("model_id"), F.lit("value").alias("parameter"), F.pmod(block, F.lit(4)).cast("int").alias("chain"),
        F.pmod("event_id", F.lit(1000)).alias("draw"), "value",
    )


_PARAMS = f"""p AS (SELECT event_type AS parameter, user_id % 10 AS m, avg(value) / 50 AS Rhat, count(*) / 2.0 AS n_eff FROM events GROUP BY ALL)"""


@query(
    "diagnostics_check",
    f"""WITH {_PARAMS}, l AS (SELECT m, 'Rhat' AS diagnostic, Rhat >= 1.05 AS fail FROM p UNION ALL SELECT m, 'n_eff', n_eff < 100 FROM p)
        SELECT m, diagnostic, count(*) AS parameters, count(*) FILTER (WHERE fail) AS failed, count(*) FILTER (WHERE fail) = 0 AS pass FROM l GROUP BY ALL""",
)
def _(spark, folder):
    params = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.col("event_type").alias("parameter"), F.pmod("user_id", F.lit(10)).alias("m")).agg(
        (F.avg("value") / 50).alias("Rhat"), (F.count(F.lit(1)) / 2.0).alias("n_eff")
    )
    return G.diagnostics_check(params, ["m"])


@query(
    "divergence_summary",
    f"""WITH {_D}, m AS (SELECT DISTINCT taxa, draw FROM d) SELECT taxa, count(*) FILTER (WHERE draw % 7 = 0) AS num_divergent,
        {r('avg(CAST(draw % 7 = 0 AS INTEGER))')} AS prop_divergent, count(*) AS n_draws FROM m GROUP BY taxa""",
)
def _(spark, folder):
    rows = draws(spark, folder).select("taxa", "draw").distinct().withColumn("divergent", F.col("draw") % 7 == 0)
    return G.divergence_summary(rows, ["taxa"])


_CHAINS = """x AS (SELECT event_id // 4000 AS model_id, event_id // 500 AS half, ln(1 + value) AS v FROM events),
halves AS (SELECT model_id, half, avg(v) AS m, var_samp(v) AS s FROM x GROUP BY ALL),
conv AS (SELECT model_id, avg(s) AS w, 500 * var_samp(m) AS b FROM halves GROUP BY model_id),
stats AS (SELECT model_id, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50,
                 quantile_cont(v, 0.9) AS q90 FROM x GROUP BY model_id)"""


@query(
    "parameter_summary",
    f"""WITH {_CHAINS} SELECT model_id, 'value' AS parameter, {r('mean')} AS mean, {r('sd')} AS sd, {r('q10')} AS q10, {r('q50')} AS q50,
        {r('q90')} AS q90, {r('sqrt((499 * w / 500 + b / 500) / w)')} AS Rhat FROM stats JOIN conv USING (model_id)""",
)
def _(spark, folder):
    return G.parameter_summary(chain_rows(spark, folder), ["model_id"]).drop("n_eff")


@query("effective_size")
def _(spark, folder):
    return G.parameter_summary(chain_rows(spark, folder), ["model_id"]).select("model_id", "parameter", "n_eff")


@query(
    "residual_stats",
    f"""WITH {_D}, m AS (SELECT taxa, geo, avg(pred) AS mu FROM d GROUP BY ALL), x AS (SELECT taxa, pred - mu AS res FROM d JOIN m USING (taxa, geo))
        SELECT taxa, count(res) AS n, {r('avg(res)')} AS mean, {r('stddev_samp(res)')} AS sd FROM x GROUP BY taxa""",
)
def _(spark, folder):
    rows = draws(spark, folder)
    mean = rows.groupBy("taxa", "geo").agg(F.avg("pred").alias("mu"))
    both = join_same(rows, mean, ["taxa", "geo"]).withColumn("residual", F.col("pred") - F.col("mu"))
    return residual_stats(both, ["taxa"])


_MEANS = f"{_D}, m AS (SELECT taxa, draw, geo, avg(pred) AS value FROM d GROUP BY ALL)"


@query(
    "parameter_rows",
    f"""WITH {_MEANS} SELECT a.taxa, a.draw, a.draw % 7 = 0 AS divergent, b.geo AS parameter, {r('m.value')} AS value
        FROM (SELECT DISTINCT taxa, draw FROM m) a JOIN (SELECT DISTINCT taxa, geo FROM m) b USING (taxa)
        LEFT JOIN m ON m.taxa = a.taxa AND m.draw = a.draw AND m.geo = b.geo""",
)
def _(spark, folder):
    means = draws(spark, folder).groupBy("taxa", "draw", "geo").agg(F.avg("pred").alias("value"))
    terms = means.groupBy("taxa").agg(F.array_sort(F.collect_set("geo")).alias("coefficients"))
    per_draw = means.groupBy("taxa", "draw").agg(F.map_from_entries(F.collect_list(F.struct("geo", "value"))).alias("m"))
    beta = F.transform("coefficients", lambda g: F.try_element_at(F.col("m"), g)).alias("beta")
    rows = join_same(per_draw, terms, ["taxa"]).select("taxa", "draw", (F.col("draw") % 7 == 0).alias("divergent"), beta)
    return C.parameter_rows(rows, terms, "taxa")


@query(
    "divergence_flags",
    f"""WITH {_D}, m AS (SELECT DISTINCT taxa, draw FROM d)
        SELECT taxa, string_agg(CASE WHEN draw % 7 = 0 THEN '1' ELSE '0' END, '' ORDER BY draw) AS flags FROM m GROUP BY taxa""",
)
def _(spark, folder):
    rows = draws(spark, folder).select("taxa", "draw").distinct().withColumn("divergent", F.col("draw") % 7 == 0)
    flags = F.array_join(F.transform("divergent", lambda x: F.when(x, "1").otherwise("0")), "")
    return G.divergence_flags(rows, ["taxa"]).select("taxa", flags.alias("flags"))
