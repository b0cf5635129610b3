"""Queries of convergence diagnostics, over the draws of both cohorts and of the two together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapstats.operators import convergence as C
from mapstats.session import materialised
from mapstats.sources.views import METRICS

from .chains import THIN, WARMUP
from .registry import query

TAIL = 3


def joint(v) -> DataFrame:
    """The trace with a cohort for each row, and again with the joint one."""
    return v.trace.withColumn("cohort", F.explode(F.array("experiment", F.lit("joint"))))


def shortest(v) -> DataFrame:
    """cohort, shortest, dropped: draws of its shortest chain, and draws beyond it in the others."""
    n = joint(v).groupBy("cohort", "seed").agg(F.count("*").alias("n"))
    return n.groupBy("cohort").agg(F.min("n").alias("shortest"), (F.sum("n") - F.min("n") * F.count("*")).alias("dropped"))


def long_draws(v) -> DataFrame:
    """cohort, metric, seed, step, value: each cohort cut to its shortest chain, as unequal chains make no sample."""
    t = joint(v).select("cohort", "seed", "step", *[F.col(m).cast("double").alias(m) for m in METRICS])
    cut = t.join(F.broadcast(shortest(v)), "cohort").where("step < shortest").select(*t.columns)  # a row a cohort
    return cut.unpivot(["cohort", "seed", "step"], list(METRICS), "metric", "value")


LONG = f"""l AS (UNPIVOT (SELECT experiment AS cohort, seed, step, {", ".join(f"{m}::DOUBLE AS {m}" for m in METRICS)} FROM v_trace) ON {", ".join(METRICS)} INTO NAME metric VALUE value),
j AS (SELECT cohort, seed, step, metric, value FROM l UNION ALL SELECT 'joint', seed, step, metric, value FROM l),
n AS (SELECT cohort, min(c) AS n, count(*) AS chains FROM (SELECT cohort, seed, count(*) AS c FROM j WHERE metric = 'cut_edges' GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT j.*, n, chains, CASE WHEN step < n // 2 THEN 2 * seed WHEN step >= n - n // 2 THEN 2 * seed + 1 END AS chain,
  CASE WHEN step >= n - n // 2 THEN step - (n - n // 2) ELSE step END AS pos FROM j JOIN n USING (cohort) WHERE step < n)"""


def _polynomial(terms: tuple, r: str) -> str:
    out = repr(terms[-1])
    for t in reversed(terms[:-1]):
        out = f"({out} * {r} + {t!r}::DOUBLE)"
    return out


def normal_sql(p: str) -> str:
    """The inverse normal distribution in DuckDB."""
    ratio = lambda both, r: f"({_polynomial(both[0], r)} / {_polynomial(both[1], r)})"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    far = f"CASE WHEN {r} <= 5 THEN {ratio(C._TAIL, f'({r} - 1.6)')} ELSE {ratio(C._FAR, f'({r} - 5)')} END"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(C._CENTRE, f'(0.180625 - {q} * {q})')} ELSE sign({q}) * {far} END"


def ranks_sql(value: str, rows: str = "d") -> str:
    """Normal scores of average ranks."""
    return f"""SELECT *, {normal_sql("p")} AS z FROM (SELECT *, (rank() OVER (PARTITION BY cohort, metric ORDER BY {value}) + (count(*) OVER (PARTITION BY cohort, metric, {value}) - 1) / 2.0::DOUBLE - 0.375) / (count(*) OVER (PARTITION BY cohort, metric) + 0.25) AS p FROM {rows})"""


def rhat_sql(rows: str) -> str:
    return f"""SELECT cohort, metric, sqrt(((avg(c) - 1) * avg(w) + avg(c) * var_samp(m)) / avg(c) / avg(w)) AS r FROM (SELECT cohort, metric, chain, count(*) AS c, avg(z) AS m, var_samp(z) AS w FROM {rows} WHERE chain IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def ess_sql(rows: str, name: str, lags: int = 64) -> str:
    """Tables that end in name(cohort, metric, ess), of rows(cohort, metric, chain, pos, x). The sequences of the draws that
    the tables give end long before so many lags; where one did not, the result would be null and the twin differ."""
    k = "cohort, metric"
    return f"""{name}_c AS (SELECT {k}, chain, pos, x - avg(x) OVER (PARTITION BY {k}, chain) AS c, count(*) OVER (PARTITION BY {k}, chain) AS n FROM {rows}),
{name}_l AS (SELECT {k}, lag, avg(s) AS cov FROM (SELECT a.cohort, a.metric, a.chain, lag, sum(a.c * b.c) / any_value(a.n) AS s FROM {name}_c a, range({lags}) r(lag), {name}_c b
  WHERE b.cohort = a.cohort AND b.metric = a.metric AND b.chain = a.chain AND b.pos = a.pos + lag GROUP BY ALL) GROUP BY ALL),
{name}_s AS (SELECT {k}, count(*) AS m, any_value(n) AS n, coalesce(var_samp(mean), 0) AS between_chains FROM (SELECT {k}, chain, count(*) AS n, avg(x) AS mean FROM {rows} GROUP BY ALL) GROUP BY ALL),
{name}_r AS (SELECT {k}, lag, m, n, CASE WHEN lag = 0 THEN 1.0::DOUBLE ELSE 1 - (w - cov) / (w * (n - 1) / n + between_chains) END AS rho
  FROM (SELECT *, first_value(cov) OVER (PARTITION BY {k} ORDER BY lag) * n / (n - 1) AS w FROM {name}_l JOIN {name}_s USING ({k}))),
{name}_p AS (SELECT {k}, lag // 2 AS k, sum(rho) AS p, any_value(m) AS m, any_value(n) AS n FROM {name}_r GROUP BY ALL),
{name}_e AS (SELECT {k}, min(k) AS stop FROM {name}_p WHERE k > 0 AND p <= 0 GROUP BY ALL),
{name}_m AS (SELECT {k}, k, m, n, stop, min(p) OVER (PARTITION BY {k} ORDER BY k) AS p FROM {name}_p JOIN {name}_e USING ({k}) WHERE k < stop),
{name} AS (SELECT {k}, any_value(m * n) / greatest(-1 + 2 * sum(p) + any_value(greatest(rho, 0)), 1 / log10(any_value(m * n))) AS ess
  FROM {name}_m JOIN (SELECT {k}, lag, rho FROM {name}_r) t USING ({k}) WHERE lag = 2 * stop GROUP BY ALL
  UNION ALL SELECT {k}, count(*)::DOUBLE FROM {rows} GROUP BY {k} HAVING min(x) = max(x))"""


PLAIN = "(SELECT cohort, metric, chain, pos, value AS x FROM d WHERE chain IS NOT NULL)"


def statistics(v) -> DataFrame:
    return C.statistics(long_draws(v))


CHAIN_SQL = """WITH c AS (SELECT experiment, seed, step, cut_edges - avg(cut_edges) OVER w AS c, count(*) OVER w AS n, var_pop(cut_edges) OVER w AS v FROM v_trace WINDOW w AS (PARTITION BY seed)),
r AS (SELECT a.experiment, a.seed, lag, any_value(a.n) AS n, sum(a.c * b.c) / ((any_value(a.n) - lag) * any_value(a.v)) AS rho FROM c a, range(1, 64) r(lag), c b WHERE b.seed = a.seed AND b.step = a.step + lag GROUP BY 1, 2, 3)"""


@query("dia_01_simple_ess", CHAIN_SQL + """, e AS (SELECT seed, min(lag) AS stop FROM r WHERE rho <= 0 GROUP BY 1)
    SELECT experiment, seed, round(any_value(n) / (1 + 2 * coalesce(sum(rho) FILTER (lag < stop), 0)), 6) AS ess FROM r JOIN e USING (seed) GROUP BY 1, 2""")  # fmt: skip
def dia_01(v):
    return chain_sizes(v, "simple_ess")


@query("dia_02_pair_ess", CHAIN_SQL + """, p AS (SELECT experiment, seed, (lag - 1) // 2 AS k, sum(rho) AS p, any_value(n) AS n FROM r GROUP BY ALL), e AS (SELECT seed, min(k) AS stop FROM p WHERE p <= 0 GROUP BY 1)
    SELECT experiment, seed, round(least(any_value(n), any_value(n) / (1 + 2 * coalesce(sum(p) FILTER (k < stop), 0))), 6) AS ess FROM p JOIN e USING (seed) GROUP BY 1, 2""")  # fmt: skip
def dia_02(v):
    return chain_sizes(v, "pair_ess")


def thinned_sizes(trace: DataFrame, value: str, ks: tuple[int, ...] = THIN, warmup: int = WARMUP) -> DataFrame:
    """seed, k, retained, mean, sd, ess (stopped at the first autocorrelation that is not positive), ess_per_draw, and how
    mean, sd and ess differ from those of all draws after warm-up (k = 1, which ks must hold), for every k-th of them.
    Each chain is read once; a draw goes to the ks that divide its place."""
    if 1 not in ks:
        raise ValueError("1 must be among ks, as the others are compared with it")
    place = F.col("step") - warmup
    t = trace.where(place >= 0).select("seed", place.alias("at"), F.col(value).cast("double").alias("value"))
    t = t.withColumn("every", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("at") % k == 0)))
    draws = t.select("seed", "every", F.floor(F.col("at") / F.col("every")).alias("pos"), "value")
    g = draws.groupBy("seed", "every").agg(F.count("*").alias("retained"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    g = materialised(g.join(C.chain_sizes(draws, ["seed", "every"]).select("seed", "every", F.col("simple_ess").alias("ess")), ["seed", "every"], "left"))
    names = ("mean", "sd", "ess")
    whole = g.where("every = 1").select("seed", *[F.col(c).alias(f"whole_{c}") for c in names])
    out = g.join(whole, "seed").withColumn("ess_per_draw", F.col("ess") / F.col("retained"))
    return out.select("seed", F.col("every").alias("k"), "retained", *names, "ess_per_draw", *[(F.col(c) - F.col(f"whole_{c}")).alias(f"{c}_delta") for c in names])


@query(
    "dia_12_thinning_sizes",
    f"""WITH t AS (SELECT seed, k, (step - {WARMUP}) // k AS pos, cut_edges::DOUBLE AS x FROM v_trace, (VALUES {", ".join(f"({k})" for k in THIN)}) AS k(k) WHERE step >= {WARMUP} AND (step - {WARMUP}) % k = 0),
    c AS (SELECT seed, k, pos, x - avg(x) OVER w AS c, count(*) OVER w AS n, var_pop(x) OVER w AS v FROM t WINDOW w AS (PARTITION BY seed, k)),
    r AS (SELECT a.seed, a.k, lag, any_value(a.n) AS n, sum(a.c * b.c) / ((any_value(a.n) - lag) * any_value(a.v)) AS rho FROM c a, range(1, 64) r(lag), c b WHERE b.seed = a.seed AND b.k = a.k AND b.pos = a.pos + lag GROUP BY 1, 2, 3),
    e AS (SELECT seed, k, min(lag) AS stop FROM r WHERE rho <= 0 GROUP BY 1, 2), s AS (SELECT seed, k, any_value(n) / (1 + 2 * coalesce(sum(rho) FILTER (lag < stop), 0)) AS ess FROM r JOIN e USING (seed, k) GROUP BY 1, 2),
    g AS (SELECT seed, k, count(*) AS retained, avg(x) AS mean, stddev_samp(x) AS sd FROM t GROUP BY 1, 2), a AS (SELECT * FROM g JOIN s USING (seed, k))
    SELECT a.seed, a.k, a.retained, round(a.mean, 8) AS mean, round(a.sd, 8) AS sd, round(a.ess, 6) AS ess, round(a.ess / a.retained, 8) AS ess_per_draw, round(a.mean - o.mean, 8) AS mean_delta, round(a.sd - o.sd, 8) AS sd_delta, round(a.ess - o.ess, 6) AS ess_delta FROM a JOIN a o ON o.seed = a.seed AND o.k = 1""",
)
def dia_12_sizes(v):
    t = thinned_sizes(v.trace, "cut_edges")
    return t.withColumns({c: F.round(c, 6 if c in ("ess", "ess_delta") else 8) for c in t.columns[3:]})


def chain_sizes(v, name: str) -> DataFrame:
    draws = v.trace.select("experiment", "seed", F.col("step").alias("pos"), F.col("cut_edges").cast("double").alias("value"))
    return C.chain_sizes(draws, ["experiment", "seed"]).select("experiment", "seed", F.round(name, 6).alias("ess"))


@query(
    "dia_04_rank_rhat",
    f"""WITH {LONG}, b AS ({ranks_sql("value")}), f AS ({ranks_sql("away", "(SELECT *, abs(value - median(value) OVER (PARTITION BY cohort, metric)) AS away FROM d)")}),
    rb AS ({rhat_sql("b")}), rf AS ({rhat_sql("f")}) SELECT cohort, metric, round(greatest(rb.r, rf.r), 9) AS r_hat FROM rb JOIN rf USING (cohort, metric)""",
)
def dia_04(v):
    d, _ = C.ranked(long_draws(v))
    halves = d.where("chain IS NOT NULL").groupBy(*C.GROUP, "chain").agg(F.count("*").alias("half_n"), *[f(x).alias(f"{n}_{x}") for x in ("score", "folded_score") for n, f in (("mean", F.avg), ("var", F.var_samp))])
    return halves.groupBy(*C.GROUP).agg(F.round(F.greatest(C.split_rhat(halves, "score"), C.split_rhat(halves, "folded_score")), 9).alias("r_hat"))


@query("dia_05_bulk_ess", f"""WITH {LONG}, z AS ({ranks_sql("value", "(SELECT * FROM d WHERE chain IS NOT NULL)")}), {ess_sql("(SELECT cohort, metric, chain, pos, z AS x FROM z)", "e")} SELECT cohort, metric, round(ess, 6) AS bulk_ess FROM e""")
def dia_05(v):
    return statistics(v).select(*C.GROUP, F.round("bulk_ess", 6).alias("bulk_ess"))


@query(
    "dia_06_tail_ess",
    f"""WITH {LONG}, q AS (SELECT cohort, metric, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM d GROUP BY 1, 2),
    {ess_sql("(SELECT cohort, metric, chain, pos, (value <= lo)::INTEGER::DOUBLE AS x FROM d JOIN q USING (cohort, metric) WHERE chain IS NOT NULL)", "a")},
    {ess_sql("(SELECT cohort, metric, chain, pos, (value <= hi)::INTEGER::DOUBLE AS x FROM d JOIN q USING (cohort, metric) WHERE chain IS NOT NULL)", "b")}
    SELECT cohort, metric, round(least(a.ess, b.ess), 6) AS tail_ess FROM a JOIN b USING (cohort, metric)""",
)
def dia_06(v):
    return statistics(v).select(*C.GROUP, F.round("tail_ess", 6).alias("tail_ess"))


@query("dia_07_mcse")
def dia_07(v):
    return statistics(v).select(*C.GROUP, "mcse_mean", "mcse_sd", "mcse_q05", "mcse_q95")


@query("dia_08_report")
def dia_08(v):
    """All statistics and screens, and how many draws lie beyond the shortest chain and so are in none of them."""
    return C.report(long_draws(v)).join(F.broadcast(shortest(v).select("cohort", "dropped")), "cohort")  # a row a cohort


@query(
    "dia_09_tail_indicator",
    f"""WITH {LONG}, s AS (SELECT *, (value <= {TAIL})::INTEGER AS i FROM d WHERE metric = 'dem_seats'), r AS (SELECT *, i = 1 AND coalesce(lag(i) OVER (PARTITION BY cohort, seed ORDER BY step), 0) = 0 AS rises FROM s),
    {ess_sql("(SELECT cohort, metric, chain, pos, i::DOUBLE AS x FROM s WHERE chain IS NOT NULL)", "e")}
    SELECT cohort, metric, sum(i)::BIGINT AS events, avg(i) AS frequency, count(*) FILTER (rises) AS runs, 'available' AS status, round(stddev_samp(i) / sqrt(any_value(ess)), 9) AS mcse, round(any_value(ess), 6) AS ess FROM r JOIN e USING (cohort, metric) GROUP BY 1, 2""",
)
def dia_09(v):
    """States at or below a number of seats: how often, in how many runs, and diagnostics unless all or none are."""
    seats = long_draws(v).where("metric = 'dem_seats'").withColumn("value", (F.col("value") <= TAIL).cast("double"))
    before = F.coalesce(F.lag("value").over(Window.partitionBy("cohort", "seed").orderBy("step")), F.lit(0.0))
    events = seats.withColumn("rises", (F.col("value") == 1) & (before == 0)).groupBy("cohort", "metric").agg(F.sum("value").cast("long").alias("events"), F.avg("value").alias("frequency"), F.count_if("rises").alias("runs"))
    known = F.col("low") < F.col("high")
    s = C.statistics(seats).select(*C.GROUP, F.when(known, "available").otherwise("unavailable_constant_indicator").alias("status"), F.when(known, F.round("mcse_mean", 9)).alias("mcse"), F.when(known, F.round("ess_mean", 6)).alias("ess"))
    return events.join(s, C.GROUP)


@query(
    "dia_10_cohort_difference",
    f"""WITH {LONG}, {ess_sql(PLAIN, "e")}, r AS (SELECT cohort, metric, avg(value) AS mean, stddev_samp(value) / sqrt(any_value(ess)) AS mcse FROM d JOIN e USING (cohort, metric) GROUP BY 1, 2)
    SELECT a.metric, round(abs(a.mean - b.mean), 9) AS difference, round(sqrt(a.mcse * a.mcse + b.mcse * b.mcse), 9) AS combined_mcse, round(abs(a.mean - b.mean) / sqrt(a.mcse * a.mcse + b.mcse * b.mcse), 6) AS ratio
    FROM r a JOIN r b USING (metric) WHERE a.cohort = 'exp_a' AND b.cohort = 'exp_b'""",
)
def dia_10(v):
    r = materialised(statistics(v).select(*C.GROUP, "mean", "mcse_mean"))
    a, b = (r.where(F.col("cohort") == c).select("metric", F.col("mean").alias(f"{n}_mean"), F.col("mcse_mean").alias(f"{n}_mcse")) for c, n in (("exp_a", "a"), ("exp_b", "b")))
    combined = F.hypot("a_mcse", "b_mcse")
    difference = F.abs(F.col("a_mean") - F.col("b_mean"))
    return a.join(b, "metric").select("metric", F.round(difference, 9).alias("difference"), F.round(combined, 9).alias("combined_mcse"), F.round(F.when(combined > 0, difference / combined), 6).alias("ratio"))


@query(
    "dia_14_review",
    f"""WITH {LONG}, {ess_sql(PLAIN, "e")}, s AS (SELECT cohort, metric, avg(value) AS mean, stddev_samp(value) AS sd, stddev_samp(value) / sqrt(any_value(ess)) AS mcse, avg(value) FILTER (step >= least(50, n - 1)) AS late, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95 FROM d JOIN e USING (cohort, metric) GROUP BY 1, 2)
    SELECT cohort, metric, round(mean, 9) AS mean, round(sd, 9) AS sd, round(2 * mcse, 9) AS two_mcse, round(mcse / sd, 9) AS mcse_over_sd, round(late - mean, 9) AS warmup_shift, round(q05, 9) AS q05, round(q95, 9) AS q95 FROM s""",
)
def dia_14(v):
    d = long_draws(v)
    ends = F.broadcast(shortest(v).select("cohort", (F.col("shortest") - 1).alias("last")))  # a row a cohort
    late = d.join(ends, "cohort").where(F.col("step") >= F.least(F.lit(50), F.col("last"))).groupBy(*C.GROUP).agg(F.avg("value").alias("late"))
    s = C.statistics(d).join(late, C.GROUP)
    out = {"mean": F.col("mean"), "sd": F.col("sd"), "two_mcse": 2 * F.col("mcse_mean"), "mcse_over_sd": F.when(F.col("sd") > 0, F.col("mcse_mean") / F.col("sd")), "warmup_shift": F.col("late") - F.col("mean"), "q05": F.col("q05"), "q95": F.col("q95")}
    return s.select(*C.GROUP, *[F.round(c, 9).alias(n) for n, c in out.items()])


def without_each(trace: DataFrame) -> DataFrame:
    """cohort, omitted, metric, seed, step, value: for each chain, the draws of all the others, cut to the shortest of these."""
    n = trace.groupBy("seed").agg(F.count("*").alias("n"))
    others = n.select(F.col("seed").alias("omitted")).join(n, F.col("omitted") != F.col("seed"))  # rows of chains, not of states
    ends = others.groupBy("omitted").agg(F.min("n").alias("shortest"))
    t = trace.select("seed", "step", *[F.col(m).cast("double").alias(m) for m in METRICS])
    t = t.join(others.select("omitted", "seed").join(ends, "omitted"), "seed").where("step < shortest")
    t = t.withColumn("cohort", F.concat(F.lit("without_"), F.col("omitted").cast("string")))
    return t.unpivot(["cohort", "omitted", "seed", "step"], list(METRICS), "metric", "value")


WITHOUT = LONG.replace("j AS (SELECT cohort, seed, step, metric, value FROM l UNION ALL SELECT 'joint', seed, step, metric, value FROM l)", "j AS (SELECT 'without_' || omitted AS cohort, seed, step, metric, value FROM l, (SELECT DISTINCT seed AS omitted FROM v_trace) WHERE seed <> omitted)")


@query(
    "dia_13_without_chain",
    f"""WITH {WITHOUT}, b AS ({ranks_sql("value")}), f AS ({ranks_sql("away", "(SELECT *, abs(value - median(value) OVER (PARTITION BY cohort, metric)) AS away FROM d)")}), rb AS ({rhat_sql("b")}), rf AS ({rhat_sql("f")}),
    z AS ({ranks_sql("value", "(SELECT * FROM d WHERE chain IS NOT NULL)")}), {ess_sql("(SELECT cohort, metric, chain, pos, z AS x FROM z)", "e")}, s AS (SELECT cohort, metric, count(*) AS states, any_value(chains) AS chains, avg(value) AS mean FROM d GROUP BY 1, 2)
    SELECT cohort[9:]::INTEGER AS omitted, metric, chains::INTEGER AS chains, states, round(mean, 9) AS mean, round(greatest(rb.r, rf.r), 9) AS r_hat, round(ess, 6) AS bulk_ess FROM s JOIN rb USING (cohort, metric) JOIN rf USING (cohort, metric) JOIN e USING (cohort, metric)""",
)
def dia_13_without(v):
    """Which chain the disagreement comes from: the diagnostics of all chains but one, for each."""
    s = C.statistics(without_each(v.trace).drop("omitted"))
    omitted = F.substring_index("cohort", "_", -1).cast("int").alias("omitted")
    return s.select(omitted, "metric", F.col("chains").cast("int").alias("chains"), "states", F.round("mean", 9).alias("mean"), F.round("r_hat", 9).alias("r_hat"), F.round("bulk_ess", 6).alias("bulk_ess"))


@query("dia_15_projection")
def dia_15(v):
    r = statistics(v).select(*C.GROUP, "states", F.col("bulk_ess").alias("ess"), F.greatest(F.lit(400), 100 * F.col("chains")).cast("int").alias("needed"))
    return r.withColumn("projected_states", F.ceil(F.greatest(F.col("states"), F.col("states") * F.col("needed") / F.col("ess"))))


@query("int_09_screens")
def int_09(v):
    r = C.report(long_draws(v))
    return r.groupBy("cohort").agg(F.bool_and((F.size("screening_flags") == 0) & F.col("all_finite")).alias("passes"), F.count("*").alias("metrics"))
