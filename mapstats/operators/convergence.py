"""Convergence diagnostics of cohorts of chains as joins, ranges and blocks; no task holds a cohort.

Ranks come from counts of values and running sums over their order, normal scores from a rational approximation in
SQL, R-hat from moments of half-chains. Autocovariances come from products of blocks of draws that lie a number of
blocks apart, as far as Geyer's sequence asks: the next lags are computed for those cohorts only whose sequence
has not ended. Quantiles and their errors are order statistics picked by place from the counts.

Definitions are those of functions.diagnostics, which computes the same from an array, and which the tests use.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mapstats.functions.diagnostics import beta_quantile
from mapstats.session import materialised

from .ordering import at_places, cumulative

BLOCK = 512
GROUP = ["cohort", "metric"]

#: Wichura's algorithm AS 241 (1988), numerators and denominators near the middle, in the tails and far out.
_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(both: tuple, r: Column) -> Column:
    def value(terms: tuple) -> Column:
        out = F.lit(terms[-1])
        for t in reversed(terms[:-1]):
            out = out * r + t
        return out

    return value(both[0]) / value(both[1])


def with_normal_quantile(df: DataFrame, name: str, p: Column) -> DataFrame:
    """df with the inverse of the normal distribution at p, to double precision. In steps, as one expression would
    repeat its argument in each term of the polynomials."""
    df = df.withColumn("__p", p).withColumn("__q", F.col("__p") - 0.5)
    q, r = F.col("__q"), F.col("__r")
    df = df.withColumn("__r", F.when(F.abs(q) <= 0.425, 0.180625 - q * q).otherwise(F.sqrt(-F.log(F.least(F.col("__p"), 1 - F.col("__p"))))))
    value = F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, r)).otherwise(F.signum(q) * F.when(r <= 5, _ratio(_TAIL, r - 1.6)).otherwise(_ratio(_FAR, r - 5)))
    return df.withColumn(name, value).drop("__p", "__q", "__r")


def _with_score(df: DataFrame, name: str, before: str, n: str, total: str) -> DataFrame:
    """Normal score of the average rank of equal values."""
    return with_normal_quantile(df, name, (F.col(before) + (F.col(n) + 1) / 2 - 0.375) / (F.col(total) + 0.25))


# --- autocovariance by blocks ---


def blocked(draws: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, block, rows: the values of BLOCK draws, in the order of pos."""
    of = F.struct("pos", F.array(*values).alias("c"))
    return draws.groupBy(*keys, F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(of)).alias("rows")).withColumn("rows", F.col("rows.c"))


def lag_sums(blocks: DataFrame, keys: list[str], first: int, last: int, series: int) -> DataFrame:
    """keys, series, lag, s: sums of the products of values that lie lag apart, for lags from first to last blocks."""
    kinds = dict(blocks.dtypes)
    a = blocks.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("other", F.col("block") + F.col("d"))
    b = blocks.select(*keys, F.col("block").alias("other"), F.col("rows").alias("later"))
    pairs = a.join(b, [*keys, "other"]).select(*keys, "d", "rows", "later")
    width = 2 * BLOCK - 1

    def flush(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(keys) + 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([v.ravel().tolist() for v in held.values()], pa.list_(pa.float64()))], [*keys, "d", "sums"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            own = list(zip(*(batch.column(k).to_pylist() for k in (*keys, "d")), strict=True))
            for k, row, later in zip(own, batch.column("rows"), batch.column("later"), strict=True):
                x, y = (v.values.flatten().to_numpy().reshape(-1, series) for v in (row, later))
                sums = held.setdefault(k, np.zeros((series, width)))
                for i in range(series):
                    # At place p of the result: products of values p - len(x) + 1 apart.
                    sums[i, BLOCK - len(x) : BLOCK - 1 + len(y)] += np.correlate(y[:, i], x[:, i], "full")
                if len(held) > 256:
                    yield flush(held, schema)
                    held = {}
        if held:
            yield flush(held, schema)

    got = pairs.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", d int, sums array<double>")
    place = F.pmod(F.col("at"), F.lit(width)) - (BLOCK - 1)
    rows = got.select(*keys, "d", F.posexplode("sums").alias("at", "s")).select(*keys, F.floor(F.col("at") / width).cast("int").alias("series"), (F.col("d") * BLOCK + place).cast("long").alias("lag"), "s")
    return rows.where((F.col("lag") >= first * BLOCK) & (F.col("lag") < last * BLOCK)).groupBy(*keys, "series", "lag").agg(F.sum("s").alias("s"))


def effective_sizes(draws: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """group, series (number of the value), m, n, ess: effective sizes of the mean of draws(group, chain, pos, values)
    by Geyer's initial monotone sequence; null where a value is not finite or n is below 4."""
    keys = [*group, "chain"]
    means = materialised(draws.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values], *[F.min(v).alias(f"min_{v}") for v in values], *[F.max(v).alias(f"max_{v}") for v in values]))
    centred = draws.join(means.select(*keys, *[f"mean_{v}" for v in values]), keys).select(*keys, "pos", *[(F.col(v) - F.col(f"mean_{v}")).alias(v) for v in values])
    blocks = materialised(blocked(centred, keys, values))
    long = means.select(*keys, "n", F.posexplode(F.array(*[F.struct(F.col(f"mean_{v}").alias("mean"), F.col(f"min_{v}").alias("low"), F.col(f"max_{v}").alias("high")) for v in values])).alias("series", "x"))
    between = F.coalesce(F.var_samp("x.mean"), F.lit(0.0))
    shape = materialised(long.groupBy(*group, "series").agg(F.count("*").alias("m"), F.max("n").alias("n"), between.alias("between"), F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.avg("x.mean").alias("mean")))
    found, sums, first, last = None, None, 0, 1
    longest = shape.agg(F.max("n")).first()[0] or 0
    open_blocks = blocks
    while True:
        more = lag_sums(open_blocks, keys, first, last, len(values))
        of = more.join(means.select(*keys, "n"), keys).groupBy(*group, "series", "lag").agg(F.avg(F.col("s") / F.col("n")).alias("cov"))
        sums = materialised(of if sums is None else sums.unionByName(of))
        ended = materialised(_geyer(sums, shape, group, last * BLOCK))
        done = ended.where("ended")
        found = done if found is None else found.unionByName(done)
        left = ended.where("NOT ended").select(*group).distinct()
        if last * BLOCK >= longest or not left.limit(1).count():
            return found.select(*group, "series", "m", "n", "ess")
        open_blocks = open_blocks.join(left, group, "left_semi")
        sums = sums.join(ended.where("NOT ended").select(*group, "series"), [*group, "series"], "left_semi")
        shape = shape.join(ended.where("NOT ended").select(*group, "series"), [*group, "series"], "left_semi")
        first, last = last, 4 * last


def _geyer(cov: DataFrame, shape: DataFrame, group: list[str], known: int) -> DataFrame:
    """group, series, m, n, ess, ended: whether the lags below `known` are all that the sequence needs."""
    g = [*group, "series"]
    c = cov.join(shape, g)
    within = F.try_divide(F.col("cov0") * F.col("n"), F.col("n") - 1)
    zero = cov.where("lag = 0").select(*g, F.col("cov").alias("cov0"))
    plus = within * (F.col("n") - 1) / F.col("n") + F.col("between")
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - F.try_divide(within - F.col("cov"), plus))
    c = c.join(zero, g).select(*g, "lag", "n", rho.alias("rho"))
    pairs = c.where("2 * floor(lag / 2) < n - 3").groupBy(*g, F.floor(F.col("lag") / 2).alias("k")).agg(F.sum("rho").alias("p"), F.min(F.struct("lag", "rho")).getField("rho").alias("even"), F.count("*").alias("both"))
    pairs = pairs.where("both = 2")
    end = pairs.where("k > 0 AND p <= 0").groupBy(*g).agg(F.min("k").alias("end"))
    pairs = pairs.join(end, g, "left")
    least = F.min("p").over(Window.partitionBy(*g).orderBy("k"))
    kept = pairs.where("end IS NULL OR k < end").withColumn("least", least).groupBy(*g).agg(F.sum("least").alias("total"), F.max("k").alias("last"))
    after = c.select(*g, F.col("lag").alias("after"), F.col("rho").alias("tail"))
    out = shape.join(kept, g, "left").join(end, g, "left").withColumn("after", 2 * (F.col("last") + 1)).join(after, [*g, "after"], "left")
    size = (F.col("m") * F.col("n")).cast("double")
    tau = F.greatest(-1 + 2 * F.col("total") + F.greatest(F.coalesce("tail", F.lit(0.0)), F.lit(0.0)), F.try_divide(F.lit(1.0), F.log10(size)))
    constant = F.col("low") == F.col("high")
    finite = ~(F.isnan("mean") | F.isnan("low") | F.isnan("high") | (F.abs("high") == float("inf")) | (F.abs("low") == float("inf")))
    ess = F.when((F.col("n") >= 4) & finite, F.when(constant, size).otherwise(F.try_divide(size, tau)))
    ended = F.col("end").isNotNull() | (F.col("n") <= known) | constant | ~F.coalesce(finite, F.lit(False))
    return out.select(*g, "m", "n", ess.alias("ess"), ended.alias("ended"))


# --- all statistics ---


@F.pandas_udf(DoubleType())
def _beta(a: pd.Series, b: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([beta_quantile(x, y, q) if x > 0 and y > 0 else np.nan for x, y, q in zip(a, b, p, strict=True)], dtype=float)


def ranked(draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """draws(cohort, metric, seed, step, value) with chain, pos, n and normal scores (score, of all draws; split_score,
    of those in halves; folded_score, of distances from the median), and the counts of values.

    The first and the last half of each chain are chains of their own; an odd middle draw is in neither (chain null)."""
    lengths = draws.groupBy(*GROUP, "seed").agg(F.count("*").alias("n")).groupBy(*GROUP).agg(F.min("n").alias("n"), F.count("*").alias("chains"))
    d = draws.join(lengths, GROUP).withColumn("half", F.floor(F.col("n") / 2))
    side = F.when(F.col("step") < F.col("half"), 0).when(F.col("step") >= F.col("n") - F.col("half"), 1)
    pos = F.when(side == 1, F.col("step") - (F.col("n") - F.col("half"))).otherwise(F.col("step"))
    d = materialised(d.select(*GROUP, "seed", "step", "value", "n", "chains", F.when(side.isNotNull(), F.col("seed") * 2 + side).alias("chain"), pos.alias("pos")))
    totals = d.groupBy(*GROUP).agg(F.count("*").alias("total"), F.count("chain").alias("split_total"))
    counts = d.groupBy(*GROUP, "value").agg(F.count("*").alias("n"), F.count("chain").alias("split_n"))
    counts = materialised(cumulative(counts, GROUP, ["value"], "n", "split_n").join(totals, GROUP))
    half = lambda k: F.floor((F.col("total") - 1 + k) / 2).cast("long").alias("place")
    middle = totals.select(*GROUP, F.lit("low").alias("name"), half(0)).unionByName(totals.select(*GROUP, F.lit("high").alias("name"), half(1)))
    median = at_places(counts, GROUP, middle).groupBy(*GROUP).agg(F.avg("value").alias("median"))
    away = F.abs(F.col("value") - F.col("median"))
    folded = counts.join(median, GROUP).groupBy(*GROUP, away.alias("away"), "total").agg(F.sum("n").alias("n"))
    folded = materialised(_with_score(cumulative(folded, GROUP, ["away"], "n"), "folded_score", "before_n", "n", "total").select(*GROUP, "away", "folded_score"))
    own = _with_score(_with_score(counts, "score", "before_n", "n", "total"), "split_score", "before_split_n", "split_n", "split_total")
    own = materialised(own.select(*GROUP, "value", "score", "split_score"))
    scores = own.join(median, GROUP).withColumn("away", away).join(folded, [*GROUP, "away"]).drop("away", "median")
    return d.join(scores, [*GROUP, "value"]), counts


def split_rhat(draws: DataFrame, value: str) -> Column:
    """Over rows of one half-chain each, with n, mean and variance of a value."""
    n, w = F.avg("half_n"), F.avg(f"var_{value}")
    r = F.sqrt(F.try_divide((n - 1) * w + n * F.var_samp(f"mean_{value}"), n * w))
    return F.when((w > 0) & (n >= 2) & ~F.isnan(w), r)


def statistics(draws: DataFrame) -> DataFrame:
    """cohort, metric, chains, states, mean, sd and the seven statistics of functions.diagnostics, null where not finite;
    ess_mean is the effective size of the mean itself, q05 and q95 the quantiles. Chains of a cohort have equal lengths."""
    d, counts = ranked(draws)
    d = materialised(d)
    base = d.groupBy(*GROUP).agg(F.first("chains").alias("chains"), F.count("*").alias("states"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    halves = d.where("chain IS NOT NULL").groupBy(*GROUP, "chain").agg(F.count("*").alias("half_n"), *[f(v).alias(f"{n}_{v}") for v in ("score", "folded_score") for n, f in (("mean", F.avg), ("var", F.var_samp))])
    rhat = halves.groupBy(*GROUP).agg(split_rhat(halves, "score").alias("r_bulk"), split_rhat(halves, "folded_score").alias("r_folded"))
    quantiles, totals = {"q05": 0.05, "q95": 0.95}, counts.select(*GROUP, "total").distinct()
    ends = [F.struct(F.lit(f"{q}{e}").alias("name"), f((F.col("total") - 1) * F.lit(p)).cast("long").alias("place")) for q, p in quantiles.items() for e, f in (("a", F.floor), ("b", F.ceil))]
    wanted = totals.select(*GROUP, F.explode(F.array(*ends)).alias("x")).select(*GROUP, "x.*")
    picked = at_places(counts, GROUP, wanted).groupBy(*GROUP).pivot("name", [f"{q}{e}" for q in quantiles for e in "ab"]).agg(F.first("value"))

    def between(q: str, p: float) -> Column:
        at = (F.col("total") - 1) * F.lit(p)
        return (F.col(f"{q}a") + (F.col(f"{q}b") - F.col(f"{q}a")) * (at - F.floor(at))).alias(q)

    q = materialised(picked.join(totals, GROUP).select(*GROUP, *[between(*x) for x in quantiles.items()]))
    series = ["bulk", "low", "high", "plain", "square"]
    split = d.where("chain IS NOT NULL").join(q, GROUP).select(*GROUP, "chain", "pos", F.col("split_score").alias("bulk"), (F.col("value") <= F.col("q05")).cast("double").alias("low"), (F.col("value") <= F.col("q95")).cast("double").alias("high"), F.col("value").alias("plain"), (F.col("value") * F.col("value")).alias("square"))
    sizes = effective_sizes(split, GROUP, series).groupBy(*GROUP).pivot("series", list(range(5))).agg(F.first("ess"))
    sizes = sizes.select(*GROUP, *[F.col(str(k)).alias(f"ess_{s}") for k, s in enumerate(series)])
    out = base.join(rhat, GROUP).join(q, GROUP).join(sizes, GROUP)
    constant = F.col("low") == F.col("high")
    size = F.least("ess_plain", "ess_square")
    factor = F.exp(F.lit(1.0)) * F.pow(1 - F.try_divide(F.lit(1.0), size), size - 1) - 1
    out = out.withColumns({
        "r_hat": F.when(F.col("r_bulk").isNotNull() & F.col("r_folded").isNotNull(), F.greatest("r_bulk", "r_folded")),
        "bulk_ess": F.when(constant, F.col("states").cast("double")).otherwise(F.col("ess_bulk")),
        "tail_ess": F.when(F.col("ess_low").isNotNull() & F.col("ess_high").isNotNull(), F.least("ess_low", "ess_high")),
        "ess_mean": F.col("ess_plain"),
        "mcse_mean": F.try_divide(F.col("sd"), F.sqrt("ess_plain")),
        "mcse_sd": F.when(F.col("ess_plain").isNotNull() & F.col("ess_square").isNotNull() & (size > 1), F.col("sd") * F.sqrt(F.greatest(factor, F.lit(0.0)))),
    })
    out = materialised(out)
    edge = lambda e, p, at: _beta(F.col(e) * p + 1, F.col(e) * (1 - p) + 1, F.lit(at))
    low = lambda c: F.greatest(F.lit(0), F.floor(c * F.col("states")) - 1).cast("long")
    high = lambda c: F.least(F.col("states") - 1, F.ceil(c * F.col("states")) - 1).cast("long")
    places = [F.struct(F.lit(n).alias("name"), place(edge(e, p, at)).alias("place")) for e, p, names in (("ess_low", 0.05, ("a05", "b05")), ("ess_high", 0.95, ("a95", "b95"))) for n, at, place in ((names[0], 0.1586553, low), (names[1], 0.8413447, high))]
    picked = at_places(counts, GROUP, out.select(*GROUP, F.explode(F.array(*places)).alias("x")).select(*GROUP, "x.*")).groupBy(*GROUP).pivot("name", ["a05", "b05", "a95", "b95"]).agg(F.first("value"))
    out = out.join(picked, GROUP, "left").withColumns({f"mcse_q{p}": (F.col(f"b{p}") - F.col(f"a{p}")) / 2 for p in ("05", "95")})
    return out.select(*GROUP, "chains", "states", "mean", "sd", "q05", "q95", "ess_mean", "low", "high", *STATISTICS)


STATISTICS = ("r_hat", "bulk_ess", "tail_ess", "mcse_mean", "mcse_sd", "mcse_q05", "mcse_q95")


def report(draws: DataFrame) -> DataFrame:
    """Statistics with the smallest effective size that passes, what is not finite, and what misses the screens."""
    s = statistics(draws)
    least = F.greatest(F.lit(400), 100 * F.col("chains")).cast("int")
    short = lambda c: F.col(c).isNull() | (F.col(c) < least)
    bad = {"r_hat": F.col("r_hat").isNull() | (F.col("r_hat") >= 1.01), "bulk_ess": short("bulk_ess"), "tail_ess": short("tail_ess")}
    flags = F.filter(F.array(*[F.when(c, n) for n, c in bad.items()]), lambda x: x.isNotNull())
    issues = F.filter(F.array(*[F.when(F.col(n).isNull(), f"{n} is not finite") for n in STATISTICS]), lambda x: x.isNotNull())
    return s.select(*GROUP, *STATISTICS, least.alias("ess_screening_minimum"), (F.size(issues) == 0).alias("all_finite"), flags.alias("screening_flags"), issues.alias("issues"))


def chain_sizes(draws: DataFrame, keys: list[str]) -> DataFrame:
    """keys, simple_ess, pair_ess of each chain of draws(keys, pos, value): stopped at the first autocorrelation, or the
    first pair of them, that is not positive."""
    means = materialised(draws.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.min("value").alias("low"), F.max("value").alias("high")))
    centred = draws.join(means.select(*keys, "mean"), keys).select(*keys, "pos", (F.col("value") - F.col("mean")).alias("c"))
    blocks, sums, first, last = materialised(blocked(centred, keys, ["c"])), None, 0, 1
    longest, open_ = means.agg(F.max("n")).first()[0] or 0, means
    out = None
    while True:
        more = lag_sums(blocks, keys, first, last, 1).select(*keys, "lag", "s")
        sums = materialised(more if sums is None else sums.unionByName(more))
        r = sums.join(open_, keys).where("lag > 0").withColumn("rho", F.try_divide(F.col("s"), (F.col("n") - F.col("lag")) * F.col("var")))
        up = Window.partitionBy(*keys)
        simple = r.where("lag < floor(n / 2)").withColumn("end", F.min(F.when(F.col("rho") <= 0, F.col("lag"))).over(up))
        simple = simple.where("end IS NULL OR lag < end").groupBy(*keys).agg(F.sum("rho").alias("simple"))
        ends = r.where("lag < floor(n / 2) AND rho <= 0").groupBy(*keys).agg(F.lit(True).alias("simple_ended"))
        pair = r.where("2 * floor((lag - 1) / 2) + 1 < n - 1").groupBy(*keys, F.floor((F.col("lag") - 1) / 2).alias("k")).agg(F.sum("rho").alias("p"), F.count("*").alias("both")).where("both = 2")
        pair = pair.withColumn("end", F.min(F.when(F.col("p") <= 0, F.col("k"))).over(up))
        pairs = pair.where("end IS NULL OR k < end").groupBy(*keys).agg(F.sum("p").alias("pairs"))
        pair_ends = pair.where("end IS NOT NULL").select(*keys).distinct().withColumn("pair_ended", F.lit(True))
        now = open_
        for x in (simple, ends, pairs, pair_ends):
            now = now.join(x, keys, "left")
        constant = F.col("low") == F.col("high")
        over = (F.col("simple_ended") & F.col("pair_ended")) | (F.col("n") <= last * BLOCK) | constant
        n, total = F.col("n").cast("double"), lambda c: F.coalesce(c, F.lit(0.0))
        now = materialised(now.select(*keys, *open_.columns[len(keys) :], F.coalesce(over, F.lit(False)).alias("over"), F.when((n < 3) | constant, n).otherwise(F.try_divide(n, 1 + 2 * total(F.col("simple")))).alias("simple_ess"), F.when((n >= 4) & ~constant, F.least(n, n / (1 + 2 * total(F.col("pairs"))))).alias("pair_ess")))
        done = now.where("over").select(*keys, "simple_ess", "pair_ess")
        out = done if out is None else out.unionByName(done)
        left = now.where("NOT over")
        if last * BLOCK >= longest or not left.limit(1).count():
            return out
        open_ = left.select(*open_.columns)
        blocks, sums = (x.join(left.select(*keys), keys, "left_semi") for x in (blocks, sums))
        first, last = last, 4 * last
