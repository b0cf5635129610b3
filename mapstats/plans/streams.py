"""Queries that run the stream of chain segments, over the trace in waves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapstats.session import workspace
from mapstats.streaming import segments as S

from .registry import query

WIDTH = 80
WAVES = 3
BOUNDARY = 200
MARKS = (160, 400, 800)
PASSED = 1.05


def length(v) -> int:
    return (v.trace.agg(F.max("step")).first()[0] or 0) + 1


def sink(v, extra: DataFrame | None = None) -> DataFrame:
    """What the stream makes of the trace in three waves of segments, resumed between them; `extra` comes before the last."""
    path = workspace(v.spark)
    n = length(v)
    ends = [0, *[(n * k // WAVES) // WIDTH * WIDTH for k in range(1, WAVES)], n]
    for k in range(WAVES):
        S.write_wave(v.trace, path, ends[k], ends[k + 1], WIDTH)
        if k == WAVES - 2 and extra is not None:
            extra.write.mode("append").parquet(path)
        out = S.run_once(S.taken(S.read_stream(v.spark, path)), f"{path}-sink")
    return out


SEGMENTS = f"g AS (SELECT seed, step // {WIDTH} AS k, min(step) AS first_step, max(step) AS last_step FROM v_trace GROUP BY 1, 2)"


@query("str_01_segments", f"WITH {SEGMENTS} SELECT seed, seed || '-' || first_step AS segment, first_step, last_step FROM g")
def str_01(v):
    """The segments that the stream took in."""
    return S.require_none_refused(sink(v)).where("kind = 'segment'").select("seed", "segment", "first_step", "last_step")


@query(
    "str_02_running_summary",
    """WITH t AS (SELECT *, lag(plan_hash) OVER (PARTITION BY seed ORDER BY step) AS p FROM v_trace)
    SELECT seed, count(*) AS states, max(step) + 1 AS next_step, count(*) FILTER (WHERE plan_hash <> p) AS changes, sum(dem_seats)::BIGINT AS seats_sum, count(*) FILTER (WHERE dem_seats <= 3) AS low_events FROM t GROUP BY 1""",
)
def str_02(v):
    """The last summary of each seed, after two stops and resumptions."""
    got = sink(v).where("kind = 'segment'")
    names = ("changes", "seats_sum", "low_events")
    return got.groupBy("seed").agg(F.sum(F.col("last_step") - F.col("first_step") + 1).alias("states"), F.max("next_step").alias("next_step"), *[F.max_by(c, "next_step").alias(c) for c in names])


@query("str_03_snapshots", "SELECT seed, step, plan_hash FROM v_trace WHERE step % 100 = 99")
def str_03(v):
    """The states that the stream saved."""
    return sink(v).where("kind = 'snapshot'").select("seed", F.col("first_step").alias("step"), "plan_hash")


@query(
    "str_04_snapshot",
    f"WITH {SEGMENTS} SELECT seed, count(*) FILTER (last_step < {BOUNDARY}) AS kept, count(*) FILTER (first_step >= {BOUNDARY}) AS later, max(seed || '-' || first_step) FILTER (first_step < {BOUNDARY} AND last_step >= {BOUNDARY}) AS straddling, count(*) FILTER (first_step < {BOUNDARY} AND last_step >= {BOUNDARY}) = 0 AS accepted FROM g GROUP BY 1",
)
def str_04(v):
    """A snapshot of the first states: a segment that lies across its end is named, and the snapshot refused."""
    got = S.snapshot_at(sink(v), BOUNDARY)
    across = F.col("verdict") == "straddles"
    return got.groupBy("seed").agg(F.count_if(F.col("verdict") == "kept").alias("kept"), F.count_if(F.col("verdict") == "later").alias("later"), F.max(F.when(across, F.col("segment"))).alias("straddling"), (F.count_if(across) == 0).alias("accepted"))


RHAT_SQL = """SELECT sqrt(((h - 1) * avg(w) + h * var_samp(m)) / h / avg(w)) FROM (SELECT seed, first, h, avg(x) AS m, var_samp(x) AS w FROM (SELECT seed, step < {mark} // 2 AS first, {mark} // 2 AS h, dem_seats::DOUBLE AS x FROM v_trace WHERE step < {mark}) GROUP BY 1, 2, 3) GROUP BY h"""


def _milestones_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {m}::BIGINT AS milestone, (SELECT count(DISTINCT seed) FROM v_trace) AS chains, (SELECT count(*) FROM v_trace WHERE step < {m}) AS states, round(({RHAT_SQL.format(mark=m)}), 9) AS split_rhat" for m in MARKS)
    return f"WITH r AS ({rows}), p AS (SELECT *, split_rhat < {PASSED} AND states = chains * milestone AS passes FROM r) SELECT * FROM p WHERE milestone <= coalesce((SELECT min(milestone) FROM p WHERE passes), {MARKS[-1]})"


@query("str_06_milestones", _milestones_sql())
def str_06(v):
    """Advance, audit and gate until the chains agree: each milestone's states come in through the stream."""
    path = workspace(v.spark)

    def advance(first: int, last: int) -> DataFrame:
        S.write_wave(v.trace, path, first, last, WIDTH)
        return S.run_once(S.taken(S.read_stream(v.spark, path)), f"{path}-sink")

    def audit(got: DataFrame, mark: int) -> dict:
        states = got.where("kind = 'segment'").agg(F.sum(F.col("last_step") - F.col("first_step") + 1).alias("n"), F.count_distinct("seed").alias("chains")).first()
        halves = v.trace.where(F.col("step") < mark).groupBy("seed", (F.col("step") < mark // 2).alias("first")).agg(F.avg("dem_seats").alias("m"), F.var_samp("dem_seats").alias("w"))
        h, w = mark // 2, F.avg("w")
        r = halves.agg(F.sqrt(F.try_divide((h - 1) * w + h * F.var_samp("m"), h * w))).first()[0]
        return {"chains": states["chains"], "states": states["n"], "split_rhat": None if r is None else round(r, 9)}

    def passes(report: dict) -> bool:
        return report["split_rhat"] is not None and report["split_rhat"] < PASSED and report["states"] == report["chains"] * report["milestone"]

    rows = S.milestones(list(MARKS), advance, audit, passes)
    return v.spark.createDataFrame([tuple(r[c] for c in ("milestone", "chains", "states", "split_rhat", "passes")) for r in rows], "milestone long, chains long, states long, split_rhat double, passes boolean")


@query("str_07_refused", "SELECT DISTINCT seed, 'late-' || seed AS segment, 10::BIGINT AS first_step, 19::BIGINT AS last_step, 'overlaps' AS reason FROM v_trace UNION ALL SELECT DISTINCT seed, 'holes-' || seed, 3::BIGINT, 9::BIGINT, 'broken' FROM v_trace")
def str_07(v):
    """Segments that come late or with holes are refused and named; the chain goes on without them (str_02)."""
    part = lambda name, where: v.trace.where(where).select("seed", F.concat_ws("-", F.lit(name), "seed").alias("segment"), "step", "dem_seats", "plan_hash")
    late = part("late", "step BETWEEN 10 AND 19").unionByName(part("holes", "step IN (3, 6, 9)"))
    return S.refused(sink(v, late.repartition("seed", "segment")))
