"""Chain segments as a stream: an append-only sequence of bounded segments a seed, kept by state.

A segment is taken in whole, and only where the chain goes on. One that starts later waits, bounded in number, for those
between; one that overlaps what is there, has holes, is too long or can wait no longer is refused and named, never
merged. What is taken in and refused, and the states at every hundredth step, go to a file sink; so a stream that is
stopped goes on from its checkpoint as if it had not been.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mapstats.operators.contracts import ContractError

LONGEST = 1000  # states of a segment
WAITING = 16  # segments that a seed may hold back
EVERY = 100  # steps between snapshots

SEGMENT = "seed int, segment string, step long, dem_seats int, plan_hash string"
OUT = "seed int, kind string, segment string, first_step long, last_step long, next_step long, plan_hash string, changes long, seats_sum long, low_events long"
STATE = "next_step long, changes long, seats_sum long, low_events long, last_hash string, waiting string"


def write_wave(trace: DataFrame, path: str, first: int, last: int, width: int) -> None:
    """Append the states from first up to last to a folder of segments, a whole one in a file."""
    start = F.greatest(F.floor(F.col("step") / width) * width, F.lit(first))
    rows = trace.where((F.col("step") >= first) & (F.col("step") < last)).select("seed", F.concat_ws("-", "seed", start).alias("segment"), "step", "dem_seats", "plan_hash")
    rows.repartition("seed", "segment").write.mode("append").parquet(path)


def read_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    return spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files).parquet(path)


def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Take a seed's new segments in."""
    after, changes, seats, low, last, held = state.get if state.exists else (0, 0, 0, 0, None, "[]")
    waiting = json.loads(held)
    out: list[list] = []

    def said(kind: str, s: dict, plan: str | None = None, step: int | None = None) -> None:
        out.append([key[0], kind, s["name"], s["steps"][0] if step is None else step, s["steps"][-1] if step is None else step, after, plan, changes, seats, low])

    for name, g in pd.concat(list(batches)).groupby("segment"):
        g = g.sort_values("step")
        s = {"name": name, "steps": g["step"].tolist(), "seats": g["dem_seats"].tolist(), "plans": g["plan_hash"].tolist()}
        if len(g) > LONGEST:
            said("refused: too long", s)
        elif s["steps"] != list(range(s["steps"][0], s["steps"][0] + len(g))):
            said("refused: broken", s)
        else:
            waiting.append(s)
    waiting.sort(key=lambda s: (s["steps"][0], s["name"]))
    left = []
    for s in waiting:
        first = s["steps"][0]
        if first > after:
            left.append(s)
        elif first < after:
            said("refused: overlaps", s)
        else:
            taken = []
            for step, n, plan in zip(s["steps"], s["seats"], s["plans"], strict=True):
                changes += last is not None and plan != last
                seats, low, last, after = seats + n, low + (n <= 3), plan, step + 1
                if after % EVERY == 0:
                    taken.append((step, plan))
            said("segment", s)
            for step, plan in taken:
                said("snapshot", s, plan, step)
    while len(left) > WAITING:
        said("refused: gap", left.pop())
    state.update((after, changes, seats, low, last, json.dumps(left)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def taken(segments: DataFrame) -> DataFrame:
    """OUT: segments taken in or refused, and snapshots, of a stream of SEGMENT rows."""
    return segments.groupBy("seed").applyInPandasWithState(take, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, sink: str) -> DataFrame:
    """Run a stream over all that is there, into Parquet files, and return all that the sink holds by now."""
    q = stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(OUT).parquet(sink)


def refused(sink: DataFrame) -> DataFrame:
    return sink.where("kind LIKE 'refused:%'").select("seed", "segment", "first_step", "last_step", F.substring("kind", 10, 100).alias("reason"))


def require_none_refused(sink: DataFrame) -> DataFrame:
    """Fails closed, naming a segment that was refused."""
    if bad := refused(sink).orderBy("seed", "segment").first():
        raise ContractError(f"segment {bad['segment']} (steps {bad['first_step']} to {bad['last_step']}) was refused: {bad['reason']}")
    return sink


def snapshot_at(sink: DataFrame, steps: int) -> DataFrame:
    """The segments of a sink with what a snapshot of the first `steps` states makes of each: kept, later or straddles."""
    verdict = F.when(F.col("last_step") < steps, "kept").when(F.col("first_step") >= steps, "later").otherwise("straddles")
    return sink.where("kind = 'segment'").select("seed", "segment", "first_step", "last_step", verdict.alias("verdict"))


def milestones(marks: list[int], advance: Callable[[int, int], DataFrame], audit: Callable[[DataFrame, int], dict], passes: Callable[[dict], bool]) -> list[dict]:
    """Advance to each milestone in turn, audit what the sink then holds, and stop at the first that passes. An audit
    of a sink that refused something raises."""
    out, at = [], 0
    for mark in marks:
        report = {"milestone": mark} | audit(require_none_refused(advance(at, mark)), mark)
        out.append(report | {"passes": passes(report)})
        if out[-1]["passes"]:
            break
        at = mark
    return out


def event_windows(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Event-time windows of an events stream, closed by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
