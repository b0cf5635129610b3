import pytest

from mapstats.operators.contracts import ContractError
from mapstats.streaming import segments as S


def states(seed, name, steps, plan=lambda k: f"p{k // 3}"):
    return [(seed, name, k, k % 7, plan(k)) for k in steps]


class Stream:
    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.sink = spark, f"{tmp_path}/in", f"{tmp_path}/out"

    def __call__(self, *segments):
        rows = [r for s in segments for r in s]
        self.spark.createDataFrame(rows, S.SEGMENT).repartition("seed", "segment").write.mode("append").parquet(self.path)
        return S.run_once(S.taken(S.read_stream(self.spark, self.path)), self.sink)


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def taken(sink, seed=1):
    return [(r.segment, r.first_step, r.last_step) for r in sink.where(f"kind = 'segment' AND seed = {seed}").orderBy("first_step").collect()]


def test_segments_wait_for_those_between(stream):
    out = stream(states(1, "c", range(20, 30)), states(2, "x", range(5)))
    assert taken(out) == [] and taken(out, 2) == [("x", 0, 4)]
    out = stream(states(1, "a", range(10)))
    assert taken(out) == [("a", 0, 9)]
    out = stream(states(1, "b", range(10, 20)))
    assert taken(out) == [("a", 0, 9), ("b", 10, 19), ("c", 20, 29)]
    last = out.where("seed = 1 AND kind = 'segment'").orderBy("next_step").collect()[-1]
    assert (last.next_step, last.changes, last.seats_sum, last.low_events) == (30, 9, sum(k % 7 for k in range(30)), sum(k % 7 <= 3 for k in range(30)))
    assert S.require_none_refused(out) is out


def test_what_is_refused_is_named_and_never_merged(stream):
    stream(states(1, "a", range(10)))
    out = stream(states(1, "again", range(5, 15)), states(1, "holes", [10, 12]), states(1, "twice", [10, 10, 11]), states(1, "huge", range(10, 12 + S.LONGEST)))
    assert {(r.segment, r.reason) for r in S.refused(out).collect()} == {("again", "overlaps"), ("holes", "broken"), ("twice", "broken"), ("huge", "too long")}
    with pytest.raises(ContractError, match="again"):
        S.require_none_refused(out)
    out = stream(states(1, "b", range(10, 14)))
    assert taken(out) == [("a", 0, 9), ("b", 10, 13)]


def test_no_more_wait_than_are_allowed(stream, monkeypatch):
    out = stream(*[states(1, f"s{k:02}", range(10 * k, 10 * k + 10)) for k in range(1, S.WAITING + 3)])
    assert {(r.segment, r.reason) for r in S.refused(out).collect()} == {(f"s{k:02}", "gap") for k in (S.WAITING + 1, S.WAITING + 2)}
    assert len(taken(stream(states(1, "s00", range(10))))) == S.WAITING + 1


def test_snapshots(stream):
    out = stream(states(1, "a", range(150)), states(1, "b", range(150, 260)))
    assert [(r.first_step, r.plan_hash) for r in out.where("kind = 'snapshot'").orderBy("first_step").collect()] == [(99, "p33"), (199, "p66")]
    verdicts = lambda n: {r.segment: r.verdict for r in S.snapshot_at(out, n).collect()}
    assert verdicts(150) == {"a": "kept", "b": "later"} and verdicts(200) == {"a": "kept", "b": "straddles"}


def test_milestones_stop_at_the_first_that_passes(stream):
    advance = lambda a, b: stream(*[states(s, f"{s}-{a}", range(a, b)) for s in (1, 2)])
    audit = lambda out, mark: {"states": sum(b - a + 1 for s in (1, 2) for _, a, b in taken(out, s))}
    rows = S.milestones([10, 25, 40, 70], advance, audit, lambda r: r["states"] >= 60)
    assert [(r["milestone"], r["states"], r["passes"]) for r in rows] == [(10, 20, False), (25, 50, False), (40, 80, True)]
    stream(states(1, "late", range(3)))
    with pytest.raises(ContractError, match="was refused: overlaps"):
        S.milestones([50], advance, audit, lambda r: True)
