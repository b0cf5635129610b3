"""Repair of the turns of conversations by the cheapest edits, as a dynamic program over NumPy tensors.

The roles of a repaired conversation are those of `(s?(ua)+)?`: nothing, or user and assistant in turn, after a
system turn or not. Keeping a turn costs nothing, changing its role to the one that is due 2, deleting it 3 and
inserting an empty one 2; blank and repeated turns have to go, and a cut-off one that stays costs 1 more.

Conversations are bucketed by length, and a bucket is a tensor with time first: one step works on one turn of
all its conversations. Backward costs of the four states are stored for each turn, and edits are traced forward
for all conversations at once, the ASCII-least among the cheapest (D, I, K, R).

Rows go by turn, then role, then text, nulls first; nulls count as one space, also in the keys of the damage. A
role that is no s, u or a by its first character, or empty, can only be changed or deleted. Equal rows are
repeats. Conversations without rows give zeros and empty digests; an empty table gives no rows; other columns are
not read. Texts may be of any length: they are hashed one after the other.

A conversation of any number of turns is cut into pieces of 512 rows, which are dealt out to tasks: costs of a
piece from each state to each state are combined along the conversation, and each piece is then traced from the
state and to the costs that its neighbours leave to it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import turns
from .common import ship, tidy, written

#: States: nothing yet, system said, user said, assistant said. A conversation may end in the first and the last.
STATES = 4
FAR = np.int64(1 << 40)
ENDS = np.array([0, FAR, FAR, 0], dtype=np.int64)
#: The state after a turn of s, u, a or another role (3) in each state; -1: not allowed.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The role that is due in each state, and the state after it; it is what an inserted or changed turn gets.
DUE = np.array([2, 2, 3, 2])
ROLES = ("user", "assistant")
DELETE, INSERT, KEEP, REROLE, STOP = range(5)
LETTERS = b"DIKR"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs when any number of turns may be inserted first; the last axis is the state."""
    for _ in range(3):  # no useful run of insertions is longer
        costs = np.minimum(costs, costs[..., DUE] + COST[INSERT])
    return costs


class Bucket:
    """Conversations of similar length: role, gone and cut are turns x conversations and end together; the first
    turns of shorter ones are padding. ends: costs after the last turn, conversations x states. Where `last` is
    false another piece follows, and insertions after the last turn are left to it."""

    def __init__(self, lengths, role, gone, cut, ends=None, last=None):
        m = len(lengths)
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.n = n = int(self.lengths.max(initial=0))
        self.role, self.gone, self.cut = np.full((n, m), 3), np.zeros((n, m), dtype=bool), np.zeros((n, m), dtype=np.int64)
        for own, given in ((self.role, role), (self.gone, gone), (self.cut, cut)):
            for k, x in enumerate(given):
                own[n - len(x) :, k] = x
        self.ends = np.tile(ENDS, (m, 1)) if ends is None else np.asarray(ends, dtype=np.int64)
        self.last = np.ones(m, dtype=bool) if last is None else np.asarray(last, dtype=bool)

    def _options(self, t, who, after):
        """Costs by state of deleting, keeping and changing turn t of conversations `who`, given those after it."""
        gone, cut = self.gone[t, who][:, None], self.cut[t, who][:, None]
        to = AFTER[:, self.role[t, who]].T
        keep = np.where((to < 0) | gone, FAR, np.take_along_axis(after, np.maximum(to, 0), 1) + cut)
        change = np.where(gone, FAR, after[:, DUE] + COST[REROLE] + cut)
        return [after + COST[DELETE], keep, change]

    def backward(self) -> np.ndarray:
        """Costs from each turn on: (turns + 1) x conversations x states."""
        m = len(self.lengths)
        costs, who = np.empty((self.n + 1, m, STATES), dtype=np.int64), np.arange(m)
        costs[self.n] = _inserted(self.ends)
        for t in range(self.n - 1, -1, -1):
            now = _inserted(np.minimum.reduce(self._options(t, who, costs[t + 1])))
            costs[t] = np.minimum(np.where((t < self.n - self.lengths)[:, None], costs[t + 1], now), FAR)
        return costs

    def trace(self, costs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits and the states before each, steps x conversations, and the states at the end."""
        n, m = self.n, len(self.lengths)
        at, state, who = n - self.lengths, start.copy(), np.arange(m)
        edits, states = [np.empty((0, m), dtype=np.int64)], [np.empty((0, m), dtype=np.int64)]
        while True:
            now, inside, best = costs[at, who, state], at < n, np.full((m, 4), FAR)
            if inside.any():
                t = np.minimum(at, n - 1)
                for letter, cost in zip((DELETE, KEEP, REROLE), self._options(t, who, costs[t + 1, who]), strict=True):
                    best[:, letter] = np.where(inside, cost[who, state], FAR)
            best[:, INSERT] = np.where(inside | self.last, costs[at, who, DUE[state]] + COST[INSERT], FAR)
            edit = np.argmax(best == now[:, None], axis=1)
            edit[~inside & (~self.last | (self.ends[who, state] <= now))] = STOP
            if (edit == STOP).all():
                return np.concatenate(edits), np.concatenate(states), state
            edits.append(edit[None])
            states.append(state[None])
            kept = AFTER[state, self.role[np.minimum(at, n - 1), who]] if n else state
            state = np.where((edit == INSERT) | (edit == REROLE), DUE[state], np.where(edit == KEEP, kept, state))
            at = at + ((edit != INSERT) & (edit != STOP))


def buckets(lengths: list[int]) -> list[list[int]]:
    """Places of conversations, by the power of two that their length reaches."""
    by = defaultdict(list)
    for k, n in enumerate(lengths):
        by[(max(n, 1) - 1).bit_length()].append(k)
    return list(by.values())


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the checksum of their conversation and turn: conv_id, turn, role, text and
    live, which is false for rows that are dropped (without it their conversation would go with its last row)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(copies).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Whether rows are blank or cut off, and the codes of their roles (0 to 3: s, u, a, any other)."""
    shown = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    first = F.substring("role", 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "text", "live", (F.length(shown) == 0).alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"), code.alias("code"))


class Turns:
    """The live rows of one conversation, or of a piece of one: seen marks repeats of rows before the piece."""

    def __init__(self, rows: dict[str, list]):
        live = [k for k, x in enumerate(rows["live"]) if x]
        take = lambda c: [rows[c][k] for k in live]
        self.turn, self.role, self.text, code = take("turn"), take("role"), take("text"), take("code")
        known: set[tuple[str, str]] = set()
        again = []
        for pair in zip(self.role, self.text, strict=True):
            again.append(pair in known)
            known.add(pair)
        if "seen" in rows:
            again = take("seen")
        blank = take("blank")
        self.code = np.array(code, dtype=np.int64)
        self.blank = np.array(blank, dtype=bool)
        self.duplicate = np.array(again, dtype=bool) & ~self.blank
        self.gone = self.blank | self.duplicate
        self.cut = np.array(take("cut"), dtype=bool) & ~self.gone

    def counts(self) -> list[int]:
        """Blank, duplicate and truncated rows, and neighbours of roles that do not follow one another."""
        first = [r[:1] for r in self.role]
        return [int(x.sum()) for x in (self.blank, self.duplicate, self.cut)] + [sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))]

    def gaps(self) -> int:
        known = {t for t in self.turn if t is not None}
        return max(known) - min(known) + 1 - len(known) if known else 0

    def lines(self, edits, states) -> list[str]:
        """Repaired turns as role:text."""
        out, k = [], 0
        for e, q in zip(edits, states, strict=True):
            if e == KEEP:
                out.append(f"{self.role[k]}:{self.text[k]}")
            elif e in (REROLE, INSERT):
                out.append(f"{ROLES[DUE[q] - 2]}:{self.text[k] if e == REROLE else ''}")
            k += e != INSERT
        return out


def _turns(column: pa.Array) -> list[Turns]:
    """Conversations of a list column of structs."""
    flat, ends = column.flatten(), np.cumsum([0, *(len(x) for x in column)]).tolist()
    fields = {f.name: flat.field(f.name).to_pylist() for f in flat.type}
    return [Turns({c: v[a:b] for c, v in fields.items()}) for a, b in zip(ends, ends[1:], strict=False)]


def _solve(given: list[Turns], at: list[int], **kwargs) -> Bucket:
    return Bucket([len(given[k].role) for k in at], *[[getattr(given[k], c) for k in at] for c in ("code", "gone", "cut")], **kwargs)


def _letters(edits: np.ndarray) -> list[int]:
    return edits[edits != STOP].tolist()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.string()] * 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(TYPES)], COLUMNS)


@tidy
def _repair(batches):
    """Whole conversations: conv_id and turns to RESULT."""
    for batch in batches:
        given, ids, out = _turns(batch.column("turns")), batch.column("conv_id").to_pylist(), []
        for at in buckets([len(t.role) for t in given]):
            b = _solve(given, at)
            costs, start = b.backward(), np.zeros(len(at), dtype=np.int64)
            edits, states, _ = b.trace(costs, start)
            for j, k in enumerate(at):
                letters = _letters(edits[:, j])
                text = "\n".join(given[k].lines(letters, states[: len(letters), j]))
                out.append((ids[k], given[k].gaps(), *given[k].counts(), int(costs[0, j, 0]), bytes(LETTERS[e] for e in letters).decode(), hashlib.sha256(text.encode()).hexdigest()))
        yield _batch(out)


# --- conversations in pieces ---


@tidy
def _between(batches):
    """Of each piece, the costs from each state to each state."""
    for batch in batches:
        given = _turns(batch.column("turns"))
        out: list = [None] * len(given)
        for at in buckets([len(t.role) for t in given]):
            ends = [np.where(np.arange(STATES) == q, 0, FAR) for q in range(STATES)]
            costs = [_solve(given, at, ends=np.tile(e, (len(at), 1))).backward()[0] for e in ends]
            for j, k in enumerate(at):
                out[k] = np.stack([c[j] for c in costs], 1).ravel().tolist()
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "piece", "between"])


def _ends(batches):
    """Costs after each piece; pieces of a conversation come last one first."""
    conv, costs, begun = None, ENDS, False
    for batch in batches:
        out = []
        for c, between in zip(batch.column("conv_id").to_pylist(), batch.column("between").to_pylist(), strict=True):
            last = not begun or c != conv
            conv, begun, costs = c, True, ENDS if last else costs
            out.append((costs.tolist(), last))
            costs = np.minimum((np.array(between).reshape(STATES, STATES) + costs).min(1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array([x for x, _ in out], pa.list_(pa.int64())), pa.array([x for _, x in out], pa.bool_())], ["c", "p", "ends", "last"])


PIECE = "conv_id long, piece long, costs array<long>, audits array<string>, repaired array<array<string>>, states array<int>, counts array<long>, first string, final string"


@tidy
def _traced(batches):
    """Of each piece, edits and repaired turns from each of the states that it may begin in."""
    for batch in batches:
        given, ends, last = _turns(batch.column("turns")), batch.column("ends").to_pylist(), batch.column("last").to_pylist()
        out: list = [None] * len(given)
        for at in buckets([len(t.role) for t in given]):
            b = _solve(given, at, ends=[ends[k] for k in at], last=[last[k] for k in at])
            costs = b.backward()
            ways = [b.trace(costs, np.full(len(at), q)) for q in range(STATES)]
            for j, k in enumerate(at):
                letters = [_letters(e[:, j]) for e, _, _ in ways]
                lines = [given[k].lines(x, s[: len(x), j]) for x, (_, s, _) in zip(letters, ways, strict=True)]
                role = given[k].role
                out[k] = (costs[0, j].tolist(), [bytes(LETTERS[e] for e in x).decode() for x in letters], lines, [int(s[j]) for _, _, s in ways], given[k].counts(), role[0] if role else None, role[-1] if role else None)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], [x.split()[0] for x in PIECE.split(", ")])


def _joined(batches):
    """Pieces of a conversation in order, put together one by one."""
    conv, begun = None, False
    counts, cost, audit, state, digest, lines, role = [0] * 4, 0, [], 0, hashlib.sha256(), 0, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                if begun:
                    out.append((conv, 0, *counts, cost, "".join(audit), digest.hexdigest()))
                conv, begun = r["conv_id"], True
                counts, cost, audit, state, digest, lines, role = [0] * 4, r["costs"][0], [], 0, hashlib.sha256(), 0, None
            counts = [a + b for a, b in zip(counts, r["counts"], strict=True)]
            if r["first"] is not None:
                counts[3] += role is not None and role[:1] + r["first"][:1] not in ("su", "ua", "au")
                role = r["final"]
            audit.append(r["audits"][state])
            for line in r["repaired"][state]:
                digest.update(("\n" * (lines > 0) + line).encode())
                lines += 1
            state = r["states"][state]
        yield _batch(out)
    if begun:
        yield _batch([(conv, 0, *counts, cost, "".join(audit), digest.hexdigest())])


def _repair_long(pieces: DataFrame) -> DataFrame:
    """The same for conversations in pieces."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # Repeats of rows of other pieces: a row is the first of its kind or not.
    row = pieces.select("conv_id", "piece", F.posexplode("turns").alias("k", "x")).select("conv_id", "piece", "k", "x.*").withColumn("of", F.sha2(F.concat("role", F.lit(":"), "text"), 256))
    kinds = row.where("live").groupBy(F.col("conv_id").alias("c"), F.col("of").alias("o")).agg(F.min(F.struct("piece", "k")).alias("at"))
    row = row.join(kinds, same("conv_id", "c") & (F.col("of") == F.col("o")), "left")
    row = row.withColumn("seen", F.coalesce(F.struct("piece", "k") > F.col("at"), F.lit(False)))
    fields = ["k", "turn", "role", "text", "live", "blank", "cut", "code", "seen"]
    pieces = written(row.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("turns")))
    between = pieces.mapInArrow(_between, "conv_id long, piece long, between array<long>")
    ends = between.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).mapInArrow(_ends, "c long, p long, ends array<long>, last boolean")
    traced = pieces.join(ends, same("conv_id", "c") & (F.col("piece") == F.col("p"))).select("conv_id", "piece", "turns", "ends", "last").mapInArrow(_traced, PIECE)
    out = traced.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined, RESULT)
    own = pieces.select("conv_id", F.explode("turns").alias("x")).where("x.live").select(F.col("conv_id").alias("c"), F.col("x.turn").alias("turn"))
    gaps = own.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("g"))
    return out.join(gaps, same("conv_id", "c"), "left").select("conv_id", F.coalesce("g", F.lit(0)).cast("long").alias("gaps"), *COLUMNS[2:])


def repair(rows: DataFrame) -> DataFrame:
    """Of each conversation: gaps, blank, duplicate, truncated and illegal turns, the cost of the cheapest edits,
    audit (their initials), repaired_sha256 (of role:text of what is left, joined by line feeds)."""
    ship(rows.sparkSession)
    rows = rows if "live" in rows.columns else rows.withColumn("live", F.lit(True))
    short, long = turns.pieces(_marked(rows), "conv_id", ["turn", "role", "text"])
    out = short.select("conv_id", "turns").mapInArrow(_repair, RESULT)
    return out if long is None else out.unionByName(_repair_long(long))
