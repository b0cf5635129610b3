"""Rows of conversations in order, as arrays of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of an array. Conversations with more come in pieces, so that none has to fit a task.
ROWS = 512
#: Long conversations that are broadcast at most; beyond, the join that parts them from others shuffles.
MANY = 100_000


def pieces(rows: DataFrame, key: str, order: list[str], limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of each key, sorted by `order` (nulls first), as `turns`, an array of structs of the other columns.

    First the keys of at most `limit` rows, a row each; then, or None where there are none, all other keys as
    pieces (numbered by `piece`, which grows along the key) of at most `limit` (ROWS) rows. Long keys are dealt out by
    ranges of (key, order), so that one of any size is spread over tasks. Equal rows keep no order among them.
    """
    limit = limit or ROWS
    rest = [c for c in rows.columns if c not in (key, *order)]
    gather = lambda df, *by: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("turns"))
    long = written(rows.groupBy(key).count().where(F.col("count") > limit).select(F.col(key).alias("__long")))
    n = long.count()
    if not n:
        return gather(rows, key), None
    few = F.broadcast(long) if n <= MANY else long
    hit = F.col(key).eqNullSafe(F.col("__long"))
    dealt = rows.join(few, hit, "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    by = [key, *order, "__tie"]
    placed = written(dealt.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    place, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    piece = F.shiftleft(place, 32) + F.floor(within / limit)
    return gather(rows.join(few, hit, "left_anti"), key), gather(placed.withColumn("piece", piece), key, "piece")
