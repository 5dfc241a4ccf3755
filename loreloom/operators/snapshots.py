"""Delivered snapshots: their order, and the valid delivery of each entry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut_lineage

#: Distinct sequence numbers of one block; a block is the unit that is sorted in memory.
BLOCK_BITS = 10
#: Most snapshots whose neighbours are broadcast (about 100 bytes each).
BROADCAST_SNAPSHOTS = 200_000


def latest_delivery(rows: DataFrame, key: list[str], loaded: str, payload: str) -> DataFrame:
    """One row for each ``key``: the payload of the delivery that was loaded last.

    Ties on ``loaded`` go to the larger payload, so the result does not depend on
    the order of the rows; a null ``loaded`` is older than any time.  Rows with a
    null in ``key`` belong to no entry and are dropped.  The aggregation combines on
    the map side, so a group of copies is one row before it is shuffled.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    newest = F.max(F.struct(F.col(loaded).alias("at"), F.col(payload).alias("payload")))
    return rows.where(known).groupBy(*key).agg(newest["payload"].alias(payload))


def snapshot_neighbours(
    snapshots: DataFrame, session: str, seq: str
) -> tuple[DataFrame, int, tuple[int, int] | None]:
    """For each distinct delivered snapshot its delivered neighbours.

    Returns a checkpointed table of ``session``, ``seq``, ``prev_seq`` (null for the first) and
    ``next_seq`` (null for the last), its number of rows, and the least and greatest sequence number
    (None of an empty table).  Numbers are first sorted inside blocks of 2^10 consecutive values, which
    hold at most 1,024 distinct ones whatever a session's size; only block heads meet in a window over
    the session.
    """
    block = F.shiftright(F.col(seq).cast("long"), BLOCK_BITS)
    blocks = (
        snapshots.where(F.col(session).isNotNull() & F.col(seq).isNotNull())
        .groupBy(F.col(session).alias(session), block.alias("__block"))
        .agg(F.sort_array(F.collect_set(seq)).alias("__seqs"))
    )
    along = Window.partitionBy(session).orderBy("__block")
    blocks = blocks.select(
        session,
        "__seqs",
        F.lag(F.element_at("__seqs", -1)).over(along).alias("__before"),
        F.lead(F.element_at("__seqs", 1)).over(along).alias("__after"),
    )
    last = F.size("__seqs")
    listed = blocks.select(
        session,
        F.inline(
            F.transform(
                "__seqs",
                lambda s, i: F.struct(
                    s.alias(seq),
                    F.when(i == 0, F.col("__before")).otherwise(F.get("__seqs", i - 1)).alias("prev_seq"),
                    F.when(i == last - 1, F.col("__after")).otherwise(F.get("__seqs", i + 1)).alias("next_seq"),
                ),
            )
        ),
    )
    known = cut_lineage(listed)
    count, low, high = known.agg(F.count(F.lit(1)), F.min(seq), F.max(seq)).first()
    return known, count, None if low is None else (low, high)


def with_neighbours(facts: DataFrame, around: DataFrame, count: int, on: list[str]) -> DataFrame:
    """``facts`` with the neighbours of their snapshots (``count`` rows, see ``snapshot_neighbours``).

    Neighbours are broadcast only up to ``BROADCAST_SNAPSHOTS`` rows, which bounds their size; more
    are joined by their key, and adaptive execution splits a hot one.
    """
    return facts.join(F.broadcast(around) if count <= BROADCAST_SNAPSHOTS else around, on)


def union_snapshots(tables: list[DataFrame], session: str, seq: str) -> DataFrame:
    """Snapshots delivered in any of ``tables`` (an empty part of a snapshot has no rows)."""
    parts = [t.select(F.col(session), F.col(seq)) for t in tables]
    return reduce(DataFrame.unionByName, parts)
