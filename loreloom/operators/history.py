"""Validity periods of changing attributes by tree-reduction coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions.statements import statement_digest
from loreloom.operators.snapshots import latest_delivery, snapshot_neighbours, with_neighbours

#: Rounds that run on one partitioning: 2^10 consecutive sequence numbers of an entity share a task.
ROUNDS_PER_SHUFFLE = 10
#: Stands for "no snapshot before" and "no snapshot after"; sequence numbers are integers.
_BEFORE, _AFTER = -(2**40), 2**40


def rounds_needed(low: int, high: int) -> int:
    """Rounds until all numbers from ``low`` to ``high`` lie in one block: a logarithm."""
    return (high - low).bit_length()


def merge_round(runs: DataFrame, level: int, home: list[str]) -> DataFrame:
    """One pairwise round: runs of neighbouring blocks of 2^(level-1) numbers become runs of blocks of 2^level.

    ``runs``: ``home`` columns, ``lo``, ``hi`` (the delivered snapshot after it), ``before``
    (the one before it) and ``digest``.  In each block at most one run of the left half
    ends where one of the right half begins; if their digests are equal, both have the
    same ``at`` and become one.
    """
    middle = F.shiftleft(F.shiftright("lo", level), level) + F.lit(1 << (level - 1))
    at = F.when((F.col("lo") < middle) & (F.col("hi") >= middle), F.col("hi")).otherwise(F.col("lo"))
    return runs.groupBy(*home, "digest", at.alias("at")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("before")
    )


def coalesce_runs(units: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """All pairwise rounds over unit intervals (``keys``, ``lo``, ``hi``, ``before``, ``digest``; ``lo`` from 0).

    Every ``ROUNDS_PER_SHUFFLE`` rounds the runs move once: those that touch an end of
    their block go to the task of the wider block, of which they can be at most two for
    each block below it; all others are complete and stay spread by where they begin.
    So no task holds more than 2^11 open runs of an entity, however long its history.
    """
    current = units
    for first in range(0, max(rounds, 1), ROUNDS_PER_SHUFFLE):
        begin = F.shiftleft(F.shiftright("lo", first), first)
        is_open = (F.col("before") < begin) | (F.col("hi") >= begin + F.lit(1 << first))
        wide = F.shiftright("lo", first + ROUNDS_PER_SHUFFLE)
        home = F.when(is_open, wide).otherwise(-1 - F.col("lo")) if first else wide
        current = current.withColumn("home", home).repartition(*keys, "home")
        for level in range(first + 1, min(first + ROUNDS_PER_SHUFFLE, rounds) + 1):
            current = merge_round(current, level, [*keys, "home"])
    return current


def attribute_versions(
    rows: DataFrame,
    snapshots: DataFrame,
    *,
    session: str,
    seq: str,
    entry: str,
    loaded: str,
    payload: list[str],
) -> DataFrame:
    """Every version of every entry with the snapshots that bound it.

    ``payload`` names arrays of statements, compared as sets (see
    ``functions.statements``).  ``snapshots`` lists the delivered snapshots, repeats
    allowed.  Result: ``session``, ``entry``, ``valid_from_seq``, ``valid_to_seq``
    (the session's next delivered snapshot after the version, -1 if there is none).

    Each delivered row is a unit interval ``[seq, next delivered seq)``.  Round ``r``
    merges, entity by entity, the runs of neighbouring blocks of 2^(r-1) sequence numbers
    pairwise where one ends as the next begins with equal payload.  The rounds are
    the logarithm of the range of sequence numbers; the driver reads its two ends to know
    how many there are.

    Defined cases: an empty table gives no rows; null arrays equal empty ones; rows
    without session, sequence number or entry are dropped; of repeated deliveries the
    last loaded holds; an absence in a delivered snapshot ends a version.
    """
    around, count, limits = snapshot_neighbours(
        snapshots.select(F.col(session).alias("__s"), F.col(seq).alias("__q")), "__s", "__q"
    )
    low, high = limits or (0, 0)
    facts = latest_delivery(
        rows.select(
            F.col(session).alias("__s"),
            F.col(entry).alias("__e"),
            F.col(seq).alias("__q"),
            F.col(loaded).alias("__at"),
            statement_digest(*[F.col(p) for p in payload]).alias("digest"),
        ),
        ["__s", "__e", "__q"],
        "__at",
        "digest",
    )
    base = F.lit(low).cast("long")

    def place(column: str, missing: int) -> Column:
        return F.coalesce(F.col(column).cast("long") - base, F.lit(missing).cast("long"))

    units = with_neighbours(facts, around, count, ["__s", "__q"]).select(
        "__s",
        "__e",
        "digest",
        place("__q", 0).alias("lo"),
        place("next_seq", _AFTER).alias("hi"),
        place("prev_seq", _BEFORE).alias("before"),
    )
    merged = coalesce_runs(units, ["__s", "__e"], rounds_needed(low, high))
    until = F.when(F.col("hi") == _AFTER, F.lit(-1).cast("long")).otherwise(F.col("hi") + base)
    kind = snapshots.schema[seq].dataType
    return merged.select(
        F.col("__s").alias(session),
        F.col("__e").alias(entry),
        (F.col("lo") + base).cast(kind).alias("valid_from_seq"),
        until.cast(kind).alias("valid_to_seq"),
    )


def version_rows(
    rows: DataFrame, versions: DataFrame, *, session: str, seq: str, entry: str, loaded: str, keep: list[str]
) -> DataFrame:
    """``versions`` with the columns ``keep`` of the delivery valid at their first snapshot."""
    first = rows.join(
        versions.withColumn(seq, F.col("valid_from_seq")), [session, entry, seq], "left_semi"
    ).select(session, entry, seq, loaded, F.struct(*keep).alias("__keep"))
    picked = latest_delivery(first, [session, entry, seq], loaded, "__keep")
    return versions.join(
        picked.withColumnRenamed(seq, "valid_from_seq"), [session, entry, "valid_from_seq"]
    ).select(session, entry, "valid_from_seq", "valid_to_seq", "__keep.*")
