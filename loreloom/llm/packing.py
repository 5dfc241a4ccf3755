"""Filling fixed-capacity containers by planning over a histogram of lengths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which the rows of one length are split for ranking, so that none is hot.
RANK_PARTS = 256
#: Slots that one row of the plan expands to.
SLOTS_AT_ONCE = 65_536


@dataclass(frozen=True)
class Segment:
    """Items ``first_rank ..`` of one length go one each into containers ``first_container ..``."""

    size: int
    first_rank: int
    count: int
    first_container: int


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[Segment]:
    """Best-fit decreasing over counts of lengths.

    Containers with equal room are handled together: the fullest that still take the
    length get as many items as go in, then new ones are opened.  The result equals
    best-fit decreasing item by item; the work depends on the capacity, not on the
    number of items.
    """
    if any(size < 1 or size > capacity for size in histogram):
        raise ValueError("lengths must be between 1 and the capacity")
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    plan: list[Segment] = []
    opened = 0
    for size in sorted(histogram, reverse=True):
        rank, left = 0, histogram[size]
        space = size
        while left:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:
                each = capacity // size
                group = (opened, max(1, left // each))
                opened += group[1]
                here = capacity
            else:
                each = space // size
                group = room[space].pop()
                here = space
            first, available = group
            if left < each:
                filled, each = 1, left
            else:
                filled = min(available, left // each)
            for _ in range(each):
                plan.append(Segment(size, rank, filled, first))
                rank += filled
            left -= each * filled
            if filled < available:
                room[here].append((first + filled, available - filled))
            rest = here - each * size
            if rest:
                room[rest].append((first, filled))
    return plan


def _slots(spark: SparkSession, plan: list[Segment]) -> DataFrame:
    """One row for each planned slot: ``size``, ``rank``, ``container_id``."""
    rows = [(s.size, s.first_rank, s.count, s.first_container) for s in plan]
    schema = "size int, first_rank bigint, count bigint, first_container bigint"
    segments = spark.createDataFrame(rows, schema)
    blocks = segments.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1, F.lit(SLOTS_AT_ONCE).cast("bigint"))).alias("from")
    ).repartition("size", "first_rank", "from")
    each = F.explode(
        F.sequence("from", F.least(F.col("from") + SLOTS_AT_ONCE - 1, F.col("count") - 1))
    ).alias("i")
    return blocks.select("size", "first_rank", "first_container", each).select(
        "size",
        (F.col("first_rank") + F.col("i")).alias("rank"),
        (F.col("first_container") + F.col("i")).alias("container_id"),
    )


def items_of(sized: DataFrame, id_column: str, size_column: str, capacity: int) -> DataFrame:
    """Items to place: a document, or its pieces if it alone exceeds the capacity."""
    total = F.col(size_column)
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((total - 1) / capacity))
    return (
        sized.where(total > 0)
        .select(F.col(id_column).alias("__id"), total.alias("__n"), F.explode(pieces).alias("piece"))
        .select(
            "__id",
            "piece",
            (F.col("piece") * capacity).alias("token_from"),
            F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity).cast("int").alias("size"),
        )
    )


def pack(sized: DataFrame, id_column: str, size_column: str, capacity: int) -> DataFrame:
    """Assign each document to a container of ``capacity``.

    ``sized`` holds one row for each document and should be materialised, as it is read
    twice.  Result: ``id_column``, ``piece``, ``token_from``, ``n_tokens``,
    ``container_id``.  A document within the capacity is one piece; a larger one fills
    whole containers and leaves a rest.  Null and non-positive sizes take no container;
    an empty table gives no rows.

    The driver sees the histogram only, at most ``capacity`` rows.  Items find their
    slot by an equi-join on rank within length; the rank is counted in ``RANK_PARTS``
    parts of a length, joined by offsets, so that a length of very many documents is
    never one task's.
    """
    spark = sized.sparkSession
    items = items_of(sized, id_column, size_column, capacity).withColumn(
        "part", F.pmod(F.xxhash64("__id", "piece"), F.lit(RANK_PARTS))
    )
    by_part = items.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in by_part.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(spark, best_fit_plan(histogram, capacity))

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "part").orderBy("__id", "piece")
    ranked = (
        items.withColumn("rank_in", F.row_number().over(inside) - 1)
        .join(offsets, ["size", "part"])
        .withColumn("rank", F.col("offset") + F.col("rank_in"))
    )
    return ranked.join(slots, ["size", "rank"]).select(
        F.col("__id").alias(id_column),
        F.col("piece").cast("int").alias("piece"),
        F.col("token_from").cast("bigint").alias("token_from"),
        F.col("size").alias("n_tokens"),
        "container_id",
    )
