"""Running sums that no hot group can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive order values of one block.
BLOCK_BITS = 10


def running_sum(rows: DataFrame, group: list[str], order: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with each row, by ``order`` in ``group``.

    ``order`` is an integer that does not repeat within a group.  Rows are sorted within
    blocks of 2^10 order values only; what came before a block is a window over the sums
    of blocks, a thousandth of the rows.  Nulls in ``value`` count as 0.
    """
    placed = rows.withColumns(
        {"__order": order.cast("long"), "__block": F.shiftright(order.cast("long"), BLOCK_BITS), "__value": F.coalesce(value, F.lit(0))}
    )
    sums = placed.groupBy(*group, "__block").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, "__block").orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(offsets, [*group, "__block"]).withColumn(name, F.col("__offset") + F.sum("__value").over(inside))
    return summed.select(*[c for c in rows.columns if c != name], name)


#: Keys with more than this share of all rows are split; there can be fewer than 2,048 of them.
HOT_SHARE = 1 / 2_048


def with_salt(rows: DataFrame, counted: DataFrame, key: str, spread: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: a part number that splits the rows of a hot ``key`` by the hash of ``spread``.

    ``counted`` is a table with ``key`` that says how hot a key is (say, the source of ``rows``).  A key with
    a share of n times ``HOT_SHARE`` has n parts, rounded up, any other one part (number 0).  The hot
    keys are broadcast; their number is bounded by the share, whatever the size of the data.
    """
    total = counted.count()
    hot = (
        counted.groupBy(F.col(key).alias(key))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .where(F.col("__rows") > F.lit(total * HOT_SHARE))
        .select(key, F.ceil(F.col("__rows") / F.lit(total * HOT_SHARE)).alias("__parts"))
    )
    part = F.pmod(F.xxhash64(*spread), F.col("__parts"))
    return rows.join(F.broadcast(hot), key, "left").select(*rows.columns, F.coalesce(part, F.lit(0).cast("long")).alias(name))
