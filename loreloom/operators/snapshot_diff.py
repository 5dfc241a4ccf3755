"""Changes between consecutive full snapshots by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.operators.running import with_salt
from loreloom.operators.snapshots import latest_delivery, snapshot_neighbours, with_neighbours

#: Mean rows of a chunk: a key begins a chunk if its hash is divisible by this.
MEAN_CHUNK = 8
#: Consecutive sequence numbers of a session that share a task.
BLOCK_BITS = 10


def _begins_chunk(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MEAN_CHUNK)) == 0


def snapshot_changes(
    rows: DataFrame,
    snapshots: DataFrame,
    *,
    series: list[str],
    seq: str,
    session: str,
    key: str,
    loaded: str,
    digest: Column,
) -> DataFrame:
    """Rows added, removed or changed between each delivered snapshot and the one before.

    ``series`` are the columns that name one table's sequence of snapshots (they
    include ``session``), ``key`` names a row in a snapshot and ``digest`` is its
    compared content.  ``snapshots`` (``session``, ``seq``, repeats allowed) lists what
    was delivered, so that a snapshot without rows still removes those before it.
    Result: ``series``, ``seq`` (the later snapshot), ``key`` and ``change_kind``.

    A snapshot sorted by key is cut where a key's hash says so, hence equal stretches
    of two snapshots give equal chunks wherever they lie.  Chunks whose begin and
    digest recur in the neighbouring snapshot hold the same rows and are discarded; the
    rows left over are joined on their key to classify them.

    Rows move twice: to find the valid delivery of a row (combined on the map side), and to bring
    2^10 consecutive snapshots of a session together; chunking, discarding and joining then run
    where the rows are.  A session that holds much of the data is salted by key over as many parts as
    its share asks for, and each part is sorted and cut by itself.  A row whose next snapshot begins
    another block goes to both.

    Defined cases: an empty table or a session with one snapshot gives no rows; rows
    with a null in series, seq or key are dropped; of repeated deliveries the last
    loaded holds; a null digest equals a null digest.
    """
    names = {c: f"__g{i}" for i, c in enumerate(series)}
    group = list(names.values())
    session_col = names[session]
    around, count, _ = snapshot_neighbours(
        snapshots.select(F.col(session).alias(session_col), F.col(seq).alias("__q")), session_col, "__q"
    )
    facts = latest_delivery(
        rows.select(
            *[F.col(c).alias(n) for c, n in names.items()],
            F.col(seq).alias("__q"),
            F.col(key).alias("__k"),
            F.col(loaded).alias("__at"),
            digest.alias("__digest"),
        ),
        [*group, "__q", "__k"],
        "__at",
        "__digest",
    )

    def block(number: str) -> Column:
        return F.shiftright(F.col(number).cast("long"), BLOCK_BITS)

    # A row is the later side of its own snapshot's pair and the earlier side of the next pair.
    homes = F.array_distinct(
        F.array_compact(F.array(F.when(F.col("prev_seq").isNotNull(), block("__q")), block("next_seq")))
    )
    home = [session_col, "__part", "__block"]
    sessions = rows.select(F.col(session).alias(session_col))
    placed = (
        with_salt(with_neighbours(facts, around, count, [session_col, "__q"]), sessions, session_col, ["__k"], "__part")
        .select("*", F.explode(homes).alias("__block"))
        .repartition(*home)
    )
    snapshot = [*dict.fromkeys([*home, *group]), "__q"]
    begin = F.last(F.when(_begins_chunk(F.col("__k")), F.col("__k")), ignorenulls=True).over(
        Window.partitionBy(*snapshot).orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    chunks = (
        placed.withColumn("__begin", F.coalesce(begin, F.lit("")))
        .groupBy(*snapshot, "prev_seq", "next_seq", "__begin")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.bit_xor(F.xxhash64("__k", "__digest")).alias("__sum"),
            F.bit_xor(F.xxhash64("__digest", "__k", F.lit(1))).alias("__sum2"),
            F.collect_list(F.struct("__k", "__digest")).alias("__rows"),
        )
    )
    pair = [*dict.fromkeys([*home, *group]), "__pair"]
    later = F.when(F.col("prev_seq").isNotNull() & (block("__q") == F.col("__block")), F.col("__q"))
    earlier = F.when(block("next_seq") == F.col("__block"), F.col("next_seq"))
    unmatched = (
        chunks.select(
            *snapshot,
            "__begin",
            "__n",
            "__sum",
            "__sum2",
            "__rows",
            F.posexplode(F.array(later, earlier)).alias("__earlier", "__pair"),
        )
        .where(F.col("__pair").isNotNull())
        .groupBy(*pair, "__begin", "__n", "__sum", "__sum2")
        .agg(
            F.count(F.lit(1)).alias("__copies"),
            F.first("__earlier").alias("__earlier"),
            F.first("__rows").alias("__rows"),
        )
        .where(F.col("__copies") == 1)
        .select(*pair, "__earlier", F.inline("__rows"))
    )
    is_new = F.col("__earlier") == 0
    joined = unmatched.groupBy(*pair, "__k").agg(
        F.max(F.when(is_new, F.lit(True))).alias("__in_new"),
        F.max(F.when(~is_new, F.lit(True))).alias("__in_old"),
        F.max(F.when(is_new, F.col("__digest"))).alias("__new"),
        F.max(F.when(~is_new, F.col("__digest"))).alias("__old"),
    )
    change = (
        F.when(F.col("__in_old").isNull(), "added")
        .when(F.col("__in_new").isNull(), "removed")
        .when(~F.col("__new").eqNullSafe(F.col("__old")), "changed")
    )
    return (
        joined.withColumn("__change", change)
        .where(F.col("__change").isNotNull())
        .select(
            *[F.col(n).alias(c) for c, n in names.items()],
            F.col("__pair").alias(seq),
            F.col("__k").alias(key),
            F.col("__change").alias("change_kind"),
        )
    )
