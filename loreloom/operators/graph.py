"""The relationship graph: edges, importance, overrides and closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.session import cut_lineage

#: Importance from which a relationship is followed.
IMPORTANT = 75


def latest_entries(states: DataFrame, columns: list[str], snapshots: DataFrame | None = None) -> DataFrame:
    """Entries of each session's last snapshot, each as last delivered.

    ``snapshots`` (``session_id``, ``snapshot_seq``) lists what was delivered in any table, so that an
    empty last part of a snapshot has no entries; by default these are the snapshots of ``states``.
    Rows without session, number or key are dropped; the last number is an aggregate
    joined back, so no session is sorted.
    """
    known = states.where(
        F.col("session_id").isNotNull() & F.col("snapshot_seq").isNotNull() & F.col("entry_key").isNotNull()
    )
    delivered = known if snapshots is None else snapshots
    last = delivered.groupBy("session_id").agg(F.max("snapshot_seq").alias("snapshot_seq"))
    rows = known.join(last, ["session_id", "snapshot_seq"])
    newest = F.max_by(F.struct(*columns), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")))
    return rows.groupBy("session_id", "entry_key").agg(newest.alias("__row")).select("session_id", "entry_key", "__row.*")


def relationship_edges(entries: DataFrame) -> DataFrame:
    """One row for each relationship: ``session_id``, ``src``, ``dst``, ``ord``, ``relation``, ``importance``."""
    targets = entries.select("session_id", F.col("entry_key").alias("src"), F.explode("relationships").alias("dst", "__all"))
    return targets.select("session_id", "src", "dst", F.posexplode("__all").alias("ord", "__r")).select(
        "session_id", "src", "dst", "ord", F.col("__r.relation").alias("relation"), F.col("__r.importance").alias("importance")
    )


def is_important(importance: Column, threshold: int = IMPORTANT) -> Column:
    """A missing importance counts as 0."""
    return F.coalesce(importance, F.lit(0)) >= threshold


def overridden_edges(edges: DataFrame, threshold: int = IMPORTANT) -> DataFrame:
    """Where a pair has an important relationship its others are dropped; other pairs keep all."""
    pair = Window.partitionBy("session_id", "src", "dst")
    any_important = F.max(is_important(F.col("importance"), threshold).cast("int")).over(pair) == 1
    kept = edges.withColumn("__any", any_important)
    return kept.where(~F.col("__any") | is_important(F.col("importance"), threshold)).drop("__any")


def edges_within(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Edges between two different people of a scene: ``people`` has ``session_id``, ``name``."""
    present = people.select("session_id", "name").distinct()
    return (
        edges.where(F.col("src") != F.col("dst"))
        .join(present.withColumnRenamed("name", "src"), ["session_id", "src"], "left_semi")
        .join(present.withColumnRenamed("name", "dst"), ["session_id", "dst"], "left_semi")
    )


def closure(seeds: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """All nodes that ``seeds`` (``group``, ``node``) reach over ``edges`` (``group``, ``src``, ``dst``).

    A fix-point loop: each round follows the edges of the newest nodes and drops those
    already reached; it ends when a round finds none, so cycles end too.  Each round's new nodes are
    materialised once in the reliable checkpoint folder; the driver sees only whether there were any.
    Result: ``group``, ``node``, ``depth`` (steps from the nearest seed).
    """
    steps = cut_lineage(edges.select(group, "src", "dst").distinct())
    frontiers = [cut_lineage(seeds.select(group, "node").distinct().withColumn("depth", F.lit(0)))]
    while True:
        reached = reduce(DataFrame.unionByName, frontiers)
        found = (
            frontiers[-1]
            .select(group, F.col("node").alias("src"))
            .join(steps, [group, "src"])
            .select(group, F.col("dst").alias("node"))
            .distinct()
            .join(reached, [group, "node"], "left_anti")
            .withColumn("depth", F.lit(len(frontiers)))
        )
        newest = cut_lineage(found)
        if newest.isEmpty():
            return reached
        frontiers.append(newest)


def pair_edges(edges: DataFrame, pairs: DataFrame, threshold: int = 0) -> DataFrame:
    """Edges of the asked ``pairs`` (``session_id``, ``src``, ``dst``) of at least ``threshold``; both directions are two pairs."""
    return edges.join(pairs.distinct(), ["session_id", "src", "dst"], "left_semi").where(is_important(F.col("importance"), threshold))
