"""Decisions and state of incremental maintenance: triggers, gates, attempts, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.running import running_sum

#: Scenes of a chapter and chapters of an arc: from which to ask, and from which to close at any rate.
CHAPTER_BOUNDS, ARC_BOUNDS = (4, 10), (3, 12)


#: Stop reasons that mean nothing has to change.
_UNCHANGED = ("NO", "UNCHANGED")


def gate_rejects(answer: Column, stop: Column | None = None) -> Column:
    """A gate rejects on a stop reason of NO or UNCHANGED, and on an answer that begins with NO or contains UNCHANGED."""
    said = F.upper(F.trim(answer))
    stopped = F.lit(False) if stop is None else F.coalesce(F.upper(F.trim(stop)).isin(*_UNCHANGED), F.lit(False))
    return stopped | F.coalesce(F.startswith(said, F.lit("NO")) | F.contains(said, F.lit("UNCHANGED")), F.lit(False))


def query_rejects(answer: Column, stop: Column | None = None) -> Column:
    """A branch query rejects on the same stop reasons, and only on NO or UNCHANGED alone."""
    stopped = F.lit(False) if stop is None else F.coalesce(F.upper(F.trim(stop)).isin(*_UNCHANGED), F.lit(False))
    return stopped | F.coalesce(F.upper(F.trim(answer)).isin(*_UNCHANGED), F.lit(False))


def closes(answer: Column, stop: Column, count: Column, bounds: tuple[int, int]) -> Column:
    """Whether a chapter or arc is closed: not below the least size; then on YES or at the greatest."""
    least, most = bounds
    yes = F.contains(F.upper(answer), F.lit("YES")) | F.contains(F.coalesce(F.upper(stop), F.lit("")), F.lit("YES"))
    return (count >= least) & (yes | (count >= most))


def scene_changes(answer: Column) -> Column:
    """Whether the answer reports a scene transition; an ambiguous or missing one does not."""
    return F.coalesce(F.contains(F.upper(F.trim(answer)), F.lit("YES_SCENE_TRANSITION")), F.lit(False))


def active_triggers(flags: DataFrame, triggers: DataFrame) -> DataFrame:
    """Actions due in each turn: ALWAYS and one of new or existing scene, in their order.

    ``flags``: a row for each turn with ``is_new_scene``; ``triggers``: ``trigger``,
    ``node``, ``action_ord``, ``action``, ``condition`` (null or ``gate_check_fail``).
    """
    due = F.array(F.lit("always"), F.when(F.col("is_new_scene"), F.lit("on_new_scene")).otherwise(F.lit("on_existing_scene")))
    return flags.withColumn("trigger", F.explode(due)).join(triggers, "trigger")


def run_actions(actions: DataFrame, turn: list[str], gate_failed: Column) -> DataFrame:
    """Actions that run: after a failed gate of a node only those that wait for it, and
    nothing of the nodes below it.

    ``actions`` has ``node`` (a path joined by dots), ``action_ord``, ``action`` and
    ``condition``.  A failed gate prunes by prefix, in a join on the turn.
    """
    gates = actions.where((F.col("action") == "gate_check") & gate_failed).select(
        *turn, F.col("node").alias("__failed"), F.col("action_ord").alias("__at")
    ).distinct()
    inside = F.startswith(actions["node"], F.concat(gates["__failed"], F.lit(".")))
    after = (actions["node"] == gates["__failed"]) & (actions["action_ord"] > gates["__at"])
    waits = F.coalesce(actions["condition"] == "gate_check_fail", F.lit(False))
    same = [actions[t] == gates[t] for t in turn]
    pruned = actions.join(gates, [*same, inside | (after & ~waits)], "left_anti")
    plain = pruned.where(F.col("condition").isNull())
    waiting = pruned.where(F.col("condition") == "gate_check_fail").alias("w")
    g = gates.alias("g")
    fired = waiting.join(
        g, [*[F.col(f"w.{t}") == F.col(f"g.{t}") for t in turn], F.col("w.node") == F.col("g.__failed")], "left_semi"
    )
    return plain.unionByName(fired.select(*plain.columns))


def first_valid(attempts: DataFrame, key: list[str], attempt: str, value: str, valid: Column) -> DataFrame:
    """The first valid attempt of each key, or nothing if there is none; and how many were made."""
    order = F.when(valid, F.col(attempt))
    best = F.min(F.when(order.isNotNull(), F.struct(attempt, value)))
    return attempts.groupBy(*key).agg(best.alias("__b"), F.count(F.lit(1)).alias("n_attempts")).select(
        *key, F.col(f"__b.{attempt}").alias("attempt"), F.col(f"__b.{value}").alias("value"), "n_attempts"
    )


def effective(*settings: Column) -> Column:
    """The first setting that is given; an empty text counts as none."""
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in settings])


def rollup_counts(scenes: DataFrame, group: list[str], order: str, per_chapter: int, per_arc: int) -> DataFrame:
    """Scenes into chapters of ``per_chapter`` and arcs of ``per_arc`` chapters, by order."""
    chapter = F.floor((F.col("__n") - 1) / per_chapter)
    return running_sum(scenes, group, F.col(order), F.lit(1), "__n").select(
        *group,
        order,
        F.col("__n").cast("int").alias("scene_number"),
        (chapter + 1).cast("int").alias("chapter_number"),
        (F.floor(chapter / per_arc) + 1).cast("int").alias("arc_number"),
    )


def relative_count(total: Column, last_end: Column) -> Column:
    """Scenes since the last closed chapter, at least 1."""
    return F.greatest(F.lit(1), total - F.coalesce(last_end, F.lit(0)))


def chained_hash(items: Column, precision: int = 24) -> Column:
    """Content address of a history: each item hashed with the hash before it; null items count as empty."""
    chain = F.aggregate(items, F.lit(""), lambda h, x: F.sha1(F.concat(h, F.coalesce(x, F.lit("")))))
    return F.left(chain, F.lit(precision))
