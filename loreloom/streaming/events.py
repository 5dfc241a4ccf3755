"""Status events: the state that they fold to, progress, throttling; batch form.

Events: ``session``, ``seq``, ``type`` (session_start, phase_start, phase_done,
phase_error, session_end) and ``phase``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.operators.running import running_sum

#: Events that a publisher keeps for late subscribers.
BUFFER = 20_000


def with_epoch(events: DataFrame) -> DataFrame:
    """``epoch``: how many session starts came so far; a start opens a new epoch."""
    return running_sum(events, ["session"], F.col("seq"), F.when(F.col("type") == "session_start", 1).otherwise(0), "epoch")


def since_last_start(events: DataFrame) -> DataFrame:
    """Events of each session from its last start on, all of a session without one.

    The last start is an aggregate joined back: no session is sorted.
    """
    last = events.groupBy("session").agg(
        F.coalesce(F.max(F.when(F.col("type") == "session_start", F.col("seq"))), F.min("seq")).alias("__from")
    )
    return events.join(last, "session").where(F.col("seq") >= F.col("__from")).drop("__from")


def phase_states(events: DataFrame) -> DataFrame:
    """State of each phase after the last start: its last event decides; a skipped or
    failed phase is over too."""
    phases = since_last_start(events).where(F.col("type").isin("phase_start", "phase_done", "phase_error", "phase_skip"))
    last = phases.groupBy("session", "phase").agg(F.max_by("type", "seq").alias("last"), F.count(F.lit(1)).alias("n_events"))
    state = F.when(F.col("last") == "phase_start", "active").when(F.col("last") == "phase_error", "error").otherwise("done")
    return last.select("session", "phase", state.alias("state"), "n_events")


def session_states(events: DataFrame) -> DataFrame:
    """One row for each session: is it running, and how many phases are active, done, failed."""
    recent = since_last_start(events)
    running = recent.where(F.col("type").isin("session_start", "session_end")).groupBy("session").agg(
        (F.max_by("type", "seq") == "session_start").alias("running")
    )
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    phases = phase_states(events).groupBy("session").agg(count("active"), count("done"), count("error"))
    joined = recent.select("session").distinct().join(running, "session", "left").join(phases, "session", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("session", F.coalesce("running", F.lit(False)).alias("running"), zero("n_active"), zero("n_done"), zero("n_error"))


def weighted_progress(states: DataFrame, weights: DataFrame) -> DataFrame:
    """Percent done by weight, one decimal; 0 where nothing has weight.  ``weights``: ``phase``, ``weight``."""
    joined = states.join(weights, "phase", "left").withColumn("__w", F.coalesce("weight", F.lit(1)))
    over = F.sum(F.when(F.col("state") != "active", F.col("__w")).otherwise(0))
    whole = F.sum("__w")
    percent = F.when(whole > 0, F.round(100 * over / whole, 1)).otherwise(F.lit(0.0))
    return joined.groupBy("session").agg(
        F.count_if(F.col("state") != "active").alias("completed"), F.count(F.lit(1)).alias("total"), percent.cast("double").alias("percent")
    )


def client_percent(completed: Column, queued: Column) -> Column:
    whole = completed + queued
    return F.when(whole > 0, F.floor(completed * 100 / whole)).otherwise(F.lit(0)).cast("int")


def pending_phases(planned: DataFrame, states: DataFrame) -> DataFrame:
    """Planned phases of each session that have no state yet."""
    return planned.join(states.select("session", "phase"), ["session", "phase"], "left_anti")


def ring_buffer(events: DataFrame, most: int = BUFFER) -> DataFrame:
    """The last ``most`` events of the log: a top-k, of which each task hands on at most ``most``."""
    return events.orderBy(F.desc("seq")).limit(most)


def replay(events: DataFrame, after: Column) -> DataFrame:
    """Events after a number that a subscriber has seen, to be read in the order of ``seq``."""
    return events.where(F.col("seq") > after)


def phase_events(planned: DataFrame, reports: DataFrame) -> DataFrame:
    """Lifecycle events of planned phases: a start for each, and its end if it was reported, once.

    ``planned``: ``session``, ``phase``, ``ord``; ``reports``: ``session``, ``phase``, ``at``, ``outcome`` (done,
    error or skip).  The first report of a phase counts, later ones say nothing new; reports of phases that
    were not planned are dropped.
    """
    first = reports.groupBy("session", "phase").agg(F.min_by("outcome", F.struct("at", "outcome")).alias("outcome"))
    joined = planned.join(first, ["session", "phase"], "left")
    ends = F.when(F.col("outcome").isNotNull(), F.concat(F.lit("phase_"), "outcome"))
    listed = F.array_compact(F.array(F.lit("phase_start"), ends))
    return joined.select("session", "phase", F.posexplode(listed).alias("__i", "type"), "ord").select(
        "session", (F.col("ord") * 2 + F.col("__i")).alias("seq"), "type", "phase"
    )


def step_messages(steps: DataFrame) -> DataFrame:
    """A step's messages as a client shows them: ``session``, ``phase``, ``status``, ``messages``, ``warned``.

    Messages follow each other in the order of ``seq``; a warning stays whatever comes later.  The messages of
    one step meet in a row, as they are shown together.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "message")))
    return steps.groupBy("session", "phase").agg(
        F.max_by("status", "seq").alias("status"),
        F.array_join(F.transform(ordered, lambda x: x["message"]), "\n").alias("messages"),
        F.bool_or(F.col("status") == "warning").alias("warned"),
    )


def is_top_level(phase: Column) -> Column:
    """A phase is of the top level if its id names nothing below another."""
    return ~F.rlike(phase, F.lit(r"[.\[]"))


def nearest_ancestors(phases: DataFrame, known: DataFrame, group: list[str]) -> DataFrame:
    """For each phase id the longest known one above it (cut at dots and brackets), null if there is none."""
    cuts = F.regexp_extract_all("phase", F.lit(r"[.\[]?[^.\[]+"), F.lit(0))
    above = F.transform(F.sequence(F.lit(1), F.size("__cuts") - 1), lambda n: F.array_join(F.slice("__cuts", F.lit(1), n), ""))
    ids = phases.select(*group, "phase").distinct().withColumn("__cuts", cuts)
    listed = ids.where(F.size("__cuts") > 1).select(*group, "phase", F.explode(above).alias("ancestor"))
    met = listed.join(known.select(*group, F.col("phase").alias("ancestor")).distinct(), [*group, "ancestor"], "left_semi")
    best = met.groupBy(*group, "phase").agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return ids.select(*group, "phase").join(best, [*group, "phase"], "left")


def latest_of(events: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The latest row of each key, by an aggregate that combines before the shuffle."""
    newest = F.max(F.struct(order, *columns)).alias("__r")
    return events.groupBy(*key).agg(newest).select(*key, "__r.*")


def throttled(chunks: DataFrame, key: str, order: str, size: Column, at: Column, least_size: int, least_gap: float) -> DataFrame:
    """Emissions of each key: a chunk is let out when ``least_size`` characters and
    ``least_gap`` seconds have come together since the last one, the first at once.

    The rule is sequential within a key, so keys are sorted within partitions and folded
    row by row as they stream by; nothing is collected, whatever a key's length.  Keys
    and orders are integers; rows with a null in any part are left out.
    """
    rows = chunks.select(
        F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), size.cast("double").alias("n"), at.cast("double").alias("t")
    ).dropna()

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, waiting = None, 0.0, 0.0
        for frame in frames:
            out = []
            for k, o, n, t in frame.itertuples(index=False):
                fresh = k != current
                waiting = n if fresh else waiting + n
                if fresh or (waiting >= least_size and t - last >= least_gap):
                    out.append((k, o))
                    last, waiting = t, 0.0
                current = k
            yield pd.DataFrame(out, columns=[key, order])

    return rows.repartition("k").sortWithinPartitions("k", "o").mapInPandas(fold, f"{key} bigint, {order} bigint")
