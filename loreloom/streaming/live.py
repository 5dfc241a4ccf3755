"""The stream form of the event fold: custom keyed state on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_PHASES = {"phase_start": "active", "phase_done": "done", "phase_error": "error", "phase_skip": "done"}
#: How long the state of a session is kept after its last event; of one that ended, in milliseconds.
IDLE_MS, ENDED_MS = 24 * 3_600_000, 600_000


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expire: bool = True) -> Iterator[pd.DataFrame]:
    """State of a session: running, and each phase's state; a session start resets it.

    Of every phase, of the last start and of the last start or end the greatest ``seq`` is kept, so the
    result does not depend on how events are spread over frames and batches.
    """
    columns = ["session", "running", "n_active", "n_done", "n_error"]
    if expire and state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({c: [] for c in columns})
        return
    started, turned, running, phases, seqs, states = state.get if state.exists else (-1, -1, False, [], [], [])
    known = {p: (q, s) for p, q, s in zip(phases, seqs, states, strict=True)}
    for frame in frames:
        for kind, phase, seq in zip(frame["type"], frame["phase"], frame["seq"], strict=True):
            if kind in ("session_start", "session_end") and seq > turned:
                turned, running = int(seq), kind == "session_start"
            if kind == "session_start":
                started = max(started, int(seq))
            elif kind in _PHASES and seq > known.get(phase, (-1, ""))[0]:
                known[phase] = (int(seq), _PHASES[kind])
    known = {p: (q, s) for p, (q, s) in known.items() if q > started}
    state.update((started, turned, running, list(known), [q for q, _ in known.values()], [s for _, s in known.values()]))
    if expire:
        state.setTimeoutDuration(ENDED_MS if turned >= 0 and not running else IDLE_MS)
    counts = {s: sum(v == s for _, v in known.values()) for s in ("active", "done", "error")}
    yield pd.DataFrame([(key[0], running, counts["active"], counts["done"], counts["error"])], columns=columns)


def live_session_states(events: DataFrame, *, expire: bool = True) -> DataFrame:
    """Streaming twin of ``session_states``: an updated row for each session of a batch.

    ``events`` is a stream with ``session`` (bigint), ``seq``, ``type``, ``phase`` (string); late events count
    by their ``seq``.  The state of a session is dropped a day after its last event, of one that ended
    after ten minutes.  Without ``expire`` it is kept: a run over what is available now must end, and a stream
    with timeouts goes on to wait for them.
    """
    return events.groupBy("session").applyInPandasWithState(
        partial(_fold, expire=expire),
        outputStructType="session bigint, running boolean, n_active bigint, n_done bigint, n_error bigint",
        stateStructType="started bigint, turned bigint, running boolean, phases array<string>, seqs array<bigint>, states array<string>",
        outputMode="update",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout,
    )


class Subscription:
    """A started stream over new events: ``stop`` ends it, ``stop_if_idle`` after ``idle_s`` seconds without any."""

    def __init__(self, query: StreamingQuery, idle_s: float = 30.0) -> None:
        self.query, self.idle_s = query, idle_s
        self._seen, self._at = -1, time.monotonic()

    def stop_if_idle(self) -> bool:
        """Whether the stream is stopped now; call it from time to time."""
        progress = self.query.lastProgress
        rows = -1 if progress is None else progress["batchId"] if progress["numInputRows"] else self._seen
        if rows != self._seen:
            self._seen, self._at = rows, time.monotonic()
        if self.query.isActive and time.monotonic() - self._at >= self.idle_s:
            self.query.stop()
        return not self.query.isActive

    def stop(self) -> None:
        self.query.stop()


def subscribe(rows: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, idle_s: float = 30.0) -> Subscription:
    """Hand each micro-batch of ``rows`` to ``deliver``: first what is there, then what comes."""
    query = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(deliver).start()
    return Subscription(query, idle_s)


def run_available(spark: SparkSession, rows: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available now, each batch appended to ``target``; the rows written.

    A batch is written under its number, so a batch that is repeated after a failure
    replaces what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        rows.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(target)
