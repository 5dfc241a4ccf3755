"""Queries on maintenance, rollups, snapshots, status events and assembled contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.operators.conversation import last_exchanges
from loreloom.operators.graph import closure
from loreloom.operators.maintenance import (
    ARC_BOUNDS,
    CHAPTER_BOUNDS,
    active_triggers,
    chained_hash,
    closes,
    effective,
    first_valid,
    gate_rejects,
    query_rejects,
    relative_count,
    rollup_counts,
    run_actions,
    scene_changes,
)
from loreloom.plans.conversation import CONV, conversations
from loreloom.plans.registry import Catalogue
from loreloom.plans.upkeep import latest
from loreloom.schema.story import STORY, field_table
from loreloom.session import scratch_path
from loreloom.sources.tables import table
from loreloom.streaming.events import (
    client_percent,
    is_top_level,
    latest_of,
    nearest_ancestors,
    pending_phases,
    phase_events,
    phase_states,
    replay,
    ring_buffer,
    session_states,
    since_last_start,
    step_messages,
    throttled,
    weighted_progress,
    with_epoch,
)
from loreloom.streaming.live import live_session_states, run_available

catalogue = Catalogue()

#: How the driver's event types stand in for lifecycle events.
_TYPES = {"signup": "session_start", "view": "phase_start", "click": "phase_done", "error": "phase_error", "purchase": "session_end"}


def _lifecycle(events: DataFrame) -> DataFrame:
    kind = F.lit(None).cast("string")
    for raw, name in _TYPES.items():
        kind = F.when(F.col("event_type") == raw, name).otherwise(kind)
    phase = F.concat(F.lit("phase_"), F.get_json_object("props", "$.k"))
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), phase.alias("phase"), "value"
    )


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    return _lifecycle(table(spark, sf, "events"))


_CASE = "CASE event_type " + " ".join(f"WHEN '{r}' THEN '{n}'" for r, n in _TYPES.items()) + " END"
_STATUS = f"""status AS (SELECT user_id AS session, event_id AS seq, ts, {_CASE} AS type,
  'phase_' || json_extract_string(props, '$.k') AS phase, value FROM events),
recent AS (SELECT s.* FROM status s JOIN (
  SELECT session, coalesce(max(seq) FILTER (type = 'session_start'), min(seq)) AS lo FROM status GROUP BY session) m
  ON s.session = m.session AND s.seq >= m.lo),
phases AS (SELECT session, phase, CASE arg_max(type, seq) WHEN 'phase_start' THEN 'active' WHEN 'phase_error' THEN 'error' ELSE 'done' END AS state,
  count(*) AS n_events FROM recent WHERE type IN ('phase_start', 'phase_done', 'phase_error') GROUP BY ALL)"""

_GATE = {"view": "NO", "click": " unchanged ", "error": "No, not yet", "purchase": "The mood is UNCHANGED here", "signup": "YES"}


def _answer(mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for kind, text in mapping.items():
        out = F.when(F.col("event_type") == kind, text).otherwise(out)
    return out


@catalogue.add(
    sql="""SELECT event_id, event_type IN ('view', 'click', 'error', 'purchase') OR event_id % 7 = 0 AS gate_rejects,
          event_type IN ('view', 'click') OR event_id % 7 = 0 AS query_rejects, event_type = 'signup' AND value > 50 AS scene_changes FROM events"""
)
def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    answer = _answer(_GATE)
    stop = F.when(F.col("event_id") % 14 == 0, " no ").when(F.col("event_id") % 14 == 7, "UNCHANGED").otherwise("length")
    scene = F.when((F.col("event_type") == "signup") & (F.col("value") > 50), F.lit(" yes_scene_transition. "))
    return table(spark, sf, "events").select(
        "event_id",
        gate_rejects(answer, stop).alias("gate_rejects"),
        query_rejects(answer, stop).alias("query_rejects"),
        scene_changes(scene).alias("scene_changes"),
    )


@catalogue.add(
    sql="""SELECT user_id, n, n >= 4 AND (yes OR n >= 10) AS closes_chapter, n >= 3 AND (yes OR n >= 12) AS closes_arc FROM (
          SELECT user_id, (count(*) % 15)::BIGINT AS n, arg_max(event_type, event_id) IN ('signup', 'view') AS yes FROM events GROUP BY user_id)"""
)
def archive_decision(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "events").groupBy("user_id").agg(
        (F.count(F.lit(1)) % 15).alias("n"), F.max_by("event_type", "event_id").alias("event_type")
    )
    answer = _answer({"signup": "yes, close it"})
    stop = _answer({"view": "YES"})
    answer = F.coalesce(answer, F.lit("no"))
    return counted.select(
        "user_id", "n", closes(answer, stop, F.col("n"), CHAPTER_BOUNDS).alias("closes_chapter"), closes(answer, stop, F.col("n"), ARC_BOUNDS).alias("closes_arc")
    )


_TRIGGERS = (
    ("always", "character", 0, "gate_check", None),
    ("always", "character", 1, "update", None),
    ("always", "character", 2, "notify", "gate_check_fail"),
    ("always", "character.traits", 0, "update", None),
    ("on_new_scene", "scene", 0, "add_new", None),
    ("on_existing_scene", "scene", 0, "update", None),
)


@catalogue.add(
    sql=f"""WITH {CONV}, triggers(trigger, node, action_ord, action, condition) AS (VALUES
          {", ".join(str(t).replace("None", "NULL") for t in _TRIGGERS)}),
        turns AS (SELECT conv_id, message_idx, length(text) > 300 AS is_new_scene, length(text) % 2 = 0 AS fails FROM conv),
        due AS (SELECT t.*, g.* FROM turns t JOIN triggers g ON g.trigger = 'always' OR g.trigger = CASE WHEN is_new_scene THEN 'on_new_scene' ELSE 'on_existing_scene' END)
        SELECT conv_id, message_idx, node, action_ord, action FROM due WHERE CASE
          WHEN node = 'character' AND action = 'update' THEN NOT fails WHEN condition IS NOT NULL THEN fails
          WHEN node = 'character.traits' THEN NOT fails ELSE true END"""
)
def triggered_actions(spark: SparkSession, sf: str) -> DataFrame:
    triggers = spark.createDataFrame(_TRIGGERS, "trigger string, node string, action_ord int, action string, condition string")
    flags = conversations(spark, sf).select(
        "conv_id", "message_idx", (F.length("text") > 300).alias("is_new_scene"), (F.length("text") % 2 == 0).alias("fails")
    )
    due = active_triggers(flags, triggers)
    return run_actions(due, ["conv_id", "message_idx"], F.col("fails")).select("conv_id", "message_idx", "node", "action_ord", "action")


@catalogue.add(
    sql="""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE NULL END, ''),
          CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS setting
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def effective_setting(spark: SparkSession, sf: str) -> DataFrame:
    rows = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    own = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment"))
    blank = F.when(F.col("c_custkey") % 3 == 0, F.lit(""))
    parent = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return rows.select("c_custkey", effective(own, blank, parent, F.col("r_name")).alias("setting"))


@catalogue.add(
    sql="""SELECT user_id, min(event_id) FILTER (event_type = 'purchase' AND value > 20) AS attempt,
          arg_min(value, event_id) FILTER (event_type = 'purchase' AND value > 20) AS value, count(*) AS n_attempts FROM events GROUP BY user_id"""
)
def first_valid_attempt(spark: SparkSession, sf: str) -> DataFrame:
    valid = (F.col("event_type") == "purchase") & (F.col("value") > 20)
    return first_valid(table(spark, sf, "events"), ["user_id"], "event_id", "value", valid)


@catalogue.add(
    sql="""SELECT session, seq, n + 1 AS scene_number, n // 4 + 1 AS chapter_number, n // 12 + 1 AS arc_number FROM (
          SELECT user_id AS session, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS n FROM events)"""
)
def rollup_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    return rollup_counts(events, ["session"], "seq", 4, 3)


@catalogue.add(
    sql="""SELECT o_custkey, count(*) AS total, greatest(1, count(*) - coalesce(max(o_orderkey % 7) FILTER (o_orderstatus = 'F'), 0)) AS since_last FROM orders GROUP BY 1"""
)
def relative_counts(spark: SparkSession, sf: str) -> DataFrame:
    ended = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 7))
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), ended.alias("ended"))
    return counted.select("o_custkey", "total", relative_count(F.col("total"), F.col("ended")).alias("since_last"))


@catalogue.add(
    sql="""SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY ROLLUP (o_orderstatus)"""
)
def arcs_by_status(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "orders").rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))
    return grouped.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n", "first_order")


@catalogue.add(sql="SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def last_entry(spark: SparkSession, sf: str) -> DataFrame:
    return latest_of(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@catalogue.add(
    sql="""SELECT DISTINCT context_id, left(list_reduce(list_prepend('', list_transform(messages, lambda m: coalesce(m, ''))), lambda h, x: sha1(h || x)), 24) AS snapshot_id
        FROM retrieval_contexts WHERE messages IS NOT NULL"""
)
def snapshot_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "retrieval_contexts").where(F.col("messages").isNotNull())
    return rows.select("context_id", chained_hash(F.col("messages")).alias("snapshot_id")).distinct()


@catalogue.add(
    sql="""SELECT world_hash, count(DISTINCT session_id) AS n_sessions, left(sha1(min(card) || '|' || world_hash), 24) AS cache_id,
          arg_min(session_id, (started_at, session_id)) AS seed_session FROM sessions WHERE world_hash IS NOT NULL GROUP BY 1"""
)
def world_cache(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "sessions").where(F.col("world_hash").isNotNull())
    seed = F.min_by("session_id", F.struct("started_at", "session_id"))
    return rows.groupBy("world_hash").agg(
        F.count_distinct("session_id").alias("n_sessions"),
        F.left(F.sha1(F.concat(F.min("card"), F.lit("|"), F.first("world_hash"))), F.lit(24)).alias("cache_id"),
        seed.alias("seed_session"),
    )


@catalogue.add(
    sql="""SELECT session_id, array_to_string(list_sort(list(need)), ',') AS missing FROM (
          SELECT DISTINCT session_id, need FROM sessions, (VALUES ('current_scene'), ('characters'), ('events')) v(need)
          WHERE NOT EXISTS (SELECT 1 FROM kb_records k WHERE k.session_id = sessions.session_id AND k.subject = v.need)) GROUP BY 1"""
)
def missing_subjects(spark: SparkSession, sf: str) -> DataFrame:
    needed = F.array(*[F.lit(s) for s in ("current_scene", "characters", "events")])
    wanted = table(spark, sf, "sessions").select("session_id").distinct().select("session_id", F.explode(needed).alias("subject"))
    there = table(spark, sf, "kb_records").select("session_id", "subject")
    gaps = wanted.join(there, ["session_id", "subject"], "left_anti")
    return gaps.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("missing"))


@catalogue.add(
    sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN d || 'T' || c WHEN o_orderkey % 3 = 1 THEN d ELSE 'now' END AS stamp FROM (
          SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS c FROM orders)"""
)
def scene_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    date = F.when(third != 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit(""))
    clock = F.when(third == 0, F.col("o_orderpriority")).otherwise(F.lit(""))
    whole = F.concat(F.nullif(date, F.lit("")), F.lit("T"), F.nullif(clock, F.lit("")))
    return table(spark, sf, "orders").select("o_orderkey", effective(whole, date, F.lit("now")).alias("stamp"))


@catalogue.add(sql=f"WITH {_STATUS} SELECT * FROM phases")
def event_fold_phases(spark: SparkSession, sf: str) -> DataFrame:
    return phase_states(status_events(spark, sf))


_SESSION_STATE = f"""WITH {_STATUS}, run AS (SELECT session, arg_max(type, seq) = 'session_start' AS running FROM recent WHERE type IN ('session_start', 'session_end') GROUP BY 1),
  agg AS (SELECT session, count(*) FILTER (state = 'active') AS n_active, count(*) FILTER (state = 'done') AS n_done, count(*) FILTER (state = 'error') AS n_error FROM phases GROUP BY 1)
  SELECT session, coalesce(running, false) AS running, coalesce(n_active, 0) AS n_active, coalesce(n_done, 0) AS n_done, coalesce(n_error, 0) AS n_error
  FROM (SELECT DISTINCT session FROM recent) LEFT JOIN run USING (session) LEFT JOIN agg USING (session)"""


@catalogue.add(sql=_SESSION_STATE)
def event_fold_state(spark: SparkSession, sf: str) -> DataFrame:
    return session_states(status_events(spark, sf))


@catalogue.add(sql=_SESSION_STATE)
def stream_fold_state(spark: SparkSession, sf: str) -> DataFrame:
    """The same state as ``event_fold_state``, folded by a stream over the events' files."""
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A bracket makes a pattern of the path, which a stream reads whether it is one file or a folder; it fits no other.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/[e]vents.parquet")
    states = live_session_states(_lifecycle(stream).select("session", "seq", "type", "phase"), expire=False)
    written = run_available(spark, states, scratch_path(spark, "states"), scratch_path(spark, "progress"))
    return latest_of(written, ["session"], "batch", ["running", "n_active", "n_done", "n_error"]).drop("batch")


@catalogue.add(
    sql=f"""WITH {_STATUS} SELECT session, count(*) FILTER (state <> 'active') AS completed, count(*) AS total,
          round(100.0 * sum(CASE WHEN state <> 'active' THEN w ELSE 0 END) / sum(w), 1)::DOUBLE AS percent
        FROM (SELECT *, substr(phase, 7)::INT % 5 + 1 AS w FROM phases) GROUP BY 1"""
)
def progress_weighted(spark: SparkSession, sf: str) -> DataFrame:
    states = phase_states(status_events(spark, sf))
    weights = states.select("phase").distinct().withColumn("weight", F.substring("phase", 7, 9).cast("int") % 5 + 1)
    return weighted_progress(states, weights)


@catalogue.add(
    sql=f"""WITH {_STATUS} SELECT session, (CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (state = 'done') * 100 / count(*)) ELSE 0 END)::INT AS percent FROM phases GROUP BY 1"""
)
def client_progress(spark: SparkSession, sf: str) -> DataFrame:
    states = phase_states(status_events(spark, sf)).groupBy("session").agg(
        F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") != "done").alias("queued")
    )
    return states.select("session", client_percent(F.col("done"), F.col("queued")).alias("percent"))


@catalogue.add(
    sql=f"""WITH {_STATUS} SELECT DISTINCT session, phase FROM status s WHERE type IN ('phase_start', 'phase_done', 'phase_error')
        AND NOT EXISTS (SELECT 1 FROM phases p WHERE p.session = s.session AND p.phase = s.phase)"""
)
def pending_queue(spark: SparkSession, sf: str) -> DataFrame:
    events = status_events(spark, sf)
    planned = events.where(F.startswith("type", F.lit("phase_"))).select("session", "phase").distinct()
    return pending_phases(planned, phase_states(events))


@catalogue.add(sql=f"WITH {_STATUS} SELECT session, seq, type, phase FROM status ORDER BY seq DESC LIMIT 20000")
def ring_buffer_events(spark: SparkSession, sf: str) -> DataFrame:
    return ring_buffer(status_events(spark, sf)).select("session", "seq", "type", "phase")


@catalogue.add(
    sql=f"""WITH {_STATUS}, half AS (SELECT session, floor((min(seq) + max(seq)) / 2) AS seen FROM status GROUP BY 1)
        SELECT session, seq, type, phase FROM status JOIN half USING (session) WHERE seq > seen"""
)
def event_replay(spark: SparkSession, sf: str) -> DataFrame:
    """What a subscriber that saw the first half of a session's log is given again."""
    events = status_events(spark, sf)
    seen = events.groupBy("session").agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("seen"))
    return replay(events.join(seen, "session"), F.col("seen")).select("session", "seq", "type", "phase")


@catalogue.add(
    sql=f"""WITH {_STATUS}, planned AS (SELECT session, phase, row_number() OVER (PARTITION BY session ORDER BY phase) AS ord FROM (SELECT DISTINCT session, phase FROM status)),
        ends AS (SELECT session, phase, arg_min(substr(type, 7), (seq, type)) AS outcome FROM status WHERE type IN ('phase_done', 'phase_error') GROUP BY ALL)
        SELECT session, ord * 2 AS seq, 'phase_start' AS type, phase FROM planned
        UNION ALL SELECT session, ord * 2 + 1, 'phase_' || outcome, phase FROM planned JOIN ends USING (session, phase)"""
)
def phase_emitters(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycle events of all phases of a session; an end that is reported again is emitted once."""
    events = status_events(spark, sf)
    order = Window.partitionBy("session").orderBy("phase")
    planned = events.select("session", "phase").distinct().withColumn("ord", F.row_number().over(order))
    ended = events.where(F.col("type").isin("phase_done", "phase_error"))
    reports = ended.select("session", "phase", F.col("seq").alias("at"), F.substring("type", 7, 9).alias("outcome"))
    return phase_events(planned, reports).select("session", F.col("seq").cast("bigint").alias("seq"), "type", "phase")


@catalogue.add(
    sql=f"""WITH {_STATUS}, steps AS (SELECT session, phase, seq, CASE type WHEN 'phase_error' THEN 'warning' ELSE 'active' END AS status, type || ' ' || seq AS message FROM status)
        SELECT session, phase, arg_max(status, seq) AS status, string_agg(message, chr(10) ORDER BY seq) AS messages, bool_or(status = 'warning') AS warned FROM steps GROUP BY ALL"""
)
def client_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps as a client shows them: their messages in order, and whether one of them was a warning."""
    rows = status_events(spark, sf)
    status = F.when(F.col("type") == "phase_error", "warning").otherwise("active")
    return step_messages(rows.select("session", "phase", "seq", status.alias("status"), F.concat_ws(" ", "type", F.col("seq").cast("string")).alias("message")))


@catalogue.add(
    sql="""WITH ids AS (SELECT DISTINCT session_id AS session, 'characters.' || replace(replace(entry_key, '.', ''), '[', '') AS base FROM character_states WHERE session_id IS NOT NULL AND entry_key IS NOT NULL)
        SELECT session, base || '.traits[0]' AS phase, base AS ancestor, false AS top FROM ids UNION SELECT session, base || '[1]', base, false FROM ids
        UNION SELECT session, base, 'characters', false FROM ids UNION SELECT session, 'characters', NULL, true FROM ids"""
)
def phase_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-phases of maintenance with the nearest known phase above them."""
    rows = table(spark, sf, "character_states").where(F.col("session_id").isNotNull() & F.col("entry_key").isNotNull())
    base = F.concat(F.lit("characters."), F.translate("entry_key", ".[", ""))
    ids = rows.select(F.col("session_id").alias("session"), base.alias("base")).distinct()
    asked = F.array(F.lit("characters"), F.col("base"), F.concat("base", F.lit("[1]")), F.concat("base", F.lit(".traits[0]")))
    known = ids.select("session", F.explode(F.array(F.lit("characters"), F.col("base"))).alias("phase"))
    phases = ids.select("session", F.explode(asked).alias("phase"))
    return nearest_ancestors(phases, known, ["session"]).withColumn("top", is_top_level(F.col("phase")))


@catalogue.add(sql=f"WITH {_STATUS} SELECT session, type, max(seq) AS seq, arg_max(phase, seq) AS phase FROM status GROUP BY ALL")
def latest_step(spark: SparkSession, sf: str) -> DataFrame:
    return latest_of(status_events(spark, sf), ["session", "type"], "seq", ["phase"])


@catalogue.add(
    sql=f"""WITH {_STATUS} SELECT session, phase, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM recent GROUP BY ALL"""
)
def elapsed(spark: SparkSession, sf: str) -> DataFrame:
    rows = since_last_start(status_events(spark, sf))
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return rows.groupBy("session", "phase").agg(F.round(span, 3).alias("seconds"))


@catalogue.add(
    sql=f"""WITH {_STATUS} SELECT session, seq, (sum(CASE WHEN type = 'session_start' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS epoch FROM status"""
)
def event_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return with_epoch(status_events(spark, sf)).select("session", "seq", "epoch")


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY message_idx), 0) AS delta FROM conv"""
)
def token_delta(spark: SparkSession, sf: str) -> DataFrame:
    along = Window.partitionBy("conv_id").orderBy("message_idx")
    before = F.coalesce(F.lag(F.length("text")).over(along), F.lit(0))
    return conversations(spark, sf).select("conv_id", "message_idx", (F.length("text") - before).cast("bigint").alias("delta"))


@catalogue.add()
def throttled_emission(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_micros("ts") / 1e6
    return throttled(status_events(spark, sf), "session", "seq", F.col("value"), seconds, 50, 0.3)


_SECTIONS = ("scene", "characters", "groups", "lines")


@catalogue.add(
    sql=f"""WITH {CONV}, ctx AS (SELECT DISTINCT context_id AS conv_id, session_id, context FROM retrieval_contexts WHERE session_id IS NOT NULL),
        latest_c AS (SELECT session_id, entry_key, min(entry_ord) AS ord FROM character_states t JOIN (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m USING (session_id, snapshot_seq) GROUP BY ALL),
        latest_g AS (SELECT session_id, entry_key, min(entry_ord) AS ord FROM group_states t JOIN (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m USING (session_id, snapshot_seq) GROUP BY ALL)
        SELECT conv_id, 0 AS section_ord, 0 AS ord, 'scene' AS section, context AS text FROM ctx WHERE context IS NOT NULL
        UNION ALL SELECT conv_id, 1, ord, 'characters', entry_key FROM ctx JOIN latest_c USING (session_id)
        UNION ALL SELECT conv_id, 2, ord, 'groups', entry_key FROM ctx JOIN latest_g USING (session_id)
        UNION ALL SELECT conv_id, 3, message_idx, 'lines', text FROM (SELECT *, max(exchange_idx) OVER (PARTITION BY conv_id) AS last FROM conv) WHERE exchange_idx > last - 6"""
)
def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    contexts = table(spark, sf, "retrieval_contexts").where(F.col("session_id").isNotNull())
    contexts = contexts.select(F.col("context_id").alias("conv_id"), "session_id", "context").distinct()

    def section(rows: DataFrame, name: str, order: Column, text: Column) -> DataFrame:
        return rows.select("conv_id", F.lit(_SECTIONS.index(name)).alias("section_ord"), order.cast("int").alias("ord"), F.lit(name).alias("section"), text.alias("text"))

    parts = [section(contexts.where(F.col("context").isNotNull()), "scene", F.lit(0), F.col("context"))]
    for name, source in (("characters", "character_states"), ("groups", "group_states")):
        entries = latest(spark, sf, source, ["entry_ord"])
        parts.append(section(contexts.join(entries, "session_id"), name, F.col("entry_ord"), F.col("entry_key")))
    lines = last_exchanges(conversations(spark, sf), 6)
    parts.append(section(lines, "lines", F.col("message_idx"), F.col("text")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


_FIELDS = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in STORY.field_rows())
_REFERENCES = sorted(
    {(d.name, n) for d in STORY.definitions.values() for t in d.fields.values() for n in STORY.definitions if n in str(t).replace("'", " ").split()}
)


@catalogue.add(sql=f"SELECT * FROM (VALUES {_FIELDS}) v(definition, kind, field, type, updatable)")
def schema_fields(spark: SparkSession, sf: str) -> DataFrame:
    return field_table(spark)


@catalogue.add(
    sql=f"""WITH RECURSIVE refs(src, dst) AS (VALUES {", ".join(str(r) for r in _REFERENCES)}),
        seeds(root, node) AS (VALUES ('characters', 'Character'), ('groups', 'Group'), ('current_scene', 'Scene'), ('events', 'Story')),
        reached AS (SELECT root, node FROM seeds UNION SELECT root, dst FROM reached JOIN refs ON src = node)
        SELECT * FROM reached"""
)
def ref_closure(spark: SparkSession, sf: str) -> DataFrame:
    roots = {s: STORY.element(s).name for s in STORY.subjects}
    seeds = spark.createDataFrame(list(roots.items()), "root string, node string")
    edges = spark.createDataFrame([(r, *e) for r in roots for e in _REFERENCES], "root string, src string, dst string")
    return closure(seeds, edges, "root").select("root", "node")
