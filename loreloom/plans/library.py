"""Queries of snapshots, chunk stores, retrieval by text, templates, and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions.nested import (
    common_names,
    is_list_map,
    list_to_map,
    longest_first,
    map_to_list,
    merged,
    seed_of,
    short_id,
    unique_names,
)
from loreloom.functions.text import bullet_text, clock_part, stop_hit, template_dialect, tool_response
from loreloom.operators.rendering import list_preview
from loreloom.operators.templates import SECTIONS, render
from loreloom.operators.upkeep import applicable, schema_triggers
from loreloom.operators.vectors_text import embed_terms, similar_texts
from loreloom.plans import knowledge
from loreloom.plans.conversation import CONV, SAYING, conversations, metadata_rows
from loreloom.plans.registry import Catalogue
from loreloom.plans.upkeep import LAST, LEAVES, character_leaf_rows, delivered, latest
from loreloom.schema.story import STORY
from loreloom.session import cut_lineage
from loreloom.sources.tables import table

catalogue = Catalogue()

_SUBJECTS_SQL = f"""{LAST}, subjects AS (
  SELECT 'characters' AS subject, session_id, entry_key, min(entry_ord) AS ord FROM character_states JOIN last_seen USING (session_id, snapshot_seq) WHERE entry_key IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'groups', session_id, entry_key, min(entry_ord) FROM group_states JOIN last_seen USING (session_id, snapshot_seq) WHERE entry_key IS NOT NULL GROUP BY ALL)"""


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for subject, name in (("characters", "character_states"), ("groups", "group_states")):
        rows = latest(spark, sf, name, ["entry_ord"])
        parts.append(rows.select(F.lit(subject).alias("subject"), "session_id", "entry_key", F.col("entry_ord").alias("ord")))
    return parts[0].unionByName(parts[1])


@catalogue.add(sql=f"WITH {_SUBJECTS_SQL} SELECT subject, session_id, entry_key FROM subjects")
def subject_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of all subjects of a session's last snapshot as one table."""
    return _subjects(spark, sf).drop("ord")


@catalogue.add(
    sql="""SELECT session_id, arg_max(record_id, (snapshot_seq, loaded_at, record_id)) AS record_id FROM kb_records
        WHERE subject = 'current_scene' AND session_id IS NOT NULL AND snapshot_seq IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1"""
)
def current_scene_record(spark: SparkSession, sf: str) -> DataFrame:
    """The record that holds each session's current scene."""
    rows = table(spark, sf, "kb_records").where(F.col("subject") == "current_scene").dropna(subset=["session_id", "snapshot_seq", "loaded_at"])
    return rows.groupBy("session_id").agg(F.max_by("record_id", F.struct("snapshot_seq", "loaded_at", "record_id")).alias("record_id"))


@catalogue.add(
    sql=f"""WITH {LAST} SELECT session_id, snapshot_seq + 1 AS snapshot_seq, entry_key, arg_max([traits], loaded_at)[1] AS traits
        FROM character_states JOIN last_seen USING (session_id, snapshot_seq) WHERE entry_key IS NOT NULL GROUP BY ALL"""
)
def snapshot_fork(spark: SparkSession, sf: str) -> DataFrame:
    """The next snapshot of each session as it begins: a copy of the last under the next number."""
    last = delivered(spark, sf).groupBy("session_id").agg(F.max("snapshot_seq").alias("snapshot_seq"))
    entries = latest(spark, sf, "character_states", ["traits"]).join(last, "session_id")
    return entries.select("session_id", (F.col("snapshot_seq") + 1).alias("snapshot_seq"), "entry_key", "traits")


@catalogue.add(
    sql=f"""WITH {_SUBJECTS_SQL}, s AS (SELECT session_id, min(world_hash) AS world_hash, min(started_at) AS started_at FROM sessions WHERE world_hash IS NOT NULL GROUP BY 1),
        filled AS (SELECT DISTINCT session_id FROM subjects), seeds AS (SELECT world_hash, arg_min(session_id, (started_at, session_id)) AS seed FROM s JOIN filled USING (session_id) GROUP BY 1)
        SELECT s.session_id, u.subject, u.entry_key FROM s JOIN seeds USING (world_hash) JOIN subjects u ON u.session_id = seeds.seed
        WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.session_id = s.session_id AND abs(hash(f.session_id)) >= 0 AND ascii(right(s.session_id, 1)) % 5 <> 0)"""
)
def seeded_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that a new session takes over from the earliest filled session of its world (here every fifth, by its id, counts as new)."""
    entries = _subjects(spark, sf)
    sessions = table(spark, sf, "sessions").where(F.col("world_hash").isNotNull())
    sessions = sessions.groupBy("session_id").agg(F.min("world_hash").alias("world_hash"), F.min("started_at").alias("started_at"))
    filled = entries.select("session_id").distinct()
    seeds = sessions.join(filled, "session_id").groupBy("world_hash").agg(F.min_by("session_id", F.struct("started_at", "session_id")).alias("seed"))
    new = F.ascii(F.right("session_id", F.lit(1))) % 5 == 0
    empty = sessions.join(filled.where(~new), "session_id", "left_anti")
    copied = entries.withColumnRenamed("session_id", "seed")
    return empty.join(seeds, "world_hash").join(copied, "seed").select("session_id", "subject", "entry_key")


@catalogue.add(
    sql="""WITH m AS (SELECT DISTINCT context_id, (i - 1)::INT AS ord, messages[i] AS text, messages_metadata[i] AS m FROM (
          SELECT context_id, messages, messages_metadata, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts) WHERE messages[i] IS NOT NULL)
        SELECT context_id, ord, coalesce(m.id, ord || '_0_0') AS node, text, coalesce(m.timestamp, '') AS timestamp, coalesce(array_to_string(m.speakers, '|'), '') AS speakers,
          coalesce(array_to_string(m.characters_present, '|'), '') AS present, coalesce(m.scene_id, '') AS scene_id, coalesce(m.event_id, '') AS event_id, coalesce(m.is_summary, false) AS is_summary FROM m"""
)
def chunk_store(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as a store keeps them: the text with its metadata flat, and a default for what is missing."""
    rows = table(spark, sf, "retrieval_contexts").select("context_id", F.posexplode("messages").alias("ord", "text"), "messages_metadata")
    m = F.get("messages_metadata", F.col("ord"))
    plain = lambda name: F.coalesce(m[name], F.lit("")).alias(name)
    joined = lambda name, to: F.coalesce(F.array_join(m[name], "|"), F.lit("")).alias(to)
    node = F.coalesce(m["id"], F.concat(F.col("ord").cast("string"), F.lit("_0_0")))
    return rows.where(F.col("text").isNotNull()).select(
        "context_id", "ord", node.alias("node"), "text", plain("timestamp"), joined("speakers", "speakers"), joined("characters_present", "present"),
        plain("scene_id"), plain("event_id"), F.coalesce(m["is_summary"], F.lit(False)).alias("is_summary"),
    ).distinct()


@catalogue.add(
    sql=f"""WITH {CONV}, last AS (SELECT conv_id, max(exchange_idx) AS last FROM conv GROUP BY 1)
        SELECT conv_id, message_idx, role, text FROM conv JOIN last USING (conv_id) WHERE exchange_idx < last
        UNION ALL SELECT conv_id, last * 2, 'user', 'Go on.' FROM last UNION ALL SELECT conv_id, last * 2 + 1, 'assistant', 'They went on.' FROM last"""
)
def replaced_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation with its last exchange replaced: cut before it, then the new one appended."""
    rows = conversations(spark, sf)
    last = rows.groupBy("conv_id").agg(F.max("exchange_idx").alias("last"))
    kept = rows.join(last, "conv_id").where(F.col("exchange_idx") < F.col("last")).select("conv_id", "message_idx", "role", "text")
    new = F.array(
        F.struct((F.col("last") * 2).alias("message_idx"), F.lit("user").alias("role"), F.lit("Go on.").alias("text")),
        F.struct((F.col("last") * 2 + 1).alias("message_idx"), F.lit("assistant").alias("role"), F.lit("They went on.").alias("text")),
    )
    return kept.unionByName(last.select("conv_id", F.inline(new)))


@catalogue.add(
    sql="""WITH m AS (SELECT DISTINCT context_id, i, session_id, messages_metadata[i] AS m FROM (
          SELECT context_id, session_id, messages_metadata, unnest(range(1, len(messages_metadata) + 1)) AS i FROM retrieval_contexts) WHERE messages_metadata[i] IS NOT NULL),
        names AS (SELECT session_id, m.scene_number AS scene_number, min(m.scene_id) AS scene FROM m WHERE m.scene_id IS NOT NULL AND m.scene_number IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL)
        SELECT context_id, (i - 1)::INT AS ord, m.scene_number AS scene_number, coalesce(m.scene_id, scene, 'scene ' || m.scene_number) AS shown FROM m
        LEFT JOIN names ON m.session_id = names.session_id AND m.m.scene_number = names.scene_number"""
)
def scene_display(spark: SparkSession, sf: str) -> DataFrame:
    """The name under which each message's scene is shown: its own, else that of the session's scene of this number, else the number."""
    rows = table(spark, sf, "retrieval_contexts").select("context_id", "session_id", F.posexplode("messages_metadata").alias("ord", "m"))
    rows = rows.where(F.col("m").isNotNull()).select("context_id", "session_id", "ord", "m.scene_id", "m.scene_number", F.xxhash64(F.to_json("m")).alias("h")).distinct()
    names = rows.where(F.col("scene_id").isNotNull() & F.col("scene_number").isNotNull() & F.col("session_id").isNotNull())
    names = names.groupBy("session_id", "scene_number").agg(F.min("scene_id").alias("scene"))
    shown = F.coalesce("scene_id", "scene", F.concat(F.lit("scene "), F.col("scene_number").cast("string")))
    return rows.join(names, ["session_id", "scene_number"], "left").select("context_id", "ord", "scene_number", shown.alias("shown"))


_BUCKET = "('0x' || left(md5(w), 4))::INT"
_TERMS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3)"
_SIMILAR = f"""{SAYING}, asked AS (SELECT DISTINCT context_id AS query_id, session_id, context AS text FROM retrieval_contexts WHERE session_id IS NOT NULL AND context IS NOT NULL),
  stored AS (SELECT session_id, text, min(context_id * 10000 + message_idx) AS item_id FROM saying GROUP BY ALL),
  q AS (SELECT session_id, query_id, {_BUCKET} AS bucket, count(*) AS weight FROM (SELECT *, unnest({_TERMS.format("text")}) AS w FROM asked) GROUP BY ALL),
  d AS (SELECT session_id, item_id, {_BUCKET} AS bucket, count(*) AS weight FROM (SELECT *, unnest({_TERMS.format("text")}) AS w FROM stored) GROUP BY ALL),
  qn AS (SELECT session_id, query_id, sqrt(sum(weight * weight)) AS n FROM q GROUP BY ALL), dn AS (SELECT session_id, item_id, sqrt(sum(weight * weight)) AS n FROM d GROUP BY ALL),
  dots AS (SELECT q.session_id, query_id, item_id, sum(q.weight * d.weight) AS dot FROM q JOIN d ON q.session_id = d.session_id AND q.bucket = d.bucket GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY score DESC, item_id) AS place FROM (
    SELECT session_id, query_id, item_id, round(dot / (qn.n * dn.n), 6) AS score FROM dots JOIN qn USING (session_id, query_id) JOIN dn USING (session_id, item_id)))"""


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "retrieval_contexts").where(F.col("session_id").isNotNull() & F.col("context").isNotNull())
    asked = asked.select("session_id", F.col("context_id").alias("query_id"), F.col("context").alias("text")).distinct()
    item = F.min(F.col("context_id") * 10_000 + F.col("message_idx")).alias("item_id")
    said = table(spark, sf, "retrieval_contexts").where(F.col("session_id").isNotNull())
    said = said.select("context_id", "session_id", F.posexplode("messages").alias("message_idx", "text")).where(F.col("text").isNotNull())
    # A message that was delivered again has the same least number.
    stored = said.groupBy("session_id", "text").agg(item)
    queries = embed_terms(asked, ["session_id", "query_id"], "text")
    items = embed_terms(stored, ["session_id", "item_id"], "text")
    return similar_texts(queries, items, ["session_id"], "query_id", ["item_id"], 5)


@catalogue.add(sql=f"WITH {_SIMILAR} SELECT session_id, query_id, item_id, score, place::INT AS place FROM ranked WHERE place <= 5")
def retrieve_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The five messages of its session most like each context, as hashed term vectors."""
    return _retrieved(spark, sf)


_MERGED = {"characters": ("closure_important", "node"), "groups": ("group_relevance", "entry_key"), "scenes": ("scene_relevance", "scene")}


@catalogue.add(
    sql=" UNION ".join(f"SELECT '{part}' AS section, session_id, {column} AS name FROM ({knowledge.catalogue.sql[query]})" for part, (query, column) in _MERGED.items())
    + f" UNION SELECT 'lines', session_id, item_id::VARCHAR FROM (WITH {_SIMILAR} SELECT session_id, item_id FROM ranked WHERE place <= 5)"
)
def retrieve_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a session's context takes in, each name once: scene characters and whom they reach, groups and scenes that
    matter, and the messages most like its contexts."""
    # A table, so that what is left to do is one small plan.
    lines = cut_lineage(_retrieved(spark, sf).select("session_id", "item_id"))
    whole = lines.select(F.lit("lines").alias("section"), "session_id", F.col("item_id").cast("string").alias("name"))
    parts = knowledge.context_parts(spark, sf)
    for part, (query, column) in _MERGED.items():
        whole = whole.unionByName(parts[query].select(F.lit(part).alias("section"), "session_id", F.col(column).alias("name")))
    return whole.distinct()


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, '## ' || entry_key || chr(10)
          || coalesce(array_to_string(list_transform(description, lambda x: coalesce(x, '') || chr(10)), ''), '')
          || CASE WHEN len(traits) > 0 THEN 'Traits:' || chr(10) || array_to_string(list_transform(traits, lambda x: '- ' || coalesce(x, '') || chr(10)), '') ELSE '' END
          || CASE WHEN len(attributes) > 0 THEN 'Attributes:' || chr(10) || array_to_string(list_transform(attributes, lambda x: '- ' || coalesce(x, '') || chr(10)), '') ELSE '' END AS text,
          'jinja' AS dialect FROM ents"""
)
def rendered_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Characters by the section template, which compiles to one expression."""
    lines = T.ArrayType(T.StringType())
    rows = latest(spark, sf, "character_states", ["description", "traits", "attributes"])
    columns = {"name": (F.col("entry_key"), T.StringType()), **{c: (F.col(c), lines) for c in ("description", "traits", "attributes")}}
    template = SECTIONS["characters"]
    return rows.select("session_id", "entry_key", render(template, columns).alias("text"), template_dialect(F.lit(template)).alias("dialect"))


_STOPS = ("The ", '"', "they")


@catalogue.add(
    sql=rf"""WITH {CONV}, t AS (SELECT conv_id, message_idx, text, regexp_replace(text, '^[\t-\r ]+', '') AS low FROM conv)
        SELECT conv_id, message_idx, CASE WHEN starts_with(low, 'The ') THEN 'The ' WHEN starts_with(low, '"') THEN '"' WHEN starts_with(low, 'they') THEN 'they' END AS at_start,
          CASE WHEN contains(text, 'The ') THEN 'The ' WHEN contains(text, '"') THEN '"' WHEN contains(text, 'they') THEN 'they' END AS anywhere FROM t"""
)
def stop_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Which stop string a message begins with, and which it holds; the first of the list counts."""
    return conversations(spark, sf).select(
        "conv_id", "message_idx", stop_hit(F.col("text"), list(_STOPS), anywhere=False).alias("at_start"), stop_hit(F.col("text"), list(_STOPS), anywhere=True).alias("anywhere")
    )


@catalogue.add(
    sql="""WITH m AS (SELECT DISTINCT context_id, (i - 1)::INT AS ord, messages_metadata[i] AS m FROM (
          SELECT context_id, messages_metadata, unnest(range(1, len(messages_metadata) + 1)) AS i FROM retrieval_contexts) WHERE messages_metadata[i] IS NOT NULL)
        SELECT context_id, ord, array_to_string(list_sort(list_intersect(coalesce(m.speakers, []), coalesce(m.characters_present, []))), '|') AS speaking,
          coalesce(list_count(list_distinct(list_filter(m.characters_present, lambda n: n IS NOT NULL AND n <> ''))), 0)::INT AS n_present,
          coalesce(list_max(list_transform(list_filter(m.characters_present, lambda n: n <> ''), lambda n: length(n))), 0)::INT AS longest FROM m"""
)
def name_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Of each message the speakers that are present, how many different names, and how long the first by length is."""
    rows = metadata_rows(spark, sf).select(F.col("conv_id").alias("context_id"), "ord", "m.speakers", "m.characters_present", F.xxhash64(F.to_json("m")).alias("h")).distinct()
    names = unique_names(F.coalesce("characters_present", F.array().cast("array<string>")))
    first = F.get(longest_first(names), F.lit(0))
    return rows.select(
        "context_id", "ord", F.array_join(F.array_sort(common_names(F.col("speakers"), F.col("characters_present"))), "|").alias("speaking"),
        F.size(names).alias("n_present"), F.coalesce(F.length(first), F.lit(0)).alias("longest"),
    )


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, to_json(coalesce(traits, []))::VARCHAR AS packed, true AS is_list, len(coalesce(traits, [])) = 0 AS broken_is_list,
          CASE WHEN len(traits) > 20 THEN array_to_string(traits[1:20], ', ') || ', and ' || (len(traits) - 20) || ' more' ELSE array_to_string(traits, ', ') END AS preview FROM ents"""
)
def map_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as maps from their places and back, a map with a gap (which is no list), and a list's preview."""
    rows = latest(spark, sf, "character_states", ["traits"])
    items = F.coalesce("traits", F.array().cast("array<string>"))
    keyed = list_to_map(items)
    shuffled = F.map_from_entries(F.reverse(F.map_entries(keyed)))
    broken = F.map_filter(merged(shuffled, F.create_map(F.lit("x"), F.lit("y"))), lambda k, _: (k != "0") & (k != "x"))
    broken = F.map_concat(broken, F.map_filter(keyed, lambda k, _: (k == "0") & F.lit(False)))
    return rows.select(
        "session_id", "entry_key", F.to_json(map_to_list(shuffled)).alias("packed"), is_list_map(shuffled).alias("is_list"),
        (is_list_map(broken) & (F.size(items) != 1)).alias("broken_is_list"), list_preview(F.col("traits")).alias("preview"),
    ).withColumn("broken_is_list", F.when(F.size(F.from_json("packed", "array<string>")) == 1, False).otherwise(F.col("broken_is_list")))


@catalogue.add(
    sql="""SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, left(sha256(event_id::VARCHAR), 8) AS short, CASE WHEN event_id % 2 = 0 THEN event_id ELSE NULL END AS seed,
          CASE WHEN event_type = 'error' THEN '{"error": "no \\"' || event_type || '\\""}' ELSE props END AS response FROM events"""
)
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Clock part of an ISO time, a short id, a given seed, and a tool's answer as text."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    failed = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return table(spark, sf, "events").select(
        "event_id",
        clock_part(stamp).alias("clock"),
        short_id(F.col("event_id")).alias("short"),
        F.when(given.isNotNull(), seed_of(given, F.col("event_id"))).alias("seed"),
        tool_response(failed, F.col("props"), F.concat(F.lit('no "'), "event_type", F.lit('"'))).alias("response"),
    )


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS text FROM (
        SELECT session_id, entry_key, '- key: ' || entry_key || chr(10) || '- traits: ' || len(coalesce(traits, [])) AS t FROM ents)"""
)
def bullet_texts(spark: SparkSession, sf: str) -> DataFrame:
    """An entry as bullet lines, cut at a limit."""
    rows = latest(spark, sf, "character_states", ["traits"])
    size = F.size(F.coalesce("traits", F.array().cast("array<string>"))).cast("string")
    entries = F.map_from_arrays(F.array(F.lit("key"), F.lit("traits")), F.array(F.col("entry_key"), size))
    return rows.select("session_id", "entry_key", bullet_text(entries, 40).alias("text"))


@catalogue.add(
    sql="""SELECT session_id, subject FROM (SELECT DISTINCT session_id, unnest(['characters', 'groups', 'current_scene', 'events']) AS subject FROM sessions) WHERE subject <> 'events'"""
)
def subject_applicability(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects of which some action is due in a turn of each session."""
    kinds = [(s, STORY.element(s).name) for s in STORY.subjects]
    listed = F.array(*[F.struct(F.lit(s).alias("subject"), F.lit(k).alias("kind")) for s, k in kinds])
    rows = table(spark, sf, "sessions").select("session_id").distinct().select("session_id", F.inline(listed))
    return applicable(rows, schema_triggers(spark, STORY), F.length("session_id") % 2 == 0).select("session_id", "subject").distinct()


@catalogue.add(
    sql=f"""WITH {LEAVES}, fields AS (SELECT session_id, entry_key, split_part(path, '.', 1) AS field, count(*) AS n_leaves FROM leaves WHERE path <> '' GROUP BY ALL)
        SELECT session_id, entry_key, field, CASE WHEN field = 'status' THEN 'dict[str, Position]' ELSE 'list[str]' END AS type, n_leaves FROM fields"""
)
def typed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of documents joined with the schema's fields by name."""
    rows = character_leaf_rows(spark, sf).where(F.size("path") > 0)
    found = rows.groupBy("session_id", "entry_key", F.get("path", F.lit(0)).alias("field")).agg(F.count(F.lit(1)).alias("n_leaves"))
    fields = spark.createDataFrame([(f, t) for d, _, f, t, _ in STORY.field_rows() if d == "Character"], "field string, type string")
    return found.join(F.broadcast(fields), "field").select("session_id", "entry_key", "field", "type", "n_leaves")


@catalogue.add(
    sql=f"""WITH {LAST} SELECT session_id, entry_key AS name, 'group' AS type, arg_max([description], loaded_at)[1][1] AS descriptor, 'groups' AS subject FROM group_states
        JOIN last_seen USING (session_id, snapshot_seq) WHERE entry_key IS NOT NULL GROUP BY session_id, entry_key HAVING arg_max([description], loaded_at)[1][1] IS NOT NULL"""
)
def identified_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that an answer identifies: only objects with type, name and descriptor, of a type that has a subject."""
    rows = latest(spark, sf, "group_states", ["description"])
    descriptor = F.get("description", F.lit(0))
    whole = F.to_json(F.struct(F.lit("group").alias("type"), F.col("entry_key").alias("name"), descriptor.alias("descriptor")))
    odd = F.to_json(F.struct(F.lit("planet").alias("type"), F.col("entry_key").alias("name"), F.lit("x").alias("descriptor")))
    answer = F.concat(F.lit("["), whole, F.lit(", "), odd, F.lit(', {"type": "group", "name": "nobody"}, 7]'))
    items = F.from_json(answer, "array<string>")
    parsed = rows.select("session_id", F.explode(items).alias("item")).select("session_id", F.from_json("item", "type string, name string, descriptor string").alias("e"))
    valid = parsed.select("session_id", "e.*").dropna(subset=["type", "name", "descriptor"])
    subjects = spark.createDataFrame([(s.removesuffix("s"), s) for s in STORY.subjects], "type string, subject string")
    return valid.join(F.broadcast(subjects), "type").select("session_id", "name", "type", "descriptor", "subject").distinct()

