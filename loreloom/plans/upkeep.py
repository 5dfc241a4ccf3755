"""Queries of the maintenance pass and of paths, over the sessions' last characters as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import typed_answer
from loreloom.operators import upkeep
from loreloom.operators.graph import latest_entries
from loreloom.operators.knowledge import leaf_table, path_text, search
from loreloom.operators.snapshots import union_snapshots
from loreloom.plans.registry import Catalogue
from loreloom.schema.story import STORY
from loreloom.sources.tables import table

catalogue = Catalogue()
KEY = ["session_id", "entry_key"]

#: Last delivered snapshot of each session, of either table.
LAST = """last_seen AS (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (
  SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1)"""


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    return union_snapshots([table(spark, sf, n) for n in ("character_states", "group_states")], "session_id", "snapshot_seq")


def latest(spark: SparkSession, sf: str, name: str, columns: list[str]) -> DataFrame:
    """Entries of ``name`` in each session's last snapshot of either table."""
    return latest_entries(table(spark, sf, name), columns, delivered(spark, sf))


_FIELDS = ["description", "traits", "attributes", "status"]
_LIST = "unnest([{{'name': 'description', 'items': {0}description}}, {{'name': 'traits', 'items': {0}traits}}, {{'name': 'attributes', 'items': {0}attributes}}])"
_PLACE = "unnest([{'name': 'position', 'items': v.position}, {'name': 'aliases', 'items': v.aliases}, {'name': 'events', 'items': v.events}])"
LEAVES = f"""{LAST}, ents AS (SELECT session_id, entry_key, r.description AS description, r.traits AS traits, r.attributes AS attributes, r.status AS status, r.ord AS ord FROM (
  SELECT session_id, entry_key, arg_max({{'description': description, 'traits': traits, 'attributes': attributes, 'status': status, 'ord': entry_ord}}, loaded_at) AS r
  FROM character_states JOIN last_seen USING (session_id, snapshot_seq) WHERE entry_key IS NOT NULL GROUP BY ALL)),
arr AS (SELECT session_id, entry_key, f.name AS field, f.items AS items FROM (SELECT session_id, entry_key, {_LIST.format("")} AS f FROM ents) WHERE f.items IS NOT NULL),
st AS (SELECT session_id, entry_key, e.key AS k, e.value AS v FROM (SELECT session_id, entry_key, unnest(map_entries(status)) AS e FROM ents)),
starr AS (SELECT session_id, entry_key, k, f.name AS field, f.items AS items FROM (SELECT session_id, entry_key, k, {_PLACE} AS f FROM st) WHERE f.items IS NOT NULL),
leaves AS (
  SELECT session_id, entry_key, field AS path, '[]' AS value FROM arr WHERE len(items) = 0
  UNION ALL SELECT session_id, entry_key, field || '.' || (i - 1), items[i] FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM arr)
  UNION ALL SELECT session_id, entry_key, 'status', '{{}}' FROM ents WHERE cardinality(status) = 0
  UNION ALL SELECT session_id, entry_key, 'status.' || k, CASE WHEN v IS NULL THEN NULL ELSE '{{}}' END FROM st WHERE v.position IS NULL AND v.aliases IS NULL AND v.events IS NULL
  UNION ALL SELECT session_id, entry_key, 'status.' || k || '.' || field, '[]' FROM starr WHERE len(items) = 0
  UNION ALL SELECT session_id, entry_key, 'status.' || k || '.' || field || '.' || (i - 1), items[i] FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM starr)
  UNION ALL SELECT session_id, entry_key, '', '{{}}' FROM ents WHERE description IS NULL AND traits IS NULL AND attributes IS NULL AND status IS NULL)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each session's last characters as JSON documents: ``session_id``, ``entry_key``, ``ord``, ``doc``."""
    entries = latest(spark, sf, "character_states", [*_FIELDS, "entry_ord"])
    return entries.select(*KEY, F.col("entry_ord").alias("ord"), F.to_json(F.struct(*_FIELDS)).alias("doc"))


def character_leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    return leaf_table(documents(spark, sf), KEY, "doc")


@catalogue.add(sql=f"WITH {LEAVES} SELECT * FROM leaves")
def character_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return character_leaf_rows(spark, sf).select(*KEY, path_text(F.col("path")).alias("path"), "value")


_ITEMS = """nodes AS (SELECT session_id, entry_key, '' AS path, 'Character' AS kind FROM ents
    UNION ALL SELECT session_id, entry_key, 'status.' || k, 'Position' FROM st),
  present AS (SELECT session_id, entry_key, field AS path, 'list[str]' AS kind FROM arr
    UNION ALL SELECT session_id, entry_key, 'status.' || k || '.' || field, 'list[str]' FROM starr),
  wanted(kind, field, type, value) AS (VALUES ('Character', 'description', 'list[str]', '[]'), ('Character', 'traits', 'list[str]', '[]'),
    ('Character', 'attributes', 'list[str]', '[]'), ('Character', 'status', 'dict[str, Position]', '{}'), ('Character', 'relationships', 'dict[str, Bonds]', '{}'),
    ('Position', 'position', 'list[str]', '[]'), ('Position', 'aliases', 'list[str]', '[]'), ('Position', 'events', 'list[str]', '[]')),
  missing AS (SELECT * FROM (SELECT session_id, entry_key, CASE WHEN path = '' THEN field ELSE path || '.' || field END AS path, type AS kind, value FROM nodes JOIN wanted USING (kind)) w
    WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.session_id = w.session_id AND p.entry_key = w.entry_key AND p.path = w.path)
      AND NOT (w.path = 'status' AND EXISTS (SELECT 1 FROM ents e WHERE e.session_id = w.session_id AND e.entry_key = w.entry_key AND e.status IS NOT NULL)))"""


@catalogue.add(
    sql=f"""WITH {LEAVES}, {_ITEMS} SELECT session_id, entry_key, path, kind, 'node' AS work FROM nodes
        UNION ALL SELECT session_id, entry_key, path, kind, 'update' FROM present UNION ALL SELECT session_id, entry_key, path, kind, 'initialise' FROM missing"""
)
def work_items(spark: SparkSession, sf: str) -> DataFrame:
    """What a maintenance pass visits in each character: objects, values to update, fields to initialise."""
    items = upkeep.work_items(character_leaf_rows(spark, sf), KEY, "Character", STORY)
    return items.select(*KEY, path_text(F.col("path")).alias("path"), "kind", "work")


@catalogue.add(sql=f"WITH {LEAVES}, {_ITEMS} SELECT session_id, entry_key, path, kind, value FROM missing")
def initial_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that characters and their places lack, with what they start with."""
    nodes = upkeep.nodes_of(character_leaf_rows(spark, sf), KEY, "Character", STORY).where(F.col("kind") != upkeep.CLOSED)
    found = upkeep.missing_fields(nodes, KEY, STORY)
    return found.select(*KEY, path_text(F.col("path")).alias("path"), "kind", "value")


_FAILS = "length(entry_key) % 3 = 0"


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, '' AS node, action FROM ents, (VALUES ('gate_check', 0), ('update', 1), ('add_new', 2)) v(action, i)
        WHERE i = 0 OR (i = 1 AND NOT {_FAILS}) OR (i = 2 AND length(session_id || entry_key) % 2 = 0)"""
)
def pass_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Actions that run on each character: by its triggers, and no update after a failed gate."""
    items = upkeep.work_items(character_leaf_rows(spark, sf), KEY, "Character", STORY)
    new_scene = F.length(F.concat(*KEY)) % 2 == 0
    due = upkeep.due_actions(items, KEY, upkeep.schema_triggers(spark, STORY), new_scene)
    # What new scenes add comes before the gate, so a failed one does not stop it.
    placed = due.withColumn("action_ord", F.when(F.col("action") == "add_new", -1).otherwise(F.col("action_ord")))
    ran = upkeep.run_actions(placed, KEY, F.length("entry_key") % 3 == 0)
    return ran.select(*KEY, "node", "action")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer to each character's update: NO, a stop reason, a list of patches, or lines, by the entry's place."""
    rows = documents(spark, sf)
    turn = F.col("ord") % 4
    listed = F.lit('```json\n[{"path": "traits", "value": ["changed", "twice"]}, {"path": "status[\\"New Place\\"].position[0]", "value": "guest"}]\n```')
    lines = F.lit("path: traits[0], value: first\npath: traits[0], value: Seen again\npath: attributes, value: []\nEND_OF_UPDATES")
    return rows.select(
        *KEY,
        F.array().cast("array<string>").alias("node_path"),
        F.lit(0).alias("node_ord"),
        F.when(turn == 0, " no ").when(turn == 1, listed).otherwise(lines).alias("answer"),
        F.when(turn == 3, "UNCHANGED").alias("stop_reason"),
    )


_AFTER = f"""{LEAVES}, kinds AS (SELECT session_id, entry_key, coalesce(ord % 4, 2) AS turn FROM ents),
  after_pass AS (
    SELECT l.* FROM leaves l JOIN kinds USING (session_id, entry_key) WHERE turn IN (0, 3)
      OR (turn = 1 AND path <> 'traits' AND NOT starts_with(path, 'traits.') AND path <> 'status.New Place.position.0')
      OR (turn = 2 AND path <> 'traits.0' AND path <> 'attributes' AND NOT starts_with(path, 'attributes.'))
    UNION ALL SELECT session_id, entry_key, path, value FROM kinds, (VALUES ('traits.0', 'changed'), ('traits.1', 'twice'), ('status.New Place.position.0', 'guest')) v(path, value) WHERE turn = 1
    UNION ALL SELECT session_id, entry_key, path, value FROM kinds, (VALUES ('traits.0', 'Seen again'), ('attributes', '[]')) v(path, value) WHERE turn = 2)"""


@catalogue.add(sql=f"WITH {_AFTER} SELECT * FROM after_pass")
def run_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Characters after a pass whose answers are given: rejected ones change nothing, patches apply in order."""
    after = upkeep.run_pass(character_leaf_rows(spark, sf), _answers(spark, sf), KEY)
    return after.select(*KEY, path_text(F.col("path")).alias("path"), "value")


@catalogue.add(
    sql=f"""WITH {LEAVES}, kinds AS (SELECT session_id, entry_key, coalesce(ord % 4, 2) AS turn FROM ents)
        SELECT session_id, entry_key, i::BIGINT AS seq, path, value FROM kinds, (VALUES (1, 0, 'traits', '["changed","twice"]'), (1, 1, 'status.New Place.position.0', 'guest'),
          (2, 0, 'traits.0', 'first'), (2, 1, 'traits.0', 'Seen again'), (2, 2, 'attributes', '[]')) v(turn, i, path, value) WHERE kinds.turn = v.turn"""
)
def branch_patches(spark: SparkSession, sf: str) -> DataFrame:
    """The patches of the answers, by character and in order; rejected answers have none."""
    patches = upkeep.answer_patches(_answers(spark, sf), KEY)
    return patches.select(*KEY, "seq", path_text(F.col("path")).alias("path"), F.regexp_replace("value", ', "', ',"').alias("value"))


@catalogue.add(
    sql=f"""WITH {_AFTER} SELECT coalesce(l.session_id, a.session_id) AS session_id, coalesce(l.entry_key, a.entry_key) AS entry_key, coalesce(l.path, a.path) AS path, l.value AS old, a.value AS new,
          CASE WHEN l.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM leaves l FULL JOIN after_pass a ON l.session_id = a.session_id AND l.entry_key = a.entry_key AND l.path = a.path
        WHERE l.path IS NULL OR a.path IS NULL OR l.value IS DISTINCT FROM a.value"""
)
def document_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What a pass changed, leaf by leaf."""
    before = character_leaf_rows(spark, sf)
    changed = upkeep.leaf_changes(before, upkeep.run_pass(before, _answers(spark, sf), KEY), KEY)
    return changed.withColumn("path", path_text(F.col("path")))


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, '' AS at, f AS child, CASE WHEN f = 'status' THEN 'object' ELSE 'list' END AS kind,
          n::BIGINT AS n FROM (SELECT session_id, entry_key, unnest([{{'f': 'description', 'n': len(description)}}, {{'f': 'traits', 'n': len(traits)}}, {{'f': 'attributes', 'n': len(attributes)}}, {{'f': 'status', 'n': cardinality(status)::BIGINT}}], recursive := true) FROM ents) WHERE n IS NOT NULL"""
)
def list_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Children of each character's document, what they are and how many members they have."""
    rows = upkeep.children_of(character_leaf_rows(spark, sf), KEY, 0)
    return rows.select(*KEY, path_text(F.col("at")).alias("at"), "child", "kind", "n")


_ASKED = {"a": ["ATTRIB", "0"], "b": ["the traits", "1"], "c": ["traits", "-1"], "d": ["desc", "0", "x"], "e": ["nowhere"]}


def _resolved(spark: SparkSession, sf: str, both_ways: bool) -> DataFrame:
    wanted = spark.createDataFrame(list(_ASKED.items()), "asked string, steps array<string>")
    rows = upkeep.resolve_steps(character_leaf_rows(spark, sf), wanted, KEY, both_ways=both_ways)
    return rows.select(*KEY, "asked", path_text(F.col("path")).alias("path"))


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, 'a' AS asked, 'attributes.0' AS path FROM ents WHERE len(attributes) > 0
        UNION ALL SELECT session_id, entry_key, 'b', 'traits.1' FROM ents WHERE len(traits) > 1"""
)
def path_resolve_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy paths as a tool resolves them, level by level: either text may hold the other, no negative places."""
    return _resolved(spark, sf, both_ways=True)


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, 'a' AS asked, 'attributes.0' AS path FROM ents WHERE len(attributes) > 0
        UNION ALL SELECT session_id, entry_key, 'c', 'traits.' || (len(traits) - 1) FROM ents WHERE len(traits) > 0"""
)
def path_resolve_template(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy paths as a template resolves them: the key holds the step; a negative place counts from the end."""
    return _resolved(spark, sf, both_ways=False)


@catalogue.add(
    sql=f"""WITH {LEAVES}, terms(term) AS (VALUES ('status'), ('printer'), ('xyzzy')),
        steps AS (SELECT session_id, entry_key, field AS path, lower(field) AS text, CASE WHEN len(items) = 0 THEN '[]' END AS value FROM arr
          UNION ALL SELECT session_id, entry_key, 'status', 'status', CASE WHEN cardinality(status) = 0 THEN '{{}}' END FROM ents WHERE status IS NOT NULL
          UNION ALL SELECT session_id, entry_key, 'status.' || k, lower(k), CASE WHEN v.position IS NULL AND v.aliases IS NULL AND v.events IS NULL AND v IS NOT NULL THEN '{{}}' END FROM st
          UNION ALL SELECT session_id, entry_key, 'status.' || k || '.' || field, field, CASE WHEN len(items) = 0 THEN '[]' END FROM starr),
        hits AS (SELECT term, session_id, entry_key, path, value, 'key' AS matched_on FROM steps, terms WHERE contains(text, term)
          UNION ALL SELECT term, session_id, entry_key, path, value, 'value' FROM leaves, terms WHERE path <> '' AND contains(lower(value), term)),
        best AS (SELECT term, session_id, entry_key, path, arg_min(struct_pack(v := value), matched_on).v AS value, min(matched_on) AS matched_on FROM hits GROUP BY term, session_id, entry_key, path)
        SELECT term, session_id, entry_key, path, value, matched_on, total_found FROM (
          SELECT *, count(*) OVER (PARTITION BY term) AS total_found, row_number() OVER (PARTITION BY term ORDER BY session_id, entry_key, path) AS n FROM best) WHERE n <= 10"""
)
def search_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and values of characters that hold a text; of hits on one path the one on the key stands."""
    return search(character_leaf_rows(spark, sf), KEY, ["status", "printer", "xyzzy"])


@catalogue.add(
    sql=f"""WITH {LEAVES} SELECT session_id, entry_key, path, CASE WHEN regexp_matches(path, '(^|\\.)position\\.0$') THEN value ELSE value END AS value FROM leaves WHERE path <> ''"""
)
def guarded_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Writes below a plain value or with one step are refused, so these change nothing."""
    leaf_rows = character_leaf_rows(spark, sf).where(F.size("path") > 0).select(*KEY, "path", "value")
    plain = leaf_rows.where(F.col("value").isNull() | ~F.col("value").isin("{}", "[]"))
    below = plain.select(*KEY, F.lit(1).cast("bigint").alias("seq"), F.concat("path", F.array(F.lit("deeper"))).alias("path"), F.lit("x").alias("value"))
    short = leaf_rows.select(*KEY, F.lit(2).cast("bigint").alias("seq"), F.slice("path", 1, 1).alias("path"), F.lit("y").alias("value")).distinct()
    allowed = upkeep.reject_below_values(leaf_rows, below.unionByName(short), KEY)
    return upkeep.apply_patches(leaf_rows, allowed, KEY).select(*KEY, path_text(F.col("path")).alias("path"), "value")


@catalogue.add(
    sql="""SELECT event_id, 'int' AS kind, user_id::VARCHAR AS value FROM events UNION ALL SELECT event_id, 'bool', CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END FROM events
        UNION ALL SELECT event_id, 'list[str]', '["' || event_type || '","b"]' FROM events UNION ALL SELECT event_id, 'list[int]', NULL FROM events
        UNION ALL SELECT event_id, 'dict[str, int]', props FROM events UNION ALL SELECT event_id, 'str', '"' || event_type || '"' FROM events"""
)
def typed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as values of the type a field asks for; what does not fit is null and asks for another try."""
    kind = F.col("event_type")
    given = F.array(
        F.struct(F.lit("int").alias("kind"), F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\n")).alias("a")),
        F.struct(F.lit("bool").alias("kind"), F.when(kind == "view", " Yes").otherwise(kind).alias("a")),
        F.struct(F.lit("list[str]").alias("kind"), F.concat(kind, F.lit(", b,")).alias("a")),
        F.struct(F.lit("list[int]").alias("kind"), kind.alias("a")),
        F.struct(F.lit("dict[str, int]").alias("kind"), F.concat(F.lit("<think>so</think>```json\n"), F.col("props"), F.lit("\n```")).alias("a")),
        F.struct(F.lit("str").alias("kind"), kind.alias("a")),
    )
    rows = table(spark, sf, "events").select("event_id", F.inline(given))
    return rows.select("event_id", "kind", typed_answer(F.col("a"), F.col("kind")).alias("value"))


@catalogue.add(sql=f"WITH {LEAVES} SELECT session_id, entry_key, path, CASE WHEN regexp_matches(path, '(^|\\.)description\\.0$') THEN 'n' ELSE value END AS value FROM leaves WHERE path NOT LIKE 'status%'")
def stamp_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A value stamped on every leaf of one name (here the first description)."""
    rows = character_leaf_rows(spark, sf).where((F.size("path") == 0) | (F.element_at("path", 1) != "status"))
    named = rows.withColumn("path", F.when(path_text(F.col("path")) == "description.0", F.array(F.lit("_mark"))).otherwise(F.col("path")))
    stamped = upkeep.stamp(named, "mark", F.lit("n"))
    path = F.when(path_text(F.col("path")) == "_mark", "description.0").otherwise(path_text(F.col("path")))
    return stamped.select(*KEY, path.alias("path"), "value")
