"""Queries on nested records, entity history and snapshot changes (problems 3, 4, 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.statements import statement_digest
from loreloom.operators.history import attribute_versions, version_rows
from loreloom.operators.nested import flat_table, flat_tables
from loreloom.operators.snapshot_diff import snapshot_changes
from loreloom.operators.snapshots import union_snapshots
from loreloom.plans.registry import Catalogue
from loreloom.sources.tables import table

catalogue = Catalogue()

#: DuckDB counterpart of functions.statements.statement_set for a list column.
_SET_SQL = (
    "list_sort(list_distinct(list_filter(list_transform(coalesce({0}, []), "
    "lambda s: lower(upper(regexp_replace(s, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+', '', 'g')))), "
    "lambda s: s IS NOT NULL AND s <> '')))"
)


def statement_set_sql(column: str) -> str:
    return _SET_SQL.format(column)


_SNAPSHOTS_SQL = """snaps AS (
  SELECT session_id, snapshot_seq,
         lag(snapshot_seq) OVER w AS prev_seq, lead(snapshot_seq) OVER w AS next_seq
  FROM (SELECT session_id, snapshot_seq FROM character_states
        UNION SELECT session_id, snapshot_seq FROM group_states)
  WINDOW w AS (PARTITION BY session_id ORDER BY snapshot_seq))"""

_KEY = {"record": "record_id", "subject": "subject", "doc": "doc"}


@catalogue.add()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return flat_tables(table(spark, sf, "kb_records"), **_KEY).distinct()


@catalogue.add()
def p3_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = flat_table(table(spark, sf, "kb_records"), "attribute", **_KEY)
    return rows.distinct().select("record_id", F.col("parent").alias("character_key"), "ord", F.col("child").alias("attribute"))


def _flat(spark: SparkSession, sf: str, kind: str, **names: str) -> DataFrame:
    """One target table: its rows by its own inline, columns named for what they hold."""
    rows = flat_table(table(spark, sf, "kb_records"), kind, **_KEY).distinct()
    return rows.select("record_id", *[F.col(c).alias(n) for c, n in names.items()])


@catalogue.add()
def p3_scene_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "when", parent="state", child="message_node")


@catalogue.add()
def p3_participants(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "participant", parent="list", ord="ord", child="name")


@catalogue.add()
def p3_events(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "event", parent="section", ord="ord", child="name")


@catalogue.add()
def p3_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "summary", parent="event", child="summary")


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "character_states")
    snapshots = union_snapshots([rows, table(spark, sf, "group_states")], "session_id", "snapshot_seq")
    return rows, attribute_versions(
        rows,
        snapshots,
        session="session_id",
        seq="snapshot_seq",
        entry="entry_key",
        loaded="loaded_at",
        payload=["traits", "attributes"],
    )


_P4_SQL = f"""
WITH {_SNAPSHOTS_SQL},
facts AS (
  SELECT session_id, entry_key, snapshot_seq, arg_max([{statement_set_sql("traits")}, {statement_set_sql("attributes")}], loaded_at) AS state
  FROM character_states GROUP BY ALL),
marked AS (
  SELECT f.*, s.next_seq,
         CASE WHEN lag(f.state) OVER w = f.state AND lag(s.next_seq) OVER w = f.snapshot_seq THEN 0 ELSE 1 END AS fresh
  FROM facts f JOIN snaps s USING (session_id, snapshot_seq)
  WINDOW w AS (PARTITION BY session_id, entry_key ORDER BY snapshot_seq)),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY session_id, entry_key ORDER BY snapshot_seq) AS run FROM marked)
SELECT session_id, entry_key, min(snapshot_seq) AS valid_from_seq,
       coalesce(arg_max(coalesce(next_seq, -1), snapshot_seq), -1)::INT AS valid_to_seq
FROM runs GROUP BY session_id, entry_key, run
"""


@catalogue.add(sql=_P4_SQL)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _versions(spark, sf)[1]


_P4_ROWS_SQL = f"""
WITH versions AS ({_P4_SQL}),
valid AS (
  SELECT session_id, entry_key, snapshot_seq, arg_max({{'traits': traits, 'attributes': attributes}}, loaded_at) AS held
  FROM character_states GROUP BY ALL)
SELECT v.session_id, v.entry_key, valid_from_seq, valid_to_seq, held.traits AS traits, held.attributes AS attributes
FROM versions v JOIN valid d ON v.session_id = d.session_id AND v.entry_key = d.entry_key AND v.valid_from_seq = d.snapshot_seq
"""


@catalogue.add(sql=_P4_ROWS_SQL)
def p4_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows, versions = _versions(spark, sf)
    return version_rows(
        rows,
        versions,
        session="session_id",
        seq="snapshot_seq",
        entry="entry_key",
        loaded="loaded_at",
        keep=["traits", "attributes"],
    )


_P5_SQL = f"""
WITH {_SNAPSHOTS_SQL},
facts AS (
  SELECT kind, session_id, snapshot_seq, entry_key, arg_max({statement_set_sql("description")}, loaded_at) AS state
  FROM (SELECT 'character' AS kind, session_id, snapshot_seq, entry_key, description, loaded_at FROM character_states
        UNION ALL SELECT 'group', session_id, snapshot_seq, entry_key, description, loaded_at FROM group_states)
  GROUP BY ALL),
later AS (
  SELECT kind, session_id, snapshot_seq AS pair, entry_key, state FROM facts JOIN snaps USING (session_id, snapshot_seq)
  WHERE prev_seq IS NOT NULL),
earlier AS (
  SELECT kind, session_id, next_seq AS pair, entry_key, state FROM facts JOIN snaps USING (session_id, snapshot_seq)
  WHERE next_seq IS NOT NULL)
SELECT * FROM (
  SELECT coalesce(l.kind, e.kind) AS kind, coalesce(l.session_id, e.session_id) AS session_id,
         coalesce(l.pair, e.pair) AS snapshot_seq, coalesce(l.entry_key, e.entry_key) AS entry_key,
         CASE WHEN e.pair IS NULL THEN 'added' WHEN l.pair IS NULL THEN 'removed'
              WHEN l.state <> e.state THEN 'changed' END AS change_kind
  FROM later l FULL JOIN earlier e
    ON l.kind = e.kind AND l.session_id = e.session_id AND l.pair = e.pair AND l.entry_key = e.entry_key)
WHERE change_kind IS NOT NULL
"""


@catalogue.add(sql=_P5_SQL)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    sides = {"character": table(spark, sf, "character_states"), "group": table(spark, sf, "group_states")}
    parts = [
        t.select(F.lit(kind).alias("kind"), "session_id", "snapshot_seq", "entry_key", "loaded_at", "description")
        for kind, t in sides.items()
    ]
    return snapshot_changes(
        parts[0].unionByName(parts[1]),
        union_snapshots(list(sides.values()), "session_id", "snapshot_seq"),
        series=["kind", "session_id"],
        seq="snapshot_seq",
        session="session_id",
        key="entry_key",
        loaded="loaded_at",
        digest=statement_digest(F.col("description")),
    )
