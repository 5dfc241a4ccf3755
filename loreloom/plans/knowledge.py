"""Queries on the relationship graph, documents by path, and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.operators.graph import (
    closure,
    edges_within,
    is_important,
    latest_entries,
    overridden_edges,
    pair_edges,
    relationship_edges,
)
from loreloom.operators.knowledge import (
    apply_patches,
    child_counts,
    expand_list,
    fuzzy_key,
    get_path,
    leaf_table,
    pack_list,
    path_text,
    search,
    violations,
)
from loreloom.functions.documents import object_text
from loreloom.operators.mentions import whole_word_mentions
from loreloom.operators.vectors import cosine_topk
from loreloom.plans.registry import Catalogue
from loreloom.plans.upkeep import delivered, latest
from loreloom.session import cut_lineage
from loreloom.sources.tables import table

catalogue = Catalogue()


_EDGES = """edges AS (
  SELECT session_id, src, dst, (i - 1)::INT AS ord, rs[i].relation AS relation, rs[i].importance AS importance FROM (
    SELECT session_id, src, e.key AS dst, e.value AS rs, unnest(range(1, len(e.value) + 1)) AS i FROM (
      SELECT session_id, entry_key AS src, unnest(map_entries(relationships)) AS e FROM (
        SELECT session_id, entry_key, arg_max(relationships, loaded_at) AS relationships FROM character_states t
        JOIN (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m
          USING (session_id, snapshot_seq) GROUP BY ALL))))"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return relationship_edges(latest(spark, sf, "character_states", ["relationships"]))


@catalogue.add(sql=f"WITH {_EDGES} SELECT * FROM edges")
def relationship_edge(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@catalogue.add(sql=f"WITH {_EDGES} SELECT * FROM edges WHERE coalesce(importance, 0) >= 75")
def important_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).where(is_important(F.col("importance")))


@catalogue.add(
    sql=f"""WITH {_EDGES} SELECT session_id, src, dst, ord, relation, importance FROM (
        SELECT *, max(coalesce(importance, 0)) OVER (PARTITION BY session_id, src, dst) AS top FROM edges)
        WHERE top < 75 OR coalesce(importance, 0) >= 75"""
)
def relationship_override(spark: SparkSession, sf: str) -> DataFrame:
    return overridden_edges(_edges(spark, sf))


#: Characters of a session's scenes, as the metadata of its retrieved messages names them.
PRESENT = """people AS (SELECT DISTINCT session_id, name FROM (SELECT session_id, unnest(m.characters_present) AS name FROM (
  SELECT session_id, unnest(messages_metadata) AS m FROM retrieval_contexts)) WHERE session_id IS NOT NULL AND name IS NOT NULL)"""


def present_people(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "retrieval_contexts").select("session_id", F.explode("messages_metadata").alias("m"))
    names = rows.select("session_id", F.explode("m.characters_present").alias("name"))
    return names.where(F.col("session_id").isNotNull() & F.col("name").isNotNull()).distinct()


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """What the sessions' contexts say: ``session_id``, ``text``, distinct."""
    rows = table(spark, sf, "retrieval_contexts").select("session_id", F.col("context").alias("text"))
    return rows.where(F.col("session_id").isNotNull() & F.col("text").isNotNull()).distinct()


@catalogue.add(
    sql=f"""WITH {_EDGES}, {PRESENT} SELECT e.* FROM edges e WHERE src <> dst
        AND EXISTS (SELECT 1 FROM people p WHERE p.session_id = e.session_id AND p.name = e.src)
        AND EXISTS (SELECT 1 FROM people p WHERE p.session_id = e.session_id AND p.name = e.dst)"""
)
def pairwise_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges_within(_edges(spark, sf), present_people(spark, sf))


@catalogue.add(
    sql=f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT session_id, src, dst FROM edges WHERE length(src) % 2 = 0
          UNION SELECT DISTINCT session_id, dst, src FROM edges WHERE length(src) % 2 = 0)
        SELECT e.* FROM edges e JOIN pairs USING (session_id, src, dst) WHERE coalesce(importance, 0) >= 40"""
)
def pair_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Relationships of asked pairs, in both directions, from a least importance on."""
    edges = _edges(spark, sf)
    asked = edges.where(F.length("src") % 2 == 0).select("session_id", "src", "dst")
    back = asked.select("session_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pair_edges(edges, asked.unionByName(back), 40)


@catalogue.add(
    sql=f"""WITH RECURSIVE {_EDGES}, {PRESENT}, strong AS (SELECT DISTINCT session_id, src, dst FROM edges WHERE coalesce(importance, 0) >= 75),
        reached AS (SELECT session_id, name AS node FROM people
          UNION SELECT s.session_id, s.dst FROM reached r JOIN strong s ON r.session_id = s.session_id AND r.node = s.src)
        SELECT * FROM reached"""
)
def closure_important(spark: SparkSession, sf: str) -> DataFrame:
    """Whom a session's scene characters reach over important relationships."""
    seeds = present_people(spark, sf).withColumnRenamed("name", "node")
    edges = _edges(spark, sf).where(is_important(F.col("importance")))
    return closure(seeds, edges, "session_id").select("session_id", "node")


_GROUPS = """orgs AS (SELECT session_id, entry_key, r.aliases AS aliases, r.events AS events, r.characters AS characters FROM (
  SELECT session_id, entry_key, arg_max({'aliases': aliases, 'events': events, 'characters': characters}, loaded_at) AS r FROM group_states t
  JOIN (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m USING (session_id, snapshot_seq) GROUP BY ALL))"""
_SAID = """said AS (SELECT DISTINCT session_id, context AS text FROM retrieval_contexts WHERE session_id IS NOT NULL AND context IS NOT NULL)"""
_L = r"(' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' ')"
_NAMED = f"""called AS (SELECT DISTINCT o.session_id, o.entry_key FROM (
    SELECT session_id, entry_key, entry_key AS name FROM orgs UNION SELECT session_id, entry_key, unnest(aliases) FROM orgs) o
  JOIN said s ON s.session_id = o.session_id AND contains({_L.format("s.text")}, {_L.format("o.name")}) AND trim({_L.format("o.name")}) <> ''),
relevant AS (SELECT session_id, entry_key FROM called UNION
  SELECT session_id, entry_key FROM (SELECT session_id, entry_key, unnest(map_keys(characters)) AS name FROM orgs) JOIN people USING (session_id, name))"""


def _group_names(groups: DataFrame) -> DataFrame:
    """Names by which groups are called: ``session_id``, ``entry_key``, ``name``, distinct."""
    names = groups.select("session_id", "entry_key", F.col("entry_key").alias("name")).unionByName(
        groups.select("session_id", "entry_key", F.explode("aliases").alias("name"))
    )
    return names.where(F.col("name").isNotNull()).distinct()


def _groups_of(groups: DataFrame, people: DataFrame) -> DataFrame:
    """Groups that have one of ``people`` as a member."""
    members = groups.select("session_id", "entry_key", F.explode(F.map_keys("characters")).alias("name"))
    return members.join(people, ["session_id", "name"], "left_semi").select("session_id", "entry_key")


def _relevant_groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    groups = latest(spark, sf, "group_states", ["aliases", "events", "characters"])
    people, said = present_people(spark, sf), contexts(spark, sf)
    called = whole_word_mentions(said, _group_names(groups), "session_id")
    found = called.select("session_id", "entry_key").unionByName(_groups_of(groups, people)).distinct()
    return groups, found


@catalogue.add(sql=f"WITH {_GROUPS}, {_SAID}, {PRESENT}, {_NAMED} SELECT session_id, entry_key FROM relevant")
def group_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _relevant_groups(spark, sf)[1]


def _scenes(spark: SparkSession, sf: str) -> DataFrame:
    metadata = table(spark, sf, "retrieval_contexts").select("session_id", F.explode("messages_metadata").alias("m"))
    scenes = metadata.select("session_id", F.col("m.scene_id").alias("scene"))
    return scenes.where(F.col("scene").isNotNull() & F.col("session_id").isNotNull()).distinct()


def _scenes_of(scenes: DataFrame, groups: DataFrame, relevant: DataFrame) -> DataFrame:
    """Scenes that ``relevant`` groups have among their events."""
    listed = groups.join(relevant, ["session_id", "entry_key"], "left_semi").select("session_id", F.explode("events").alias("scene"))
    return scenes.join(listed.distinct(), ["session_id", "scene"], "left_semi")


_SCENE_NAMES = """scenes AS (SELECT DISTINCT session_id, m.scene_id AS scene FROM (
  SELECT session_id, unnest(messages_metadata) AS m FROM retrieval_contexts) WHERE m.scene_id IS NOT NULL AND session_id IS NOT NULL)"""


@catalogue.add(
    sql=f"""WITH {_GROUPS}, {_SAID}, {PRESENT}, {_NAMED}, {_SCENE_NAMES}
        SELECT s.session_id, s.scene FROM scenes s JOIN said t ON s.session_id = t.session_id
          AND contains({_L.format("t.text")}, {_L.format("s.scene")}) AND trim({_L.format("s.scene")}) <> ''
        UNION SELECT s.session_id, s.scene FROM scenes s JOIN (
          SELECT session_id, unnest(events) AS scene FROM orgs JOIN relevant USING (session_id, entry_key)) e USING (session_id, scene)"""
)
def scene_relevance(spark: SparkSession, sf: str) -> DataFrame:
    scenes, said = _scenes(spark, sf), contexts(spark, sf)
    called = whole_word_mentions(said, scenes.withColumn("name", F.col("scene")), "session_id")
    in_groups = _scenes_of(scenes, *_relevant_groups(spark, sf))
    return called.select("session_id", "scene").unionByName(in_groups).distinct()


#: Sessions up to which their last snapshots are broadcast.
_MOST_BROADCAST = 200_000


def context_parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """``closure_important``, ``group_relevance`` and ``scene_relevance`` together.

    What they share is worked out once and written as tables, contexts are searched for names of groups and
    scenes at once, and each step is a small plan.
    """
    last = cut_lineage(delivered(spark, sf).groupBy("session_id").agg(F.max("snapshot_seq").alias("snapshot_seq")))
    few = last.count() <= _MOST_BROADCAST

    def newest(name: str, columns: list[str]) -> DataFrame:
        rows = table(spark, sf, name)
        # Rows of earlier snapshots go where they are read.
        kept = rows.join(F.broadcast(last), ["session_id", "snapshot_seq"], "left_semi") if few else rows
        return latest_entries(kept, columns, last)

    people, scenes = cut_lineage(present_people(spark, sf)), cut_lineage(_scenes(spark, sf))
    groups = cut_lineage(newest("group_states", ["aliases", "events", "characters"]))
    names = _group_names(groups).select("session_id", F.lit("groups").alias("part"), F.col("entry_key").alias("id"), "name")
    names = names.unionByName(scenes.select("session_id", F.lit("scenes").alias("part"), F.col("scene").alias("id"), F.col("scene").alias("name")))
    called = cut_lineage(whole_word_mentions(contexts(spark, sf), names, "session_id").select("session_id", "part", "id").distinct())
    called_in = lambda part, to: called.where(F.col("part") == part).select("session_id", F.col("id").alias(to))
    relevant = cut_lineage(called_in("groups", "entry_key").unionByName(_groups_of(groups, people)).distinct())
    shown = cut_lineage(called_in("scenes", "scene").unionByName(_scenes_of(scenes, groups, relevant)).distinct())
    edges = relationship_edges(newest("character_states", ["relationships"])).where(is_important(F.col("importance")))
    reached = closure(people.withColumnRenamed("name", "node"), edges, "session_id").select("session_id", "node")
    return {"closure_important": reached, "group_relevance": relevant, "scene_relevance": shown}


def _customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.to_json(
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("market"),
            F.array(F.struct(F.col("c_custkey").cast("string").alias("id")), F.struct(F.lit("none").alias("id"))).alias("refs"),
        )
    )
    return table(spark, sf, "customer").select("c_custkey", doc.alias("doc"))


_LEAVES = """leaves AS (
  SELECT c_custkey, 'name' AS path, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'market.nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 'market.segment', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'refs.0.id', c_custkey::VARCHAR FROM customer
  UNION ALL SELECT c_custkey, 'refs.1.id', 'none' FROM customer)"""


@catalogue.add(sql=f"WITH {_LEAVES} SELECT * FROM leaves")
def leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = leaf_table(_customer_documents(spark, sf), ["c_custkey"], "doc")
    return rows.select("c_custkey", path_text(F.col("path")).alias("path"), "value")


@catalogue.add()
def record_leaves(spark: SparkSession, sf: str) -> DataFrame:
    records = table(spark, sf, "kb_records").select("record_id", "subject", object_text(F.col("doc")).alias("doc"))
    rows = leaf_table(records, ["record_id", "subject"], "doc")
    return rows.select("record_id", "subject", path_text(F.col("path")).alias("path"), "ord", "value").distinct()


@catalogue.add(sql="SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def path_get(spark: SparkSession, sf: str) -> DataFrame:
    rows = leaf_table(table(spark, sf, "events"), ["event_id"], "props")
    return get_path(rows, ["k"]).select("event_id", "value")


@catalogue.add(
    sql=f"""WITH {_LEAVES} SELECT c_custkey, string_split(path, '.')[1] AS child, count(*) AS n_leaves FROM leaves GROUP BY ALL"""
)
def list_children(spark: SparkSession, sf: str) -> DataFrame:
    return child_counts(leaf_table(_customer_documents(spark, sf), ["c_custkey"], "doc"), ["c_custkey"], [])


_PATTERNS = ("brunella", "company", "guild", "captain brunella of the guild")
_KEYS = """keys AS (SELECT session_id, entry_key, arg_max(entry_ord, loaded_at) AS ord FROM group_states t
  JOIN (SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m USING (session_id, snapshot_seq) GROUP BY ALL)"""


def _fuzzy_sql(fits: str) -> str:
    values = ", ".join(f"('{p}')" for p in _PATTERNS)
    return f"""WITH {_KEYS}, patterns(pattern) AS (VALUES {values})
        SELECT session_id, pattern, first(entry_key ORDER BY lower(entry_key) <> pattern, ord, entry_key) AS matched
        FROM keys, patterns WHERE entry_key <> '' AND ({fits}) GROUP BY ALL"""


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf, "group_states", ["entry_ord"])


@catalogue.add(sql=_fuzzy_sql("contains(lower(entry_key), pattern) OR contains(pattern, lower(entry_key))"))
def path_get_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy_key(_keys(spark, sf), ["session_id"], "entry_key", "entry_ord", list(_PATTERNS), both_ways=True)


@catalogue.add(sql=_fuzzy_sql("contains(lower(entry_key), pattern)"))
def path_get_template(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy_key(_keys(spark, sf), ["session_id"], "entry_key", "entry_ord", list(_PATTERNS), both_ways=False)


@catalogue.add(
    sql=f"""WITH {_LEAVES}, terms(term) AS (VALUES ('segment'), ('auto'), ('none'), ('name')),
        steps AS (SELECT DISTINCT c_custkey, array_to_string(ps[1:i], '.') AS path, lower(ps[i]) AS text, CASE WHEN i = len(ps) THEN value END AS value
          FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, string_split(path, '.') AS ps FROM leaves))),
        hits AS (SELECT term, c_custkey, path, value, 'key' AS matched_on FROM steps, terms WHERE contains(text, term)
          UNION ALL SELECT term, c_custkey, path, value, 'value' FROM leaves, terms WHERE contains(lower(value), term)),
        best AS (SELECT term, c_custkey, path, min(value) AS value, min(matched_on) AS matched_on FROM hits GROUP BY term, c_custkey, path)
        SELECT term, c_custkey, path, value, matched_on, total_found FROM (
          SELECT *, count(*) OVER (PARTITION BY term) AS total_found, row_number() OVER (PARTITION BY term ORDER BY c_custkey, path) AS n FROM best)
        WHERE n <= 10"""
)
def search_kb(spark: SparkSession, sf: str) -> DataFrame:
    rows = leaf_table(_customer_documents(spark, sf), ["c_custkey"], "doc")
    return search(rows, ["c_custkey"], ["segment", "auto", "none", "name"])


@catalogue.add(
    sql=f"""WITH {_LEAVES}, sums AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1),
        odd AS (SELECT * FROM sums WHERE k % 2 = 1)
        SELECT c_custkey, path, value FROM leaves l
          WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.c_custkey = l.c_custkey AND path LIKE 'market.%')
            AND NOT (path = 'name' AND EXISTS (SELECT 1 FROM sums WHERE sums.c_custkey = l.c_custkey))
        UNION ALL SELECT c_custkey, 'name', s FROM sums
        UNION ALL SELECT c_custkey, 'market', 'closed' FROM odd"""
)
def set_path_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = leaf_table(_customer_documents(spark, sf), ["c_custkey"], "doc").select("c_custkey", "path", "value")
    orders = table(spark, sf, "orders")
    status = orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.array(F.lit("name")).alias("path"), F.col("o_orderstatus").alias("value")
    )
    last = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("seq")).where(F.col("seq") % 2 == 1)
    closed = last.select("c_custkey", "seq", F.array(F.lit("market")).alias("path"), F.lit("closed").alias("value"))
    done = apply_patches(rows, status.unionByName(closed), ["c_custkey"])
    return done.select("c_custkey", path_text(F.col("path")).alias("path"), "value")


@catalogue.add(
    sql="""SELECT vec_id, (i - 1)::INT AS place, embedding[i]::DOUBLE AS value
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""
)
def list_expand(spark: SparkSession, sf: str) -> DataFrame:
    rows = expand_list(table(spark, sf, "embeddings"), ["vec_id"], "embedding")
    return rows.withColumn("value", F.col("value").cast("double"))


@catalogue.add(sql="SELECT vec_id, len(embedding)::INT AS n_items, round(embedding[1]::DOUBLE + embedding[-1]::DOUBLE, 6) AS ends FROM embeddings")
def list_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack_list(expand_list(table(spark, sf, "embeddings"), ["vec_id"], "embedding"), ["vec_id"])
    first, last = F.element_at("items", 1).cast("double"), F.element_at("items", -1).cast("double")
    return packed.select("vec_id", F.size("items").alias("n_items"), F.round(first + last, 6).alias("ends"))


@catalogue.add(
    sql="""SELECT d.doc_id, coalesce(l.label, 'unlabelled') AS label, coalesce(l.labelled_by, '') AS labelled_by, coalesce(d.lang, 'und') AS lang
        FROM documents d LEFT JOIN doc_labels l USING (doc_id)"""
)
def default_fill(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "doc_labels"), "doc_id", "left")
    return joined.select("doc_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("label", "unlabelled"), ("labelled_by", ""), ("lang", "und"))])


@catalogue.add(
    sql="""SELECT doc_id, array_to_string(e[1:3], '; ') AS errors, len(e)::INT AS n_errors FROM (
          SELECT doc_id, list_filter([CASE WHEN NOT coalesce(lang IN ('en', 'de', 'es'), false) THEN 'lang: not one of en, de, es' END,
            CASE WHEN text IS NULL THEN 'text: missing' END,
            CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'n_chars: not the length of text' END,
            CASE WHEN source IS NULL THEN 'source: missing' END], lambda x: x IS NOT NULL) AS e FROM documents) WHERE len(e) > 0"""
)
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    rules = {
        "lang: not one of en, de, es": F.col("lang").isin("en", "de", "es"),
        "text: missing": F.col("text").isNotNull(),
        "n_chars: not the length of text": F.col("n_chars") == F.length("text"),
        "source: missing": F.col("source").isNotNull(),
    }
    return violations(table(spark, sf, "documents"), ["doc_id"], rules)


@catalogue.add(
    sql=f"""WITH {_GROUPS}, people AS (SELECT DISTINCT session_id, entry_key AS name FROM character_states t JOIN (
          SELECT session_id, max(snapshot_seq) AS snapshot_seq FROM (SELECT session_id, snapshot_seq FROM character_states UNION ALL
            SELECT session_id, snapshot_seq FROM group_states) GROUP BY 1) m USING (session_id, snapshot_seq))
        SELECT DISTINCT o.session_id, o.name FROM (
        SELECT session_id, unnest(map_keys(characters)) AS name FROM orgs) o
        WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.session_id = o.session_id AND p.name = o.name)"""
)
def add_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    groups = latest(spark, sf, "group_states", ["characters"])
    people = latest(spark, sf, "character_states", ["entry_ord"])
    named = groups.select("session_id", F.explode(F.map_keys("characters")).alias("name")).distinct()
    return named.join(people.select("session_id", F.col("entry_key").alias("name")), ["session_id", "name"], "left_anti")


_COSINE = """round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) /
  (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), {0})"""


def _topk_sql(part: str) -> str:
    return f"""SELECT query_id, vec_id, {"label, " if part else ""}place, round(score, 6) AS score FROM (
        SELECT *, (row_number() OVER (PARTITION BY query_id {part} ORDER BY round(score, 9) DESC, vec_id))::INT AS place FROM (
          SELECT q.vec_id AS query_id, v.vec_id, v.label, {_COSINE.format(12)} AS score FROM embeddings q, embeddings v
          WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE place <= 5"""


def _query_set(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    return vectors.where(F.col("vec_id") % 100 == 0), vectors


@catalogue.add(sql=_topk_sql(""))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_topk(*_query_set(spark, sf), k=5)


@catalogue.add(sql=_topk_sql(", label"))
def vector_topk_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_topk(*_query_set(spark, sf), k=5, per="label")
