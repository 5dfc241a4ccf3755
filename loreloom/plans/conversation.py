"""Queries on messages, chunks, mentions and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import (
    FENCES,
    INTRODUCTIONS,
    TITLE_WORDS,
    command_flags,
    escape_html,
    fill_template,
    has_quote,
    mark_field,
    meaningful_paragraphs,
    node_parts,
    patches_of,
    path_tokens,
    preview,
    references,
    slug,
    strip_fences,
    strip_markers,
    strip_prefixes,
    strip_thinking,
    title_of_id,
    tool_call,
)
from loreloom.operators.conversation import (
    delete_chunks,
    first_by_text,
    interval_tags,
    last_exchanges,
    last_messages,
    messages_of,
    numbered_backwards,
    paragraph_chunks,
    running_counter,
    sentence_chunks,
    tag_chunks,
    upsert_chunks,
)
from loreloom.operators.mentions import (
    entity_lists,
    loose_mentions,
    referred_tokens,
    speaker_lines,
    speakers_among,
    tag_references,
    union_in_order,
    whole_word_mentions,
)
from loreloom.plans.registry import Catalogue
from loreloom.sources.tables import table

catalogue = Catalogue()


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return messages_of(table(spark, sf, "retrieval_contexts"), "context_id", "messages")


CONV = r"""conv AS (
  SELECT DISTINCT context_id AS conv_id, (i - 1)::INT AS message_idx, ((i - 1) // 2)::INT AS exchange_idx,
         CASE WHEN (i - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, messages[i] AS text
  FROM (SELECT context_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts)
  WHERE messages[i] IS NOT NULL)"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PARA = rf"""{CONV}, para AS (
  SELECT conv_id, message_idx, j::INT AS paragraph_idx, ps[j] AS paragraph
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j
        FROM (SELECT conv_id, message_idx,
              list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ps
              FROM conv)))"""
CHUNKS = rf"""{PARA}, chunks AS (
  SELECT conv_id, concat_ws('_', message_idx, paragraph_idx, k) AS node, message_idx, paragraph_idx, k::INT AS sentence_idx, ss[k] AS text
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k
        FROM (SELECT conv_id, message_idx, paragraph_idx,
              list_filter(list_transform(string_split(regexp_replace(paragraph, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                          lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS ss
              FROM para)))"""


@catalogue.add(sql=f"WITH {CONV} SELECT conv_id, message_idx, exchange_idx, role, length(text)::INT AS n_chars FROM conv")
def message_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations(spark, sf)
    return rows.select("conv_id", "message_idx", "exchange_idx", "role", F.length("text").alias("n_chars"))


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx, exchange_idx, role, text FROM (
        SELECT *, max(exchange_idx) OVER (PARTITION BY conv_id) AS last FROM conv) WHERE exchange_idx > last - 6"""
)
def last_x_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    return last_exchanges(conversations(spark, sf), 6)


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx,
        (row_number() OVER (PARTITION BY conv_id ORDER BY message_idx DESC))::INT || '. ''' || role || ''' >> ' || text AS line
        FROM conv WHERE trim(text) <> ''"""
)
def dialogue_numbering(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered_backwards(conversations(spark, sf))
    line = fill_template("{n}. '{role}' >> ", {"n": F.col("number").cast("string"), "role": F.col("role")})
    return rows.select("conv_id", "message_idx", F.concat(line, F.col("text")).alias("line"))


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx, role, left(text, 500) AS text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY message_idx DESC) AS n FROM conv) WHERE n <= 4"""
)
def scene_probe_window(spark: SparkSession, sf: str) -> DataFrame:
    return last_messages(conversations(spark, sf), 4, 500).select("conv_id", "message_idx", "role", "text")


@catalogue.add(sql=f"WITH {PARA} SELECT conv_id, message_idx, paragraph_idx, paragraph FROM para")
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return paragraph_chunks(conversations(spark, sf))


@catalogue.add(sql=f"WITH {CHUNKS} SELECT conv_id, node, message_idx, paragraph_idx, sentence_idx, text FROM chunks")
def chunk_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_chunks(conversations(spark, sf))


_META = """meta AS (
  SELECT context_id AS conv_id, (i - 1)::INT AS ord, messages_metadata[i] AS m
  FROM (SELECT context_id, messages_metadata, unnest(range(1, len(messages_metadata) + 1)) AS i FROM retrieval_contexts)
  WHERE messages_metadata[i] IS NOT NULL)"""


def metadata_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "retrieval_contexts").select(
        F.col("context_id").alias("conv_id"), F.posexplode("messages_metadata").alias("ord", "m")
    )
    return rows.where(F.col("m").isNotNull())


@catalogue.add(
    sql=f"""WITH {_META} SELECT DISTINCT conv_id, ord, m.id AS node, try_cast(split_part(m.id, '_', 1) AS INT) AS msg,
        try_cast(nullif(split_part(m.id, '_', 2), '') AS INT) AS para, try_cast(nullif(split_part(m.id, '_', 3), '') AS INT) AS sent
        FROM meta"""
)
def node_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = metadata_rows(spark, sf)
    return rows.select("conv_id", "ord", F.col("m.id").alias("node"), node_parts(F.col("m.id")).alias("p")).select(
        "conv_id", "ord", "node", "p.*"
    ).distinct()


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """What was said of whom in a session: ``session_id``, ``about``, ``text``, distinct."""
    rows = table(spark, sf, "character_states")
    said = rows.select("session_id", F.col("entry_key").alias("about"), F.explode("description").alias("text"))
    return said.where(F.col("text").isNotNull()).distinct()


def _names(spark: SparkSession, sf: str, source: str) -> DataFrame:
    rows = table(spark, sf, source).where(F.col("session_id").isNotNull() & F.col("entry_key").isNotNull())
    return rows.select("session_id", F.col("entry_key").alias("name")).distinct()


_LOOSE = r"(' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' ')"
_NAMES = "names AS (SELECT DISTINCT session_id, entry_key AS name FROM character_states)"
_TEXTS = """texts AS (SELECT DISTINCT session_id, about, text FROM (
  SELECT session_id, entry_key AS about, unnest(description) AS text FROM character_states) WHERE text IS NOT NULL)"""


@catalogue.add(
    sql=f"""WITH {_TEXTS}, {_NAMES} SELECT session_id, about, text, name FROM texts JOIN names USING (session_id)
        WHERE contains({_LOOSE.format("text")}, {_LOOSE.format("name")}) AND trim({_LOOSE.format("name")}) <> ''"""
)
def mention_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = whole_word_mentions(statements(spark, sf), _names(spark, sf, "character_states"), "session_id")
    return found.select("session_id", "about", "text", "name")


_WORDS = r"string_split_regex(trim(lower(name)), '\s+')"


@catalogue.add(
    sql=f"""WITH {_TEXTS}, {_NAMES} SELECT session_id, about, text, name FROM texts JOIN names USING (session_id)
        WHERE trim(name) <> '' AND (contains(lower(text), lower(name)) OR contains(lower(text), {_WORDS}[1])
              OR contains(lower(text), {_WORDS}[-1]))"""
)
def mention_filter_loose(spark: SparkSession, sf: str) -> DataFrame:
    found = loose_mentions(statements(spark, sf), _names(spark, sf, "character_states"), "session_id")
    return found.select("session_id", "about", "text", "name")


@catalogue.add(
    sql=f"""WITH {_TEXTS}, {_NAMES} SELECT session_id, about, text, array_to_string(list_sort(list(DISTINCT name)), '|') AS entities
        FROM texts JOIN names USING (session_id)
        WHERE contains({_LOOSE.format("text")}, {_LOOSE.format("name")}) AND trim({_LOOSE.format("name")}) <> ''
        GROUP BY session_id, about, text"""
)
def entity_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return entity_lists(mention_filter(spark, sf), ["session_id", "about", "text"], "name")


#: Every spelling and alias by which a session's entries are called, with the place of the entry.
CALLED = """called AS (
  SELECT session_id, speaker, name, min(ord) AS ord FROM (
    SELECT session_id, entry_key AS speaker, entry_key AS name, entry_ord AS ord FROM character_states
    UNION ALL SELECT session_id, entry_key, entry_key, 1000000 + entry_ord FROM group_states
    UNION ALL SELECT session_id, entry_key, unnest(aliases), 1000000 + entry_ord FROM group_states)
  WHERE session_id IS NOT NULL AND speaker IS NOT NULL AND name IS NOT NULL GROUP BY ALL)"""
SAYING = """saying AS (SELECT DISTINCT context_id, session_id, (i - 1)::INT AS message_idx, messages[i] AS text FROM (
  SELECT context_id, session_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts)
  WHERE session_id IS NOT NULL AND messages[i] IS NOT NULL)"""


def called_names(spark: SparkSession, sf: str) -> DataFrame:
    people, groups = table(spark, sf, "character_states"), table(spark, sf, "group_states")
    later = F.col("entry_ord") + 1_000_000
    rows = (
        people.select("session_id", F.col("entry_key").alias("speaker"), F.col("entry_key").alias("name"), F.col("entry_ord").alias("ord"))
        .unionByName(groups.select("session_id", F.col("entry_key").alias("speaker"), F.col("entry_key").alias("name"), later.alias("ord")))
        .unionByName(groups.select("session_id", F.col("entry_key").alias("speaker"), F.explode("aliases").alias("name"), later.alias("ord")))
    )
    rows = rows.where(F.col("session_id").isNotNull() & F.col("speaker").isNotNull() & F.col("name").isNotNull())
    return rows.groupBy("session_id", "speaker", "name").agg(F.min("ord").alias("ord"))


def session_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "retrieval_contexts").where(F.col("session_id").isNotNull())
    listed = rows.select("context_id", "session_id", F.posexplode("messages").alias("message_idx", "text"))
    return listed.where(F.col("text").isNotNull()).distinct()


@catalogue.add(
    sql=rf"""WITH {CALLED}, {SAYING}, lines AS (
          SELECT context_id, session_id, message_idx, i::INT AS line_no, lower(regexp_extract(ls[i], '^[\t-\r ]*([^:]*?)[\t-\r ]*:', 1)) AS name FROM (
            SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM saying))),
        known AS (SELECT session_id, lower(trim(name)) AS name, arg_min(speaker, (ord, speaker)) AS speaker FROM called GROUP BY ALL)
        SELECT context_id, message_idx, line_no, speaker FROM lines JOIN known USING (session_id, name) WHERE name <> ''"""
)
def speaker_line(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of messages that open with a name or alias known in their session."""
    return speaker_lines(session_messages(spark, sf), called_names(spark, sf), ["context_id", "message_idx"], "text", "session_id")


@catalogue.add(
    sql="""WITH m AS (SELECT DISTINCT context_id, i, messages_metadata[i] AS m FROM (
          SELECT context_id, messages_metadata, unnest(range(1, len(messages_metadata) + 1)) AS i FROM retrieval_contexts) WHERE messages_metadata[i] IS NOT NULL),
        met AS (SELECT context_id, m.paragraph_idx AS para, unnest(list_intersect(m.speakers, m.characters_present)) AS name FROM m)
        SELECT p.context_id, p.para, string_agg(DISTINCT name, '|' ORDER BY name) AS speakers
        FROM (SELECT DISTINCT context_id, m.paragraph_idx AS para FROM m WHERE m.paragraph_idx IS NOT NULL) p LEFT JOIN met USING (context_id, para) GROUP BY ALL"""
)
def paragraph_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct speakers of each paragraph number that are also present in the same sentence."""
    rows = metadata_rows(spark, sf).select(
        F.col("conv_id").alias("context_id"), F.col("m.paragraph_idx").alias("para"), "ord", "m.speakers", "m.characters_present"
    )
    rows = rows.where(F.col("para").isNotNull()).distinct()
    key = ["context_id", "para", "ord"]
    said = rows.select(*key, F.explode("speakers").alias("speaker")).where(F.col("speaker").isNotNull())
    there = rows.select(*key, F.explode("characters_present").alias("name")).distinct()
    met = speakers_among(rows, said, there, key)
    names = met.select("context_id", "para", F.explode_outer(F.split("speakers", r"\|")).alias("name"))
    return names.groupBy("context_id", "para").agg(
        F.nullif(F.array_join(F.array_sort(F.collect_set("name")), "|"), F.lit("")).alias("speakers")
    )


@catalogue.add(
    sql=f"""WITH {CHUNKS} SELECT conv_id, count(*) AS n_sentences, count(*) FILTER (regexp_matches(text, '["''“”‘’]')) AS n_quoted
        FROM chunks GROUP BY conv_id"""
)
def quoted_sentences(spark: SparkSession, sf: str) -> DataFrame:
    rows = sentence_chunks(conversations(spark, sf))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(has_quote(F.col("text"))).alias("n_quoted")
    )


_SCENES = """scenes AS (
  SELECT DISTINCT conv_id, 'scene ' || (message_idx // 3) AS name, (message_idx // 3)::INT AS ord,
         (message_idx // 3 * 3)::INT AS lo, (message_idx // 3 * 3 + 3)::INT AS hi FROM conv)"""


def _scenes(messages: DataFrame) -> DataFrame:
    """Scenes of three messages that share their last message with the next scene."""
    number = F.floor(F.col("message_idx") / 3).cast("int")
    return messages.select(
        "conv_id",
        F.concat(F.lit("scene "), number.cast("string")).alias("name"),
        number.alias("ord"),
        (number * 3).alias("lo"),
        (number * 3 + 3).alias("hi"),
    ).distinct()


@catalogue.add(
    sql=f"""WITH {CONV}, {_SCENES} SELECT c.conv_id, c.message_idx, arg_max(s.name, s.ord) AS tag
        FROM conv c LEFT JOIN scenes s ON c.conv_id = s.conv_id AND c.message_idx BETWEEN s.lo AND s.hi GROUP BY ALL"""
)
def interval_tagging(spark: SparkSession, sf: str) -> DataFrame:
    messages = conversations(spark, sf)
    return interval_tags(messages.select("conv_id", "message_idx"), _scenes(messages), "conv_id", "message_idx")


@catalogue.add(
    sql="""WITH spans AS (
          SELECT user_id, event_type AS name, min(event_id) AS ord, min(hour(ts))::INT AS lo, max(hour(ts))::INT AS hi FROM events GROUP BY ALL)
        SELECT e.event_id, arg_max(s.name, s.ord) AS tag FROM events e
        LEFT JOIN spans s ON e.user_id = s.user_id AND hour(e.ts) BETWEEN s.lo AND s.hi GROUP BY ALL"""
)
def interval_tagging_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("hour", F.hour("ts"))
    spans = events.groupBy("user_id", F.col("event_type").alias("name")).agg(
        F.min("event_id").alias("ord"), F.min("hour").alias("lo"), F.max("hour").alias("hi")
    )
    return interval_tags(events.select("event_id", "user_id", "hour"), spans, "user_id", "hour").select("event_id", "tag")


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx,
          (1 + sum(CASE WHEN length(text) > 300 THEN 1 ELSE 0 END) OVER w)::BIGINT AS scene_number,
          (1 + sum(CASE WHEN length(text) > 1200 THEN 1 ELSE 0 END) OVER w)::BIGINT AS chapter_number
        FROM conv WINDOW w AS (PARTITION BY conv_id ORDER BY message_idx ROWS UNBOUNDED PRECEDING)"""
)
def scene_counter(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations(spark, sf)
    rows = running_counter(rows, ["conv_id"], "message_idx", F.length("text") > 300, "scene_number")
    rows = running_counter(rows, ["conv_id"], "message_idx", F.length("text") > 1200, "chapter_number")
    return rows.select("conv_id", "message_idx", "scene_number", "chapter_number")


@catalogue.add(sql="SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return first_by_text(table(spark, sf, "documents").select("doc_id", "text"), [], "text", "doc_id")


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, text, min(message_idx) AS message_idx FROM conv GROUP BY ALL"""
)
def dedup_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = conversations(spark, sf).select("conv_id", "message_idx", "text")
    return first_by_text(rows, ["conv_id"], "text", "message_idx")


SUMMARIES = """summaries AS (
  SELECT DISTINCT context_id AS conv_id, (i - 1) || '_summary' AS node, (i - 1)::INT AS message_idx, messages[i] AS text
  FROM (SELECT context_id, messages, messages_metadata, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts)
  WHERE messages[i] IS NOT NULL AND messages_metadata[i].is_summary)"""
_KEPT = f"""{CHUNKS}, {SUMMARIES}, stored AS (SELECT conv_id, node, message_idx, text, 'old' AS state FROM chunks),
    fresh AS (SELECT *, 'new' AS state FROM summaries)"""
_UNTOUCHED = """SELECT * FROM stored s WHERE NOT EXISTS (
        SELECT 1 FROM fresh f WHERE f.conv_id = s.conv_id AND f.message_idx = s.message_idx)"""


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The whole texts of the messages whose metadata calls them summaries, distinct."""
    rows = table(spark, sf, "retrieval_contexts").select(
        F.col("context_id").alias("conv_id"), F.posexplode("messages").alias("message_idx", "text"), "messages_metadata"
    )
    rows = rows.where(F.col("text").isNotNull() & F.get("messages_metadata", F.col("message_idx"))["is_summary"])
    node = F.concat(F.col("message_idx").cast("string"), F.lit("_summary"))
    return rows.select("conv_id", node.alias("node"), "message_idx", "text").distinct()


def _stored_and_summaries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    stored = sentence_chunks(conversations(spark, sf)).select("conv_id", "node", "message_idx", "text", F.lit("old").alias("state"))
    return stored, summaries(spark, sf).withColumn("state", F.lit("new"))


@catalogue.add(sql=f"WITH {_KEPT} {_UNTOUCHED} UNION ALL SELECT * FROM fresh")
def upsert_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return upsert_chunks(*_stored_and_summaries(spark, sf), ["conv_id", "message_idx"])


@catalogue.add(sql=f"WITH {_KEPT} {_UNTOUCHED}")
def delete_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return delete_chunks(*_stored_and_summaries(spark, sf), ["conv_id", "message_idx"])


@catalogue.add(
    sql=f"""WITH {_KEPT} SELECT s.conv_id, s.node, s.message_idx, coalesce(f.state, s.state) AS state
        FROM stored s LEFT JOIN fresh f ON f.conv_id = s.conv_id AND f.message_idx = s.message_idx"""
)
def tag_chunk(spark: SparkSession, sf: str) -> DataFrame:
    stored, fresh = _stored_and_summaries(spark, sf)
    return tag_chunks(stored.drop("text"), fresh, ["conv_id", "message_idx"], ["state"])


@catalogue.add(sql=f"WITH {SUMMARIES} SELECT *, 'System' AS speaker, true AS is_summary FROM summaries")
def summary_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(spark, sf).select("*", F.lit("System").alias("speaker"), F.lit(True).alias("is_summary"))


_LEFT_TRIM = r"regexp_replace({0}, '^[\t-\r ]+', '')"


@catalogue.add(
    sql=f"""WITH {CONV} SELECT conv_id, message_idx, {_LEFT_TRIM.format("text")} AS closed, '' AS unclosed, {_LEFT_TRIM.format("text")} AS lone,
          {_LEFT_TRIM.format("text")} AS named, text AS bare FROM conv"""
)
def strip_thoughts(spark: SparkSession, sf: str) -> DataFrame:
    """Each message after thoughts with text before them, after an open mark, after a lone closing one, after named marks, and bare."""
    number = F.col("message_idx").cast("string")
    return conversations(spark, sf).select(
        "conv_id",
        "message_idx",
        strip_thinking(F.concat(F.lit("Well <think>"), number, F.lit("</think> \n"), "text")).alias("closed"),
        strip_thinking(F.concat(F.col("text"), F.lit("<ns:think>"), F.col("text"))).alias("unclosed"),
        strip_thinking(F.concat(number, F.lit("</think>"), "text")).alias("lone"),
        strip_thinking(F.concat(F.lit("a<ns:think>b</ns:think>"), F.col("text"))).alias("named"),
        strip_thinking(F.col("text")).alias("bare"),
    )


def _fence_sql(text: str) -> str:
    hit = lambda pattern: f"CASE WHEN regexp_matches({text}, '{pattern}') THEN regexp_extract({text}, '{pattern}', 1) END"
    patterns = [f"(?ms){p}" for p in FENCES]
    return f"coalesce({', '.join(hit(p) for p in patterns)}, {text})"


@catalogue.add(
    sql=f"""SELECT doc_id, {_fence_sql("fenced")} AS fenced, {_fence_sql("quoted")} AS quoted, {_fence_sql("bare")} AS bare
        FROM (SELECT doc_id, '```json' || chr(10) || text || chr(10) || '```' AS fenced, '\"\"\"' || text || '\"\"\"' AS quoted, text AS bare
              FROM documents WHERE text IS NOT NULL)"""
)
def strip_fence(spark: SparkSession, sf: str) -> DataFrame:
    """Every text that is not null, as it stands: within fences, within triple quotes and bare."""
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return rows.select(
        "doc_id",
        strip_fences(F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).alias("fenced"),
        strip_fences(F.concat(F.lit('"""'), "text", F.lit('"""'))).alias("quoted"),
        strip_fences(F.col("text")).alias("bare"),
    )


@catalogue.add(sql="SELECT doc_id, source || chr(10) || coalesce(section, '') AS text FROM documents WHERE source IS NOT NULL")
def strip_marker(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.col("source").isNotNull())
    marked = mark_field(F.col("source"), F.lit("documents.source"))
    section = mark_field(F.coalesce("section", F.lit("")), F.lit("documents.section"))
    return rows.select("doc_id", strip_markers(F.concat(marked, F.lit("\n"), section)).alias("text"))


_W = r"[\t-\r ]"
_BARE = r"regexp_replace({0}, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"


def _few_sql(block: str) -> str:
    return f"len(list_filter(string_split_regex({block}, '{_W}+'), lambda w: w <> '')) < {TITLE_WORDS}"


_INSIDE = _BARE.format("substr(p, 3, greatest(length(p) - 4, 0))")
_INTRODUCED = "t"
for _introduction in INTRODUCTIONS:
    _INTRODUCED = f"regexp_replace({_INTRODUCED}, '(?i)^{_introduction.replace(chr(39), chr(39) * 2)}{_W}*', '')"
_MEANING_SQL = rf"""WITH bare AS (SELECT doc_id, {_BARE.format("text")} AS t FROM documents WHERE text IS NOT NULL),
  unwrapped AS (SELECT doc_id, CASE WHEN t LIKE '"%' AND t LIKE '%"' THEN {_BARE.format("substr(t, 2, greatest(length(t) - 2, 0))")} ELSE t END AS t FROM bare),
  introduced AS (SELECT doc_id, {_BARE.format(_INTRODUCED)} AS t FROM unwrapped),
  cut AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split_regex(t, '\n{_W}*\n+'), lambda b: {_BARE.format("b")}), lambda b: b <> ''),
            lambda b: regexp_replace(b, '^{_W}*[*-]{_W}*\*\*([^\n]*?)\*\*:{_W}*', '')) AS blocks FROM introduced)
  SELECT doc_id, array_to_string(list_filter(blocks, lambda p: NOT ((p LIKE '**%' AND p LIKE '%**' AND ({_few_sql(_INSIDE)} OR {_INSIDE} LIKE '%:'))
    OR ({_few_sql("p")} AND p LIKE '%:'))), chr(10) || chr(10)) AS text FROM cut"""


@catalogue.add(sql=_MEANING_SQL)
def meaningful_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return rows.select("doc_id", meaningful_paragraphs(F.col("text")).alias("text"))


@catalogue.add(
    sql=rf"""WITH {CONV} SELECT conv_id, message_idx, message_idx % 3 = 0 AS is_scene, message_idx % 3 = 1 AS is_chapter,
          message_idx % 3 = 2 AS is_arc, ltrim(regexp_replace(regexp_replace(text, '(?i)^The\s*', ''), '(?i)^"\s*', ''), ' ') AS rest
        FROM conv"""
)
def banned_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("SCENE"), F.lit("CHAPTER"), F.lit("ARC")), (F.col("message_idx") % 3 + 1).cast("int"))
    rows = conversations(spark, sf)
    stripped = strip_prefixes(F.col("text"), ["The", '"'])
    parts = command_flags(F.concat(F.lit("NEXT "), kind, F.lit(":"), stripped))
    return rows.select("conv_id", "message_idx", *[c.alias(n) for n, c in parts.items()])


@catalogue.add(
    sql="""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
          replace(lower(source), ' ', '_') AS slug FROM documents"""
)
def preview_truncate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents")
    return rows.select(
        "doc_id",
        preview(F.col("text")).alias("preview"),
        slug(F.col("source")).alias("slug"),
    )


@catalogue.add(
    sql="""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe
        FROM documents"""
)
def escape_whole(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", escape_html(F.col("text")).alias("safe"))


@catalogue.add(
    sql="""SELECT event_id, 'kb.' || event_type AS name, CASE WHEN event_type = 'error' THEN '{}' ELSE props END AS arguments FROM events"""
)
def tool_call_parse(spark: SparkSession, sf: str) -> DataFrame:
    body = F.when(F.col("event_type") == "view", F.regexp_replace("props", r"^\{|\}$", "")).when(
        F.col("event_type") == "error", F.lit("{broken")
    ).otherwise(F.col("props"))
    text = F.concat(
        F.lit("I look it up. <tool_call>name: kb."), "event_type", F.lit("\narguments: "), body, F.lit("</tool_call><tool_call>name: x</tool_call>")
    )
    return table(spark, sf, "events").select("event_id", tool_call(text).alias("call")).select("event_id", "call.*")


@catalogue.add(
    sql="""SELECT event_id, path, value, kind FROM (
          SELECT event_id, event_type, 'user.' || user_id AS path, value::VARCHAR AS value, 'float' AS kind FROM events
          UNION ALL SELECT event_id, event_type, 'props', replace(props, ' ', ''), 'dict' FROM events WHERE event_type IN ('signup', 'click')
          UNION ALL SELECT event_id, event_type, 'kind', '"' || event_type || '"', 'string' FROM events
          UNION ALL SELECT event_id, event_type, 'seen', 'true', 'boolean' FROM events)
        WHERE event_type <> 'error' AND (event_type NOT IN ('signup', 'click') OR path = 'props')"""
)
def patch_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Patches of answers in lines, as a fenced list after thoughts (one item is no patch), as one object, and of NO."""
    lines = F.concat(
        F.lit("path: user."), F.col("user_id").cast("string"), F.lit(", value: "), F.col("value").cast("string"),
        F.lit("\npath: seen, value: True"),
        F.lit("\npath: kind, value: "), "event_type", F.lit("\nEND_OF_UPDATES"),
    )
    item = F.concat(F.lit('{"path": "props", "value": '), "props", F.lit("}"))
    listed = F.concat(F.lit("<think>hm</think>```json\n["), item, F.lit(', {"path": 3, "value": 1}, {"path": "x"}, 4]\n``` END_OF_UPDATES'))
    kind = F.col("event_type")
    answer = F.when(kind == "error", F.lit(" NO ")).when(kind == "signup", listed).when(kind == "click", item).otherwise(lines)
    return table(spark, sf, "events").select("event_id", F.inline(patches_of(answer)))


@catalogue.add(
    sql="""SELECT event_id, event_type || '|' || user_id || '|k|0|x y' AS steps, 1 AS n_refs, 'Phase Of ' || upper(left(event_type, 1)) || substr(event_type, 2) AS title FROM events"""
)
def path_steps(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    path = F.concat("event_type", F.lit("["), user, F.lit("].k[0][\"x y\"]"))
    steps = F.array_join(path_tokens(path), "|")
    template = F.concat(F.lit("See {subjects."), "event_type", F.lit(".name} and {other}"))
    return table(spark, sf, "events").select(
        "event_id",
        steps.alias("steps"),
        F.size(references(template)).alias("n_refs"),
        title_of_id(F.concat(F.lit("phase_of_"), "event_type")).alias("title"),
    )


_THEY = ("they", "them", "their", "theirs", "themself", "themselves")
_REFERRED = rf"""{SAYING}, people AS (SELECT session_id, entry_key AS name, min(entry_ord) AS ord FROM character_states
          WHERE session_id IS NOT NULL AND entry_key IS NOT NULL GROUP BY ALL),
        known AS (SELECT session_id, w, arg_min(name, (ord, name)) AS named FROM (
          SELECT session_id, name, ord, unnest(string_split_regex(lower(name), '[^\p{{L}}]+')) AS w FROM people) WHERE length(w) > 2 GROUP BY ALL),
        every AS (SELECT session_id, string_agg(DISTINCT name, '/' ORDER BY name) AS every_name FROM people GROUP BY 1),
        tokens AS (SELECT context_id, session_id, message_idx, i::INT AS pos, ws[i] AS word, lower(regexp_replace(ws[i], '[^\p{{L}}]', '', 'g')) AS w FROM (
          SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM saying))),
        marked AS (SELECT t.*, named, last_value(named IGNORE NULLS) OVER (PARTITION BY context_id, session_id, message_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS before
          FROM tokens t LEFT JOIN known USING (session_id, w)),
        referred AS (SELECT context_id, message_idx, pos, word, named, CASE WHEN w IN {_THEY} THEN coalesce(before, every_name) END AS refers_to
          FROM marked LEFT JOIN every USING (session_id))"""


def _referred(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "character_states").where(F.col("session_id").isNotNull() & F.col("entry_key").isNotNull())
    names = people.groupBy("session_id", F.col("entry_key").alias("name")).agg(F.min("entry_ord").alias("ord"))
    # The tables know no sex, so "they" and its forms fit everyone.
    names = names.withColumn("sex", F.lit(None).cast("string"))
    return referred_tokens(session_messages(spark, sf), names, ["context_id", "message_idx"], "text", "session_id")


@catalogue.add(sql=f"WITH {_REFERRED} SELECT context_id, message_idx, pos, word, named, refers_to FROM referred WHERE named IS NOT NULL OR refers_to IS NOT NULL")
def coref_last_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = _referred(spark, sf)
    return rows.where(F.col("named").isNotNull() | F.col("refers_to").isNotNull())


@catalogue.add(
    sql=f"""WITH {_REFERRED} SELECT context_id, message_idx,
          string_agg(CASE WHEN refers_to IS NULL THEN word ELSE word || ' [' || refers_to || ']' END, ' ' ORDER BY pos) AS tagged FROM referred GROUP BY ALL"""
)
def pronoun_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_references(_referred(spark, sf), ["context_id", "message_idx"])


@catalogue.add(
    sql=f"""WITH {_META}, seen AS (
          SELECT conv_id, unnest(m.characters_present) AS name, 0 AS part, ord FROM meta
          UNION ALL SELECT conv_id, unnest(m.speakers), 1, ord FROM meta),
        firsts AS (SELECT conv_id, name, min(part * 1000000 + ord) AS seen_at FROM seen WHERE name IS NOT NULL GROUP BY ALL)
        SELECT conv_id, name, (row_number() OVER (PARTITION BY conv_id ORDER BY seen_at, name))::INT AS place FROM firsts"""
)
def participants_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = metadata_rows(spark, sf)
    lists = [
        (rows.select("conv_id", F.explode(f"m.{column}").alias("name"), "ord").where(F.col("name").isNotNull()), rank)
        for rank, column in enumerate(("characters_present", "speakers"))
    ]
    return union_in_order(lists, ["conv_id"], "name", "ord")
