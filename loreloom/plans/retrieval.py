"""Queries on speech, summaries, ranges and the composed retrieval before a reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.operators.conversation import sentence_chunks
from loreloom.operators.knowledge import leaf_table, path_text
from loreloom.operators.mentions import quoted_speakers, speech_pattern
from loreloom.plans import knowledge
from loreloom.plans.conversation import CHUNKS, CONV, conversations, metadata_rows
from loreloom.plans.registry import Catalogue
from loreloom.sources.tables import table

catalogue = Catalogue()

_NAME = r"(\p{Lu}[\p{L}''-]+(?: \p{Lu}[\p{L}''-]+)?)"


@catalogue.add(
    sql=rf"""WITH {CHUNKS} SELECT conv_id, node, speaker FROM (
        SELECT conv_id, node, text, coalesce(nullif(regexp_extract(text, '\b{speech_pattern()} {_NAME}', 1), ''),
          nullif(regexp_extract(text, '{_NAME} {speech_pattern()}\b', 1), '')) AS speaker FROM chunks)
        WHERE speaker IS NOT NULL AND regexp_matches(text, '["“”«»]')"""
)
def quoted_speaker(spark: SparkSession, sf: str) -> DataFrame:
    return quoted_speakers(sentence_chunks(conversations(spark, sf)), ["conv_id", "node"], "text")


@catalogue.add(
    sql="""SELECT DISTINCT context_id, ord, msg FROM (
          SELECT context_id, (i - 1)::INT AS ord, messages_metadata[i].message_idx AS msg, lo, hi FROM (
            SELECT context_id, messages_metadata, lo, hi, unnest(range(1, len(messages_metadata) + 1)) AS i FROM (
              SELECT context_id, messages_metadata, messages_metadata[1].message_idx AS lo, messages_metadata[1].message_idx + 40 AS hi FROM retrieval_contexts)))
        WHERE msg BETWEEN lo + 1 AND hi + 1"""
)
def range_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the messages after a context's first one, up to 41 on."""
    rows = table(spark, sf, "retrieval_contexts").select(
        "context_id", F.get("messages_metadata", F.lit(0))["message_idx"].alias("lo"), F.posexplode("messages_metadata").alias("ord", "m")
    )
    msg = F.col("m.message_idx")
    return rows.where(msg.between(F.col("lo") + 1, F.col("lo") + 41)).select("context_id", "ord", msg.alias("msg")).distinct()


@catalogue.add(
    sql="""SELECT DISTINCT context_id AS conv_id, ord, messages[ord + 1] AS text, m.scene_id AS scene, m.is_summary AS is_summary FROM (
          SELECT context_id, messages, (i - 1)::INT AS ord, messages_metadata[i] AS m FROM (
            SELECT context_id, messages, messages_metadata, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts))"""
)
def zip_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Each message with its metadata by position; missing metadata is null."""
    rows = table(spark, sf, "retrieval_contexts").select(
        F.col("context_id").alias("conv_id"), F.posexplode("messages").alias("ord", "text"), "messages_metadata"
    )
    m = F.get("messages_metadata", F.col("ord"))
    return rows.select("conv_id", "ord", "text", m["scene_id"].alias("scene"), m["is_summary"].alias("is_summary")).distinct()


@catalogue.add(
    sql="""WITH meta AS (SELECT DISTINCT context_id, i, messages_metadata[i] AS m FROM (
          SELECT context_id, messages_metadata, unnest(range(1, len(messages_metadata) + 1)) AS i FROM retrieval_contexts))
        SELECT m.chapter_number AS chapter_number, count(*) AS n_chunks, count(DISTINCT m.scene_id) AS n_scenes,
          count(*) FILTER (m.is_summary) AS n_summaries FROM meta WHERE m IS NOT NULL GROUP BY 1"""
)
def chapter_statistics(spark: SparkSession, sf: str) -> DataFrame:
    # A context that was delivered again counts once.
    return metadata_rows(spark, sf).dropDuplicates(["conv_id", "ord"]).groupBy(F.col("m.chapter_number").alias("chapter_number")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("m.scene_id").alias("n_scenes"), F.count_if("m.is_summary").alias("n_summaries")
    )


_SPLIT = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda w: length(w) >= 4))"


@catalogue.add(
    sql=f"""WITH {CHUNKS}, asked AS (SELECT DISTINCT context_id AS conv_id, context FROM retrieval_contexts WHERE context IS NOT NULL),
        scored AS (SELECT c.conv_id, c.node, len(list_intersect({_SPLIT.format("c.text")}, {_SPLIT.format("a.context")}))::INT AS score
          FROM chunks c JOIN asked a USING (conv_id))
        SELECT conv_id, node, score, place FROM (
          SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, node))::INT AS place FROM scored WHERE score > 0) WHERE place <= 5"""
)
def context_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five chunks of each conversation that share most words with its context."""

    def words(column: str):  # noqa: ANN202
        return F.array_distinct(F.filter(F.split(F.lower(column), "[^a-z]+"), lambda w: F.length(w) >= 4))

    asked = table(spark, sf, "retrieval_contexts").where(F.col("context").isNotNull())
    asked = asked.select(F.col("context_id").alias("conv_id"), words("context").alias("asked")).distinct()
    chunks = sentence_chunks(conversations(spark, sf)).select("conv_id", "node", words("text").alias("words"))
    scored = chunks.join(asked, "conv_id").select("conv_id", "node", F.size(F.array_intersect("words", "asked")).alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), "node")
    return scored.where(F.col("score") > 0).withColumn("place", F.row_number().over(best)).where(F.col("place") <= 5)


@catalogue.add(
    sql="""SELECT c_custkey, 'subjects.market.segment' AS reference, c_mktsegment AS value FROM customer
        UNION ALL SELECT c_custkey, 'subjects.name', c_name FROM customer"""
)
def resolve_references(spark: SparkSession, sf: str) -> DataFrame:
    """References of a template, resolved against each document's leaves."""
    template = "{subjects.market.segment} knows {subjects.name} and {subjects.nowhere}"
    documents = knowledge._customer_documents(spark, sf)
    wanted = documents.select(
        "c_custkey", F.explode(F.regexp_extract_all(F.lit(template), F.lit(r"\{(subjects\.[^}]+)\}"), F.lit(1))).alias("reference")
    )
    leaves = leaf_table(documents, ["c_custkey"], "doc")
    named = leaves.select("c_custkey", F.concat(F.lit("subjects."), path_text(F.col("path"))).alias("reference"), "value")
    return wanted.join(named, ["c_custkey", "reference"])
