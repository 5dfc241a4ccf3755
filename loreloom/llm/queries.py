"""Queries of the corpus operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm.name_forms import Lexicon
from loreloom.llm.names import link_names, spelling_pairs, typed_names
from loreloom.llm.packing import pack
from loreloom.llm.quality import fit_type_model, text_statistics, text_types, vote_patterns, with_votes
from loreloom.llm.splitting import split_items
from loreloom.llm.tokenizing import count_tokens, encode_documents
from loreloom.plans.registry import Catalogue
from loreloom.session import cut_lineage
from loreloom.sources.tables import table

catalogue = Catalogue()

#: Tokens of one container.
CAPACITY = 2_048


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    sessions = table(spark, sf, "sessions")
    names = typed_names(table(spark, sf, "character_states"), sessions, "character", aliases=None).unionByName(
        typed_names(table(spark, sf, "group_states"), sessions, "group", aliases="aliases")
    )
    # Two dictionaries of fixed size, whatever the data: short forms and frequent words.
    known = table(spark, sf, "name_forms").where(F.col("form").isNotNull() & F.col("full_form").isNotNull())
    rows = known.distinct().collect()
    usual = [r["word"] for r in table(spark, sf, "common_words").select("word").distinct().collect() if r["word"]]
    return link_names(names, Lexicon.of([(r["form"], r["full_form"], r["form_kind"]) for r in rows], usual))


@catalogue.add()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_pairs(_linked(spark, sf))


@catalogue.add()
def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _linked(spark, sf).withColumnRenamed("world", "world_hash")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_items(
        table(spark, sf, "retrieval_contexts"), keep=["context_id"], items="messages", metadata="messages_metadata"
    )


@catalogue.add(
    sql="""SELECT DISTINCT context_id, (i - 1)::INT AS ord
           FROM (SELECT context_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts)
           WHERE length(messages[i]) > 1200"""
)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("n_pieces > 1").select("context_id", "ord").distinct()


@catalogue.add()
def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).dropDuplicates(["context_id", "ord", "piece_no"])


@catalogue.add(
    sql="""SELECT DISTINCT context_id, (i - 1)::INT AS ord, md5(messages[i]) AS digest,
                  ceil(length(messages[i]) / 1200.0)::BIGINT <= 1 AS whole, TRUE AS fits
           FROM (SELECT context_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM retrieval_contexts)
           WHERE messages[i] <> ''"""
)
def p2_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every item put together again from its pieces: each adds what lies beyond the piece before it."""
    pieces = p2_pieces(spark, sf)
    ends = F.transform("p", lambda x: x["start"] + F.char_length(x["text"]))
    beyond = F.transform(
        "p",
        lambda x, i: F.substr(x["text"], F.when(i == 0, 1).otherwise(F.get("ends", i - 1) - x["start"] + 1)),
    )
    overlaps = F.transform("p", lambda x, i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1) - x["start"]))
    fits = F.forall("p", lambda x: F.char_length(x["text"]) <= 1200) & F.forall("overlaps", lambda n: n.between(0, 120))
    return (
        pieces.groupBy("context_id", "ord")
        .agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "text"))).alias("p"), F.max("n_pieces").alias("n"))
        .withColumn("ends", ends)
        .withColumn("overlaps", overlaps)
        .select(
            "context_id", "ord", F.md5(F.array_join(beyond, "")).alias("digest"), (F.col("n") == 1).alias("whole"), fits.alias("fits")
        )
    )


@catalogue.add()
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"), "doc_id", "text")


@catalogue.add()
def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sized = cut_lineage(count_tokens(table(spark, sf, "documents"), "doc_id", "text"))
    return pack(sized, "doc_id", "n_tokens", CAPACITY)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    words = [r["word"] for r in table(spark, sf, "common_words").select("word").distinct().collect() if r["word"]]
    votes = cut_lineage(with_votes(text_statistics(table(spark, sf, "documents"), "doc_id", "text", words)))
    return text_types(votes, fit_type_model(vote_patterns(votes)))


_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')"


@catalogue.add(
    sql=rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        c AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[^\t-\r \p{{Z}}\x{{85}}]') THEN length(regexp_replace(text, '[\t-\r ]', '', 'g')) ELSE 0 END AS n_chars,
          {_WORDS} AS words, length(regexp_replace(text, '[\p{{L}}\p{{N}}\t-\r ]', '', 'g')) AS symbols FROM d)
        SELECT doc_id, n_chars, len(words) AS n_words, round(coalesce(list_sum(list_transform(words, lambda w: length(w))) / nullif(len(words), 0), 0), 6) AS mean_word_length,
          round(coalesce(CASE WHEN n_chars > 0 THEN symbols / n_chars END, 0), 6) AS symbol_share FROM c"""
)
def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that SQL can count too."""
    words = [r["word"] for r in table(spark, sf, "common_words").select("word").distinct().collect() if r["word"]]
    counted = text_statistics(table(spark, sf, "documents"), "doc_id", "text", words)
    return counted.select("doc_id", "n_chars", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_share", 6).alias("symbol_share"))


@catalogue.add()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _typed(spark, sf).where(F.col("text_type") != "prose").select("doc_id")


@catalogue.add()
def p8_statistics(spark: SparkSession, sf: str) -> DataFrame:
    typed = _typed(spark, sf)
    return typed.select([c for c in typed.columns if not c.startswith("vote_")])
