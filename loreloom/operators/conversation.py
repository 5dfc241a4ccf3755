"""Messages, their windows, chunks and the intervals that tag them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import node_id, paragraphs, sentences
from loreloom.operators.running import running_sum


def messages_of(contexts: DataFrame, key: str, items: str) -> DataFrame:
    """One row for each distinct message: ``conv_id``, ``message_idx``, ``exchange_idx``, ``role``, ``text``.

    Even places are the user's, odd ones the assistant's.  Null messages have no row but
    keep their place; repeated deliveries count once; null keys are dropped.
    """
    listed = contexts.where(F.col(key).isNotNull()).select(
        F.col(key).alias("conv_id"), F.posexplode(items).alias("message_idx", "text")
    )
    distinct = listed.where(F.col("text").isNotNull()).distinct()
    return distinct.select(
        "conv_id",
        "message_idx",
        F.floor(F.col("message_idx") / 2).cast("int").alias("exchange_idx"),
        F.when(F.col("message_idx") % 2 == 0, "user").otherwise("assistant").alias("role"),
        "text",
    )


def last_exchanges(messages: DataFrame, n: int) -> DataFrame:
    """Messages of the last ``n`` exchanges of each conversation; the bound is an
    aggregate joined back, so no conversation is sorted."""
    last = messages.groupBy("conv_id").agg(F.max("exchange_idx").alias("__last"))
    return messages.join(last, "conv_id").where(F.col("exchange_idx") > F.col("__last") - n).drop("__last")


def numbered_backwards(messages: DataFrame) -> DataFrame:
    """``number``: 1 for the last non-blank message of a conversation, rising backwards."""
    shown = messages.where(F.trim("text") != "")
    return running_sum(shown, ["conv_id"], -F.col("message_idx"), F.lit(1), "number")


def last_messages(messages: DataFrame, n: int, most: int) -> DataFrame:
    """The last ``n`` messages of each conversation, each cut to ``most`` characters."""
    backwards = Window.partitionBy("conv_id").orderBy(F.desc("message_idx"))
    return (
        messages.withColumn("__n", F.row_number().over(backwards))
        .where(F.col("__n") <= n)
        .withColumn("text", F.left("text", F.lit(most)))
        .drop("__n")
    )


def paragraph_chunks(messages: DataFrame, gap: str = "\n\n") -> DataFrame:
    """Paragraphs of each message, numbered from 1."""
    return messages.select(
        "conv_id", "message_idx", F.posexplode(paragraphs(F.col("text"), gap)).alias("__p", "paragraph")
    ).select("conv_id", "message_idx", (F.col("__p") + 1).alias("paragraph_idx"), "paragraph")


def sentence_chunks(messages: DataFrame, gap: str = "\n\n") -> DataFrame:
    """Sentences of each message with their address (message, paragraph, sentence)."""
    parts = paragraph_chunks(messages, gap).select(
        "conv_id", "message_idx", "paragraph_idx", F.posexplode(sentences(F.col("paragraph"))).alias("__s", "text")
    )
    place = F.col("__s") + 1
    return parts.select(
        "conv_id",
        node_id(F.col("message_idx"), F.col("paragraph_idx"), place).alias("node"),
        "message_idx",
        "paragraph_idx",
        place.alias("sentence_idx"),
        "text",
    )


def upsert_chunks(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` without the messages that ``fresh`` has anew, and ``fresh``."""
    return stored.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def delete_chunks(stored: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` without the messages of ``gone``."""
    return stored.join(gone.select(*key).distinct(), key, "left_anti")


def tag_chunks(stored: DataFrame, tags: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` overwritten where ``tags`` has a value."""
    new = tags.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = stored.join(new, key, "left")
    changed = {c: F.coalesce(f"__new_{c}", c) for c in columns}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns])


#: Numbers of one cell of the next level, as a power of two, and levels (together all of 32 bits).
_CELL_BITS, _LEVELS = 8, 4


def _cells(lo: Column, hi: Column) -> Column:
    """Cells ``(level, cell)`` that cover ``lo`` to ``hi`` exactly: at most 510 of each level, however long it is."""

    def bounds(level: int) -> tuple[Column, Column]:
        width = 1 << (_CELL_BITS * level)
        return F.ceil(lo / width).cast("bigint"), (F.floor((hi + 1) / width) - 1).cast("bigint")

    def run(level: int, first: Column, last: Column) -> Column:
        cells = F.transform(F.sequence(first, last), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))
        return F.when(first <= last, cells).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))

    parts = []
    for level in range(_LEVELS):
        first, last = bounds(level)
        if level == _LEVELS - 1:
            parts.append(run(level, first, last))
            continue
        up, down = bounds(level + 1)
        inner = up <= down
        parts.append(run(level, first, F.when(inner, F.shiftleft(up, _CELL_BITS) - 1).otherwise(last)))
        parts.append(run(level, F.when(inner, F.shiftleft(down + 1, _CELL_BITS)).otherwise(F.lit(1).cast("bigint")), F.when(inner, last).otherwise(F.lit(0).cast("bigint"))))
    return F.flatten(F.array(*parts))


def interval_tags(points: DataFrame, intervals: DataFrame, group: str, point: str) -> DataFrame:
    """Each point with the interval that holds it; of several the one with the greatest ``ord``.

    ``intervals``: ``group``, ``name``, ``ord``, ``lo``, ``hi``, both ends inclusive.  An interval is spread
    over cells of widths 1, 256, 256^2 and so on, of which it needs few whatever its length, and a point
    lies in one cell of each width, so the join is one on equality.
    """
    spread = intervals.where(F.col("lo") <= F.col("hi")).select(
        group, F.inline(_cells(F.col("lo").cast("bigint"), F.col("hi").cast("bigint"))), "name", "ord"
    )
    best = spread.groupBy(group, "level", "cell").agg(F.max(F.struct("ord", "name")).alias("best"))
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(F.col(point).cast("bigint"), _CELL_BITS * i).alias("cell")) for i in range(_LEVELS)])
    placed = points.select(group, point).distinct().select(group, point, F.inline(levels))
    chosen = placed.join(best, [group, "level", "cell"]).groupBy(group, point).agg(F.max("best")["name"].alias("tag"))
    return points.join(chosen, [group, point], "left")


def running_counter(rows: DataFrame, group: list[str], order: str, boundary: Column, name: str) -> DataFrame:
    """``name``: 1 at first, one more from each row on where ``boundary`` holds.

    ``order`` is an integer that does not repeat within ``group``.
    """
    counted = running_sum(rows, group, F.col(order), F.when(boundary, 1).otherwise(0), name)
    return counted.withColumn(name, F.col(name) + 1)


def first_by_text(rows: DataFrame, group: list[str], text: str, order: str) -> DataFrame:
    """The first row of each text in ``group``: order-preserving deduplication.

    Rows are compared by value through an aggregate that combines before the shuffle, so
    a text with very many copies is no hot group; null texts are one text.
    """
    others = [c for c in rows.columns if c not in {*group, text, order}]
    first = F.min(F.struct(order, *others)).alias("__first")
    kept = rows.groupBy(*group, text).agg(first)
    return kept.select(*group, text, "__first.*")
