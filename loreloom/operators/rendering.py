"""Entries and contexts as text, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "<EMPTY>"


def bullets(items: Column, mark: str = "- ") -> Column:
    """One line for each non-blank item, or ``<EMPTY>``."""
    kept = F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != ""))
    text = F.array_join(F.transform(kept, lambda x: F.concat(F.lit(mark), x)), "\n")
    return F.when(F.size(kept) > 0, text).otherwise(F.lit(EMPTY))


def indexed(items: Column) -> Column:
    """One line ``[i] item`` for each item, null items as ``null``."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(x, F.lit("null")))), "\n"
    )


def capped(text: Column, most: int = 2_000) -> Column:
    """Text for a prompt, cut with dots at ``most`` characters."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def list_preview(items: Column, most: int = 20) -> Column:
    """The first ``most`` items joined, and how many more there are."""
    more = F.size(items) - most
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(shown)


def render_entry(name: Column, sections: dict[str, Column]) -> Column:
    """A heading and each section's bullets; empty sections are left out."""
    parts = [F.concat(F.lit("## "), name)]
    for title, items in sections.items():
        body = bullets(items)
        parts.append(F.when(body != EMPTY, F.concat(F.lit(f"{title}:\n"), body)))
    return F.concat_ws("\n", *parts)


def assemble(sections: DataFrame, key: list[str], order: DataFrame) -> DataFrame:
    """One text for each key: its sections (``section``, ``ord``, ``text``) in the
    configured ``order`` (``section``, ``section_ord``, ``prompt``); unknown sections are dropped.

    A key's lines meet in one row, as they are one prompt.
    """
    placed = sections.join(order, "section").where(F.col("text").isNotNull())
    line = F.struct("section_ord", "ord", "prompt", "text")
    gathered = placed.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("__lines"))
    opens = lambda x, i: (i == 0) | (F.get("__lines", i - 1)["section_ord"] != x["section_ord"])
    lines = F.transform("__lines", lambda x, i: F.when(opens(x, i), F.concat(x["prompt"], F.lit("\n"), x["text"])).otherwise(x["text"]))
    return gathered.select(*key, F.array_join(lines, "\n").alias("context"))
