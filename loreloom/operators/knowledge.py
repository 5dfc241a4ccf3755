"""Path queries and updates over documents in path-value form.

A document becomes its leaves: ``path`` (array of steps), ``ord`` (places of the steps
as written) and ``value`` (a string's text, other values' JSON; empty containers stay
as ``{}`` or ``[]``).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.documents import let

LEAVES = "array<struct<path:array<string>,ord:array<int>,value:string>>"
#: Levels that a document is opened by expressions; a deeper document is read as a whole (``_deep_leaves``).
DEPTH = 8


def _read_whole(document: str) -> list[tuple[list[str], list[int], str | None]]:
    """Leaves of one document of any depth, as ``leaves`` gives them."""
    found: list[tuple[list[str], list[int], str | None]] = []
    waiting: list[tuple[list[str], list[int], object]] = [
        ([], [], json.loads(document, parse_float=_Number, parse_int=_Number, object_pairs_hook=_Pairs))
    ]
    while waiting:
        path, place, value = waiting.pop()
        if isinstance(value, _Pairs):
            parts, empty = list(value), "{}"
        elif isinstance(value, list):
            parts, empty = [(str(i), v) for i, v in enumerate(value)], "[]"
        else:
            found.append((path, place, value if value is None or isinstance(value, str) else json.dumps(value)))
            continue
        if not parts:
            found.append((path, place, empty))
        waiting.extend([([*path, k], [*place, i], v) for i, (k, v) in enumerate(parts)][::-1])
    return found


def _deep_leaves(document: Column) -> Column:
    """``_read_whole`` in Arrow batches, for documents below ``DEPTH`` levels only; null for null."""

    @F.pandas_udf(LEAVES)
    def read(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else _read_whole(d))

    return read(document)


class _Number(str):
    """A number as written."""


class _Pairs(list):
    """Members of an object in the order written."""


def leaves(text: Column, depth: int = DEPTH) -> Column:
    """Leaves of a JSON document in the order written, down to ``depth`` levels; null for null."""

    def children(value: Column) -> Column:
        kind = "array<struct<key:string,item:string>>"
        keyed = F.transform(
            F.map_entries(F.from_json(value, "map<string,string>")),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")),
        )
        listed = F.transform(
            F.from_json(value, "array<string>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("item"))
        )
        return F.when(F.startswith(value, F.lit("{")), keyed.cast(kind)).when(
            F.startswith(value, F.lit("[")), listed.cast(kind)
        )

    def opened(value: Column, path: Column, place: Column, left: int) -> Column:
        leaf = F.array(F.struct(path.alias("path"), place.alias("ord"), value.alias("value"))).cast(LEAVES)
        if left == 0:
            return leaf
        return let(
            children(value),
            lambda parts: F.when(parts.isNull() | (F.size(parts) == 0), leaf).otherwise(
                F.flatten(
                    F.transform(
                        parts,
                        lambda c, i: opened(
                            c["item"], F.concat(path, F.array(c["key"])), F.concat(place, F.array(i)), left - 1
                        ),
                    )
                ).cast(LEAVES)
            ),
        )

    return F.when(text.isNotNull(), opened(text, F.array().cast("array<string>"), F.array().cast("array<int>"), depth))


def leaf_table(documents: DataFrame, key: list[str], doc: str) -> DataFrame:
    """``key``, ``path``, ``ord``, ``value``: one row for each leaf, however deep.

    Documents within ``DEPTH`` levels are opened by expressions; only deeper ones cross to Python.
    """
    opened = documents.select(*key, F.col(doc).alias("__doc"), leaves(F.col(doc)).alias("__leaves"))
    closed = F.exists("__leaves", lambda x: (F.size(x["path"]) == DEPTH) & (F.json_object_keys(x["value"]).isNotNull() | F.json_array_length(x["value"]).isNotNull()))
    deep = _deep_leaves(F.when(closed, F.col("__doc")))
    return opened.select(*key, F.inline(F.coalesce(deep, F.col("__leaves"))))


def path_text(path: Column) -> Column:
    return F.array_join(path, ".")


def get_path(leaf_rows: DataFrame, path: list[str]) -> DataFrame:
    """Leaves at or below ``path``; steps are matched exactly."""
    steps = F.array(*[F.lit(p) for p in path])
    return leaf_rows.where(F.slice("path", 1, len(path)) == steps)


def child_counts(leaf_rows: DataFrame, key: list[str], path: list[str]) -> DataFrame:
    """Children of ``path`` with the number of leaves below each."""
    below = get_path(leaf_rows, path).where(F.size("path") > len(path))
    return below.groupBy(*key, F.element_at("path", len(path) + 1).alias("child")).agg(F.count(F.lit(1)).alias("n_leaves"))


def fuzzy_key(rows: DataFrame, group: list[str], key: str, order: str, patterns: list[str], *, both_ways: bool) -> DataFrame:
    """For each group and pattern the key that fits: an equal one, else the first that
    contains the pattern (``both_ways``: or is contained in it), whatever the case."""
    low = F.lower(key)
    fits = lambda p: F.contains(low, p) | (F.contains(p, low) if both_ways else F.lit(False))
    wanted = F.filter(F.array(*[F.lit(p.lower()) for p in patterns]), fits)
    hits = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(
        *group, key, F.col(order).alias("__ord"), F.explode(wanted).alias("pattern")
    )
    best = F.min_by(F.col(key), F.struct(F.lower(key) != F.col("pattern"), "__ord", key))
    return hits.groupBy(*group, "pattern").agg(best.alias("matched"))


def search(leaf_rows: DataFrame, key: list[str], terms: list[str], most: int = 10) -> DataFrame:
    """For each term the first ``most`` hits and how many there are: ``term``, ``key``, ``path``, ``value``, ``matched_on``, ``total_found``.

    A leaf is hit by its value; any step, inner ones too, by its key, with the path down to it and a null
    value unless it is the leaf.  Of hits on one path the one on the key stands.  Hits are found once and
    counted before the best are ranked; the ranking of a term is a top-k, combined before the shuffle.
    """
    wanted = F.array(*[F.lit(t) for t in terms])
    inside = F.transform(
        "path",
        lambda step, i: F.struct(
            F.slice("path", F.lit(1), i + 1).alias("path"),
            F.when(i == F.size("path") - 1, F.col("value")).alias("value"),
            F.lower(step).alias("text"),
            F.lit("key").alias("matched_on"),
        ),
    )
    own = F.array(F.struct(F.col("path"), F.col("value"), F.lower("value").alias("text"), F.lit("value").alias("matched_on")))
    parts = leaf_rows.where(F.size("path") > 0).select(*key, F.inline(F.concat(inside, own)))
    hits = parts.select(
        *key, path_text(F.col("path")).alias("path"), "value", "matched_on", F.explode(F.filter(wanted, lambda t: F.contains(F.col("text"), t))).alias("term")
    )
    hits = hits.groupBy("term", *key, "path").agg(F.min(F.struct("matched_on", "value")).alias("h")).select("term", *key, "path", "h.value", "h.matched_on")
    total = hits.groupBy("term").agg(F.count(F.lit(1)).alias("total_found"))
    best = Window.partitionBy("term").orderBy(*key, "path")
    ranked = hits.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most).drop("__n")
    return ranked.join(total, "term")


def apply_patches(leaf_rows: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Leaves after ``patches`` (``key``, ``seq``, ``path``, ``value``): last write wins.

    A write replaces the leaf at its path and whatever was written below it before; it
    is dropped itself if a later one writes above it.  Paths of one document meet in the
    join on ``key`` and first step only.
    """
    base = leaf_rows.select(*key, F.lit(-1).cast("bigint").alias("seq"), "path", "value")
    every = base.unionByName(patches.select(*key, F.col("seq").cast("bigint").alias("seq"), "path", "value"))
    last = every.groupBy(*key, "path").agg(F.max(F.struct("seq", "value")).alias("w"))
    last = last.select(*key, "path", "w.seq", "w.value", F.element_at("path", 1).alias("__head"))
    above = last.where(F.col("seq") >= 0).select(*key, "__head", F.col("path").alias("__over"), F.col("seq").alias("__later"))
    covers = (
        (F.col("__later") > F.col("seq"))
        & (F.size("__over") < F.size("path"))
        & (F.slice(F.col("path"), F.lit(1), F.size("__over")) == F.col("__over"))
    )
    conditions = [last[k] == above[k] for k in [*key, "__head"]]
    return last.join(above, [*conditions, covers], "left_anti").select(*key, "path", "value")


def expand_list(rows: DataFrame, key: list[str], items: str) -> DataFrame:
    """A list as rows of place and value."""
    return rows.select(*key, F.posexplode(items).alias("place", "value"))


def pack_list(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of place and value as a list again, in the order of the places."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda e: e["value"])
    return rows.groupBy(*key).agg(packed.alias("items"))


def violations(rows: DataFrame, key: list[str], rules: dict[str, Column], most: int = 3) -> DataFrame:
    """Rows that break a rule: the first ``most`` messages joined, and how many there are."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]), lambda m: m.isNotNull())
    found = rows.select(*key, broken.alias("__all")).where(F.size("__all") > 0)
    return found.select(*key, F.array_join(F.slice("__all", 1, most), "; ").alias("errors"), F.size("__all").alias("n_errors"))
