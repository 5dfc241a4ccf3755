"""Arrays and maps as the engine's documents hold them, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def longest_first(names: Column) -> Column:
    """Names by falling length, equal lengths by code point: longer names are matched before parts of them."""
    keyed = F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def unique_names(names: Column) -> Column:
    """Names without nulls, empty ones and repeats, in their order."""
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def common_names(a: Column, b: Column) -> Column:
    """Names of ``a`` that ``b`` has too, without repeats; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_intersect(F.coalesce(a, none), F.coalesce(b, none))


def merged(left: Column, right: Column) -> Column:
    """Both maps as one; where both have a key the right one's value stands, a null one too."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.coalesce(F.map_concat(kept, right), left, right)


def list_to_map(items: Column) -> Column:
    """A list as a map from the places written as text; null for null."""
    return F.map_from_entries(F.transform(items, lambda x, i: F.struct(i.cast("string"), x)))


def numeric_keys_sorted(entries: Column) -> Column:
    """Entries of a map by the number that each key spells; keys that are none come last, by code point."""
    keyed = F.transform(
        F.map_entries(entries), lambda e: F.struct(F.coalesce(e["key"].try_cast("bigint"), F.lit(2**62)).alias("at"), e["key"].alias("key"), e["value"].alias("value"))
    )
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def is_list_map(entries: Column) -> Column:
    """Whether the keys are 0, 1, 2 and so on without a gap, in any order; an empty map is one."""
    keys = F.map_keys(entries)
    numbers = F.array_sort(F.transform(keys, lambda k: k.try_cast("int")))
    wanted = F.transform(F.sequence(F.lit(0), F.size(keys)), lambda i: i)
    return F.forall(keys, lambda k: F.rlike(k, F.lit(r"^\d+$"))) & (numbers == F.slice(wanted, F.lit(1), F.size(keys)))


def map_to_list(entries: Column) -> Column:
    """The values of a list map (see ``is_list_map``) in the order of its keys; null for any other map."""
    return F.when(is_list_map(entries), F.transform(numeric_keys_sorted(entries), lambda e: e["value"]))


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def short_id(value: Column) -> Column:
    """Eight hexadecimal digits that stand for a value: the same on every run, unlike a random id."""
    return F.left(F.sha2(value.cast("string"), 256), F.lit(8))


def seed_of(seed: Column, identity: Column) -> Column:
    """A given seed; for -1 or null one drawn from ``identity``, so that a repeated run draws the same."""
    return F.when(seed.isNull() | (seed == -1), F.pmod(F.xxhash64(identity), F.lit(2**31))).otherwise(seed)
