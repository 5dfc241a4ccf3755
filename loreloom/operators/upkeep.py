"""The maintenance pass over documents in path-value form: work items, due actions, patches, new leaves.

A schema is compiled to transitions between types, so the type of every node of a document follows from its
path by an expression; nothing is traversed on the driver and no document is assembled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import patches_of, path_tokens
from loreloom.operators.knowledge import apply_patches, path_text
from loreloom.operators.maintenance import query_rejects, run_actions
from loreloom.schema.grammar import PRIMITIVES, Schema, TypeNode, show

#: The type of what is not to be maintained: internal fields, fields marked so, unknown ones.
CLOSED = "!"


def transitions(schema: Schema, root: str) -> dict[str, str]:
    """``type|step`` to the type below; ``type|*`` for the members of lists and maps."""
    found: dict[str, str] = {}
    waiting = [schema.unwrap(TypeNode(root))]
    seen: set[str] = set()
    while waiting:
        node = waiting.pop()
        if show(node) in seen or node.name in PRIMITIVES:
            continue
        seen.add(show(node))
        if node.arguments:
            below = schema.unwrap(node.arguments[-1])
            found[f"{show(node)}|*"] = show(below)
            waiting.append(below)
            continue
        definition = schema.definitions[node.name]
        for name, kind in definition.fields.items():
            below = schema.unwrap(kind)
            open_field = not name.startswith("_") and name not in definition.no_update
            found[f"{node.name}|{name}"] = show(below) if open_field else CLOSED
            waiting.append(below)
    return found


def type_at(path: Column, root: str, steps: dict[str, str]) -> Column:
    """The type of the node at ``path`` of a document of type ``root``."""
    known = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    return F.aggregate(
        path,
        F.lit(root),
        lambda kind, step: F.coalesce(
            F.try_element_at(known, F.concat(kind, F.lit("|"), step)), F.try_element_at(known, F.concat(kind, F.lit("|*"))), F.lit(CLOSED)
        ),
    )


def _is_plain(kind: Column) -> Column:
    """Primitives and lists and maps of them: written as a whole."""
    names = "|".join(PRIMITIVES)
    return F.rlike(kind, F.lit(rf"^(?:(?:list|dict)\[(?:\w+, )?)*(?:{names})\]*$"))


def nodes_of(leaf_rows: DataFrame, key: list[str], root: str, schema: Schema) -> DataFrame:
    """Every node of the documents once: ``key``, ``path``, ``kind`` (its type) and ``above`` (its parent's)."""
    steps = transitions(schema, root)
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    nodes = leaf_rows.select(*key, F.explode(prefixes).alias("path")).distinct()
    parent = F.when(F.size("path") > 0, type_at(F.slice("path", F.lit(1), F.size("path") - 1), root, steps))
    return nodes.select(*key, "path", type_at(F.col("path"), root, steps).alias("kind"), parent.alias("above"))


def work_items(leaf_rows: DataFrame, key: list[str], root: str, schema: Schema) -> DataFrame:
    """What a pass visits: ``key``, ``path``, ``kind`` and ``work``.

    ``node``: an object with fields of its own, whose triggers apply; ``update``: a value or a list or map of
    values, written as a whole; ``initialise``: a field that an object lacks.  Internal fields and those
    marked ``no_update`` are left out with all below them, unknown ones too.
    """
    nodes = nodes_of(leaf_rows, key, root, schema).where(F.col("kind") != CLOSED)
    classes = [d.name for d in schema.definitions.values() if d.kind == "dataclass"]
    is_node = F.col("kind").isin(*classes)
    whole = _is_plain(F.col("kind")) & (F.col("above").isNull() | ~_is_plain(F.col("above")))
    visited = nodes.where(is_node | whole).select(*key, "path", "kind", F.when(is_node, "node").otherwise("update").alias("work"))
    return visited.unionByName(missing_fields(nodes, key, schema).select(*key, "path", "kind", F.lit("initialise").alias("work")))


def missing_fields(nodes: DataFrame, key: list[str], schema: Schema) -> DataFrame:
    """Fields that objects lack, with what they start with as JSON: ``key``, ``path``, ``kind``, ``value``."""
    spark = nodes.sparkSession
    rows = [
        (d.name, f, show(schema.unwrap(t)), json.dumps(d.defaults.get(f, schema.initial(t))))
        for d in schema.definitions.values()
        if d.kind == "dataclass"
        for f, t in d.fields.items()
        if not f.startswith("_") and f not in d.no_update
    ]
    # One row for each field of the schema document.
    fields = spark.createDataFrame(rows, "definition string, field string, kind string, value string")
    wanted = nodes.join(F.broadcast(fields.withColumnRenamed("kind", "__kind")), nodes["kind"] == fields["definition"]).select(
        *key, F.concat("path", F.array("field")).alias("path"), F.col("__kind").alias("kind"), "value"
    )
    return wanted.join(nodes.select(*key, "path"), [*key, "path"], "left_anti")


def schema_triggers(spark: SparkSession, schema: Schema) -> DataFrame:
    """Catalogue of triggers: ``trigger``, ``kind`` (a definition), ``action_ord``, ``action``, ``condition``."""
    rows = [
        (trigger, d.name, i, entry["action"], entry.get("when"))
        for d in schema.definitions.values()
        for trigger, entries in d.triggers.items()
        for i, entry in enumerate(entries)
    ]
    return spark.createDataFrame(rows, "trigger string, kind string, action_ord int, action string, condition string")


def due_actions(items: DataFrame, key: list[str], triggers: DataFrame, new_scene: Column) -> DataFrame:
    """Actions of the node items under the active triggers: always, and one of new or existing scene.

    Result: ``key``, ``node`` (the path joined by dots), ``kind``, ``action_ord``, ``action``, ``condition``.
    """
    active = F.array(F.lit("always"), F.when(new_scene, "on_new_scene").otherwise("on_existing_scene"))
    nodes = items.where("work = 'node'").withColumn("trigger", F.explode(active))
    return nodes.join(F.broadcast(triggers), ["trigger", "kind"]).select(
        *key, path_text(F.col("path")).alias("node"), "kind", "action_ord", "action", "condition"
    )


def applicable(subjects: DataFrame, triggers: DataFrame, new_scene: Column) -> DataFrame:
    """``subjects`` (with ``kind``) of which some action is due."""
    active = F.array(F.lit("always"), F.when(new_scene, "on_new_scene").otherwise("on_existing_scene"))
    asked = subjects.withColumn("trigger", F.explode(active))
    return asked.join(F.broadcast(triggers.select("trigger", "kind").distinct()), ["trigger", "kind"], "left_semi").drop("trigger").distinct()


def answer_patches(answers: DataFrame, key: list[str]) -> DataFrame:
    """Patches of answers: ``key``, ``seq``, ``path`` (from the document's root), ``value``.

    ``answers``: ``key``, ``node_path`` (where the question was about), ``node_ord``, ``answer``, ``stop_reason``.
    Rejected answers have none.  Patches of one document follow each other by node and place in the answer.
    """
    taken = answers.where(~query_rejects(F.col("answer"), F.col("stop_reason")))
    listed = taken.select(*key, "node_path", "node_ord", F.posexplode(patches_of(F.col("answer"))).alias("__i", "p"))
    text = F.when(F.col("p.kind") == "string", F.from_json(F.concat(F.lit('{"v":'), F.col("p.value"), F.lit("}")), "v string")["v"])
    return listed.select(
        *key,
        (F.col("node_ord").cast("bigint") * 1_000_000 + F.col("__i")).alias("seq"),
        F.concat("node_path", path_tokens(F.col("p.path"))).alias("path"),
        F.when(F.col("p.kind") == "null", F.lit(None)).otherwise(F.coalesce(text, F.col("p.value"))).alias("value"),
    )


def reject_below_values(leaf_rows: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """``patches`` without those that would write below a plain value, and without paths of one step."""
    inside = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    deep = patches.where(F.size("path") > 1)
    above = deep.select(*key, "seq", "path", F.explode(inside).alias("__above"))
    plain = leaf_rows.where(F.col("value").isNull() | ~F.col("value").isin("{}", "[]")).select(*key, F.col("path").alias("__above"))
    blocked = above.join(plain, [*key, "__above"], "left_semi").select(*key, "seq", "path").distinct()
    return deep.join(blocked, [*key, "seq", "path"], "left_anti")


def open_values(leaf_rows: DataFrame, key: list[str]) -> DataFrame:
    """Leaves whose value is a whole list or object, opened to its own leaves."""
    from loreloom.operators.knowledge import leaves

    below = leaves(F.col("value"))
    container = F.coalesce(F.startswith("value", F.lit("{")) | F.startswith("value", F.lit("[")), F.lit(False))
    rows = leaf_rows.select(*key, "path", "value", F.when(container & ~F.col("value").isin("{}", "[]"), below).alias("__below"))
    none = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("ord"), F.col("value").alias("value")))
    return rows.select(*key, "path", F.explode(F.coalesce("__below", none)).alias("b")).select(
        *key, F.concat("path", "b.path").alias("path"), F.col("b.value").alias("value")
    )


def run_pass(leaf_rows: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Leaves after a pass: what the answers patch is written in order, the last write of a path wins.

    Containers that a patch writes are opened again, so the result is path-value form throughout.
    """
    patches = answer_patches(answers, key)
    return open_values(apply_patches(leaf_rows.select(*key, "path", "value"), patches, key), key)


def leaf_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Paths that differ between two versions of documents: ``key``, ``path``, ``old``, ``new``, ``change``."""
    old = before.select(*key, "path", F.col("value").alias("old"), F.lit(True).alias("__old"))
    new = after.select(*key, "path", F.col("value").alias("new"), F.lit(True).alias("__new"))
    joined = old.join(new, [*key, "path"], "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(*key, "path", "old", "new", "change")


def stamp(leaf_rows: DataFrame, field: str, value: Column) -> DataFrame:
    """``value`` in every leaf whose last step is ``field``, with or without a leading underscore."""
    last = F.element_at("path", -1)
    return leaf_rows.withColumn("value", F.when(last.isin(field, f"_{field}"), value).otherwise(F.col("value")))


def resolve_steps(leaf_rows: DataFrame, wanted: DataFrame, key: list[str], *, both_ways: bool) -> DataFrame:
    """Fuzzy paths, level by level: ``wanted`` has ``asked`` (an id) and ``steps``; the result ``key``, ``asked``, ``path``.

    At each level an equal key is taken, else the first that contains the step (``both_ways``: or is contained
    in it), whatever the case; a number takes that place of a list, a negative one counts from its end
    (not with ``both_ways``).  Paths that end nowhere give no row.  The levels are those of the longest path.
    """
    depth = wanted.agg(F.max(F.size("steps"))).first()[0] or 0
    current = wanted.select("asked", "steps", F.array().cast("array<string>").alias("at"))
    found = None
    for level in range(depth):
        children = leaf_rows.where(F.size("path") > level).select(
            *key, F.slice("path", 1, level).alias("at"), F.element_at("path", level + 1).alias("child"), F.element_at("ord", level + 1).alias("ord")
        )
        children = children.distinct()
        sized = children.groupBy(*key, "at").agg(F.count(F.lit(1)).alias("n"))
        step = F.lower(F.element_at("steps", level + 1))
        on = ["at"] if level == 0 else [*key, "at"]
        joined = children.join(sized, [*key, "at"]).join(current.where(F.size("steps") > level), on)
        low = F.lower("child")
        number = step.try_cast("int")
        back = (F.col("n") + number).cast("string") if not both_ways else F.lit(None).cast("string")
        exact = (low == step) | F.coalesce((number < 0) & (F.col("child") == back), F.lit(False))
        within = F.contains(low, step) | (F.contains(step, low) if both_ways else F.lit(False))
        hits = joined.where(exact | (within & number.isNull()))
        best = F.min_by("child", F.struct(~exact, "ord", "child"))
        taken = hits.groupBy(*key, "asked", "steps", "at").agg(best.alias("child"))
        current = taken.select(*key, "asked", "steps", F.concat("at", F.array("child")).alias("at"))
        done = current.where(F.size("steps") == level + 1).select(*key, "asked", F.col("at").alias("path"))
        found = done if found is None else found.unionByName(done)
    return found


def children_of(leaf_rows: DataFrame, key: list[str], depth: int) -> DataFrame:
    """Children at ``depth`` steps below the root: ``key``, ``at``, ``child``, ``kind`` (object, list or value) and ``n`` (their members)."""
    below = leaf_rows.where(F.size("path") > depth).select(
        *key, F.slice("path", 1, depth).alias("at"), F.element_at("path", depth + 1).alias("child"), F.get("path", F.lit(depth + 1)).alias("next"), "value"
    )
    leaf = F.col("next").isNull()
    kind = (
        F.when(F.max(F.when(~leaf, F.rlike("next", F.lit(r"^\d+$")))), "list")
        .when(F.max(~leaf) | F.max(leaf & F.coalesce(F.col("value") == "{}", F.lit(False))), "object")
        .when(F.max(leaf & F.coalesce(F.col("value") == "[]", F.lit(False))), "list")
        .otherwise("value")
    )
    return below.groupBy(*key, "at", "child").agg(kind.alias("kind"), F.count_distinct("next").alias("n"))


__all__ = [
    "answer_patches", "applicable", "children_of", "due_actions", "leaf_changes", "missing_fields", "nodes_of", "open_values",
    "reject_below_values", "resolve_steps", "run_actions", "run_pass", "schema_triggers", "stamp", "work_items",
]
