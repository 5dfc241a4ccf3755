"""Flat, linked tables from deeply nested documents of a story knowledge base.

One projection opens a document with nested ``transform`` calls that attach the
ancestor's key and the place under it; ``flatten`` joins the arrays and one
``inline`` for each target table emits its rows.  Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions.documents import fields, let, member_name, members, object_text

ROW = "array<struct<kind:string,parent:string,ord:int,child:string>>"
STATES = ("start", "now")
SIDES = ("characters", "groups")
SECTIONS = ("past", "scenes", "events")


def _row(kind: str, parent: Column, ord_: Column, child: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), parent.alias("parent"), ord_.cast("int").alias("ord"), child.alias("child")
    )


def _or_empty(rows: Column, kind: str = ROW) -> Column:
    return F.coalesce(rows.cast(kind), F.array().cast(kind))


_STATE = (
    "struct<who:struct<characters:string,groups:string>,`when`:struct<_message_node:string,message_node:string>>"
)
_SCENE = f"struct<start:{_STATE},now:{_STATE}>"


def scene_nodes(top: Column) -> Column:
    """Of a scene document: its states' message nodes and participants."""

    def rows(scene: Column) -> Column:
        lists = []
        for state in STATES:
            node = scene[state]["when"]
            child = F.coalesce(node["_message_node"], node["message_node"])
            lists.append(F.array(_row("when", F.lit(state), F.lit(0), child)).cast(ROW))
            for side in SIDES:
                lists.append(_named_members(f"{state}.{side}", scene[state]["who"][side]))
        return F.flatten(F.array(*lists))

    return let(F.from_json(top, _SCENE), rows)


def _named_members(parent: str, collection: Column) -> Column:
    return _or_empty(
        F.transform(members(collection), lambda m, i: _row("participant", F.lit(parent), i, member_name(m)))
    )


def character_nodes(top: Column) -> Column:
    """Of a characters document, under ``entries`` or at the top: each one's attributes."""

    def attributes(key: Column, text: Column) -> Column:
        return _or_empty(F.transform(members(text), lambda a, i: _row("attribute", key, i, a["item"])))

    def keyed(people: Column) -> Column:
        return F.flatten(
            F.transform(F.map_entries(people), lambda e: attributes(e["key"], e["value"]["attributes"]))
        )

    def listed(text: Column) -> Column:
        people = F.from_json(text, "array<struct<name:string,attributes:string>>")
        return F.flatten(F.transform(people, lambda p: attributes(p["name"], p["attributes"])))

    person = "map<string,struct<attributes:string>>"
    wrapped = let(
        fields(top, "entries")["entries"],
        lambda text: F.when(F.startswith(text, F.lit("[")), listed(text)).otherwise(keyed(F.from_json(text, person))),
    )
    return F.when(F.array_contains(F.json_object_keys(top), "entries"), wrapped).otherwise(
        keyed(F.from_json(top, person))
    )


_EVENT = "struct<name:string,summary:string>"
_ENTRY = "array<struct<section:string,ord:int,name:string,summary:string>>"


def _section_entries(section: str, text: Column) -> Column:
    """The entries of a section, a list or a keyed map, with their places."""

    def entry(place: Column, name: Column, event: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            place.alias("ord"),
            name.alias("name"),
            event["summary"].alias("summary"),
        )

    def keyed(events: Column) -> Column:
        many = F.transform(
            F.map_entries(events), lambda e, i: entry(i, F.coalesce(e["value"]["name"], e["key"]), e["value"])
        )
        lone = let(F.from_json(text, _EVENT), lambda e: F.array(entry(F.lit(0), e["name"], e)))
        is_lone = F.map_contains_key(events, F.lit("name")) & F.try_element_at(events, F.lit("name")).isNull()
        return F.when(is_lone, lone).otherwise(many)

    def plain(value: Column) -> Column:
        return F.transform(
            members(value),
            lambda m, i: F.struct(
                F.lit(section).alias("section"),
                i.alias("ord"),
                member_name(m).alias("name"),
                F.when(F.startswith(m["item"], F.lit("{")), fields(m["item"], "summary")["summary"]).alias("summary"),
            ),
        )

    return F.when(
        F.startswith(text, F.lit("{")), let(F.from_json(text, f"map<string,{_EVENT}>"), keyed).cast(_ENTRY)
    ).otherwise(plain(text).cast(_ENTRY))


def event_nodes(top: Column) -> Column:
    """Of an events document: the entries of each section and their summaries."""

    def rows(listed: Column) -> Column:
        return F.concat(
            F.transform(listed, lambda e: _row("event", e["section"], e["ord"], e["name"])),
            F.transform(
                listed,
                lambda e: _row("summary", F.concat(e["section"], F.lit("/"), e["name"]), F.lit(0), e["summary"]),
            ),
        )

    opened = let(
        fields(top, *SECTIONS),
        lambda o: F.flatten(
            F.array(*[_or_empty(_section_entries(section, o[section]), _ENTRY) for section in SECTIONS])
        ),
    )
    return let(opened, rows)


#: Subject -> (its projection, the target tables it feeds).
SUBJECTS = {
    "current_scene": (scene_nodes, ("when", "participant")),
    "characters": (character_nodes, ("attribute",)),
    "events": (event_nodes, ("event", "summary")),
}


def _kept(rows: Column) -> Column:
    return F.filter(rows, lambda r: r["parent"].isNotNull() & r["child"].isNotNull() & (r["child"] != ""))


def flat_table(records: DataFrame, kind: str, *, record: str, subject: str, doc: str) -> DataFrame:
    """One target table: ``record``, ``kind``, ``parent``, ``ord``, ``child``.

    Null and empty children give no row but keep their place in ``ord``; unreadable,
    null and empty documents give none; repeated records give repeated rows.
    """
    wanted, project = next((s, p) for s, (p, kinds) in SUBJECTS.items() if kind in kinds)
    rows = F.filter(_kept(let(object_text(F.col(doc)), lambda top: _or_empty(project(top)))), lambda r: r["kind"] == kind)
    return records.where(F.col(subject) == wanted).select(record, F.inline(rows))


def flat_tables(records: DataFrame, *, record: str, subject: str, doc: str) -> DataFrame:
    """All target tables in one pass over the records (see ``flat_table``)."""

    def rows(top: Column) -> Column:
        chosen = F.lit(None).cast(ROW)
        for wanted, (project, _) in SUBJECTS.items():
            chosen = F.when(F.col(subject) == wanted, _or_empty(project(top))).otherwise(chosen)
        return chosen

    return records.select(record, F.inline(_kept(let(object_text(F.col(doc)), rows))))
