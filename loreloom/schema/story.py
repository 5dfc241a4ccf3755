"""The engine's own schema of the story subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreloom.schema.grammar import Schema

_ALWAYS = "always"

STORY = Schema(
    {
        "definitions": {
            "Position": {"fields": {"position": "list[str]", "aliases": "list[str]", "events": "list[str]"}},
            "Bond": {
                "fields": {
                    "relation": "str", "status": "str", "aliases": "list[str]", "events": "list[str]", "importance": "int",
                }
            },
            "Bonds": {"type": "alias", "field": "list[Bond]"},
            "Milestone": {"fields": {"title": "str", "scenes": "list[int]", "importance": "int"}},
            "Character": {
                "fields": {
                    "description": "list[str]", "traits": "list[str]", "attributes": "list[str]",
                    "status": "dict[str, Position]", "relationships": "dict[str, Bonds]", "milestones": "list[Milestone]",
                },
                "no_update": ["milestones"],
                "triggers": {_ALWAYS: [{"action": "gate_check"}, {"action": "update"}], "on_new_scene": [{"action": "add_new"}]},
            },
            "Group": {
                "fields": {
                    "aliases": "list[str]", "description": "list[str]", "events": "list[str]",
                    "relationships": "dict[str, Position]", "characters": "dict[str, Position]",
                },
                "triggers": {_ALWAYS: [{"action": "update"}]},
            },
            "Moment": {"fields": {"_message_node": "str", "date": "str", "time": "str", "specific_time": "str"}},
            "Happening": {"fields": {"start": "Moment", "end": "Moment", "summary": "str"}},
            "Presence": {"fields": {"name": "str", "location": "str"}},
            "Who": {"fields": {"characters": "list[Presence]", "groups": "list[Presence]"}},
            "Reason": {"fields": {"name": "str", "details": "str"}},
            "State": {"fields": {"who": "Who", "when": "Moment", "where": "str", "why": "list[Reason]"}},
            "Scene": {
                "fields": {
                    "what": "str", "start": "State", "now": "State",
                    "_scene_number": "int", "_chapter_number": "int", "_arc_number": "int",
                },
                "no_update": ["start"],
                "triggers": {"on_existing_scene": [{"action": "update"}], "on_new_scene": [{"action": "update"}]},
            },
            "Story": {
                "fields": {
                    "past": "dict[str, Happening]", "scenes": "dict[str, Happening]", "events": "dict[str, Happening]",
                    "chapters": "dict[str, Chapter]",
                }
            },
            "Chapter": {
                "fields": {
                    "title": "str", "starting_scene": "int", "ending_scene": "int", "scenes": "list[int]",
                    "summary": "str", "status": "str",
                },
                "defaults": {"status": "active"},
            },
        },
        "subjects": {
            "characters": "dict[str, Character]",
            "groups": "dict[str, Group]",
            "current_scene": "Scene",
            "events": "Story",
        },
    }
)


def field_table(spark: SparkSession, schema: Schema = STORY) -> DataFrame:
    """The schema's catalogue; its size is that of the schema document."""
    return spark.createDataFrame(
        schema.field_rows(), "definition string, kind string, field string, type string, updatable boolean"
    )
