import pytest
from pyspark.sql import types as T

from loreloom.schema.grammar import Schema, TypeNode, parse_type, show, validate
from loreloom.schema.story import STORY


def test_nested_types_parse():
    node = parse_type("dict[str, dict[str, list[Bond]]]")
    assert show(node) == "dict[str, dict[str, list[Bond]]]"
    assert node.arguments[1].arguments[1] == TypeNode("list", (TypeNode("Bond"),))


@pytest.mark.parametrize("text", ["", "list[", "dict[str]", "list[a, b]", "a]", "dict[str, x]]"])
def test_bad_types_are_refused(text):
    with pytest.raises(ValueError):
        parse_type(text)


def test_spark_types_and_aliases():
    character = STORY.data_type(parse_type("Character"))
    bonds = character["relationships"].dataType
    assert isinstance(bonds, T.MapType) and isinstance(bonds.valueType, T.ArrayType)
    assert STORY.element("characters").name == "Character"


def test_recursive_definitions_end():
    schema = Schema({"definitions": {"Tree": {"fields": {"name": "str", "parts": "list[Tree]"}}}, "subjects": {"t": "Tree"}})
    assert isinstance(schema.data_type(TypeNode("Tree"))["parts"].dataType.elementType, T.VariantType)
    assert schema.example(TypeNode("Tree"), 3) == {"name": "...", "parts": [{"name": "...", "parts": []}]}
    assert schema.references("Tree") == ["Tree"]


def test_json_schema_and_initial_values():
    definitions = STORY.json_schema_definitions("Scene")
    assert definitions["Scene"]["properties"]["_scene_number"] == {"type": "integer", "readOnly": True}
    assert "_scene_number" not in definitions["Scene"]["required"]
    assert STORY.initial(parse_type("Chapter"))["status"] == "active"


def test_validation_names_paths():
    value = {"title": "t", "starting_scene": "one", "ending_scene": None, "scenes": {}, "summary": "", "extra": 1}
    errors = validate(STORY, parse_type("Chapter"), value)
    assert errors == ["$.status: missing", "$.extra: unexpected", "$.starting_scene: not of type int", "$.scenes: not a list"]
    assert "$.ending_scene: not of type int" in validate(STORY, parse_type("Chapter"), value, strict=True)
