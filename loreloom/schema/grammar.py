"""Type grammar of schema documents and its mapping to Spark types."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

PRIMITIVES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "any": T.VariantType(),
}
JSON_NAMES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


@dataclass(frozen=True)
class TypeNode:
    """A parsed type: a primitive, ``list``, ``dict`` or the name of a definition."""

    name: str
    arguments: tuple[TypeNode, ...] = ()


def parse_type(text: str) -> TypeNode:
    """Parse ``str``, ``list[T]``, ``dict[K, V]`` (nested as deep as need be) or a definition's name."""
    text = text.strip()
    if not text:
        raise ValueError("empty type")
    if "[" not in text:
        if "]" in text or "," in text:
            raise ValueError(f"unbalanced type: {text}")
        return TypeNode(text)
    head, _, rest = text.partition("[")
    if not rest.endswith("]"):
        raise ValueError(f"unbalanced type: {text}")
    parts, depth, begin = [], 0, 0
    inner = rest[:-1]
    for i, c in enumerate(inner):
        depth += (c == "[") - (c == "]")
        if depth < 0:
            raise ValueError(f"unbalanced type: {text}")
        if c == "," and depth == 0:
            parts.append(inner[begin:i])
            begin = i + 1
    parts.append(inner[begin:])
    wanted = {"list": 1, "dict": 2}.get(head.strip())
    if wanted != len(parts) or depth:
        raise ValueError(f"not a type: {text}")
    return TypeNode(head.strip(), tuple(parse_type(p) for p in parts))


@dataclass
class Definition:
    """A definition of a schema: ``dataclass`` with fields or ``alias`` of one type."""

    name: str
    kind: str
    fields: dict[str, TypeNode] = field(default_factory=dict)
    no_update: frozenset[str] = frozenset()
    defaults: dict[str, object] = field(default_factory=dict)
    triggers: dict[str, list[dict]] = field(default_factory=dict)


#: Strings (kept) and comments of a JSON text.
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', re.DOTALL)
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_placeholders(text: str, values: dict[str, str]) -> str:
    """A type text with ``{NAME}`` replaced, also within what replaces it; a name without a value is an error."""
    for _ in range(len(values) + 1):
        if not _PLACEHOLDER.search(text):
            return text
        text = _PLACEHOLDER.sub(lambda m: values[m[1]], text)
    raise ValueError(f"placeholder of itself: {text}")


class Schema:
    """A schema document: definitions and the type of each subject."""

    @staticmethod
    def read(path: str) -> Schema:
        """A schema from a JSON file; lines of comments and comments between values are left out."""
        text = Path(path).read_text(encoding="utf-8")
        return Schema(json.loads(_COMMENT.sub(lambda m: m[1] or "", text)))

    def __init__(self, document: dict) -> None:
        values = document.get("placeholders", {})
        self.definitions: dict[str, Definition] = {}
        for name, body in document.get("definitions", {}).items():
            kind = body.get("type", "dataclass")
            raw = body.get("fields", {}) if kind == "dataclass" else {"value": body["field"]}
            self.definitions[name] = Definition(
                name,
                kind,
                {f: parse_type(fill_placeholders(t, values)) for f, t in raw.items()},
                frozenset(body.get("no_update", ())),
                dict(body.get("defaults", {})),
                dict(body.get("triggers", {})),
            )
        self.subjects = {s: parse_type(fill_placeholders(t, values)) for s, t in document.get("subjects", {}).items()}
        for node in [*self.subjects.values(), *(t for d in self.definitions.values() for t in d.fields.values())]:
            self._check(node)

    def _check(self, node: TypeNode) -> None:
        if node.name not in {"list", "dict", *PRIMITIVES, *self.definitions}:
            raise ValueError(f"unknown type: {node.name}")
        for argument in node.arguments:
            self._check(argument)

    def subject_types(self) -> dict[str, str]:
        """The type of each subject as written."""
        return {s: show(t) for s, t in self.subjects.items()}

    def unwrap(self, node: TypeNode) -> TypeNode:
        """The type behind an alias, through several if need be."""
        seen: set[str] = set()
        while node.name in self.definitions and self.definitions[node.name].kind == "alias":
            if node.name in seen:
                raise ValueError(f"alias of itself: {node.name}")
            seen.add(node.name)
            node = self.definitions[node.name].fields["value"]
        return node

    def element(self, subject: str) -> TypeNode:
        """What a subject's collection holds: the element of a list, the value of a dict."""
        node = self.unwrap(self.subjects[subject])
        return self.unwrap(node.arguments[-1]) if node.name in {"list", "dict"} else node

    def data_type(self, node: TypeNode, within: tuple[str, ...] = ()) -> T.DataType:
        """The Spark type; a definition inside itself becomes VARIANT."""
        node = self.unwrap(node)
        if node.name in PRIMITIVES:
            return PRIMITIVES[node.name]
        if node.name == "list":
            return T.ArrayType(self.data_type(node.arguments[0], within))
        if node.name == "dict":
            return T.MapType(self.data_type(node.arguments[0], within), self.data_type(node.arguments[1], within))
        if node.name in within:
            return T.VariantType()
        inner = (*within, node.name)
        fields = self.definitions[node.name].fields
        return T.StructType(
            [T.StructField(f, self.data_type(t, inner), True, {"internal": True} if f[0] == "_" else None) for f, t in fields.items()]
        )

    def references(self, root: str) -> list[str]:
        """Definitions that ``root`` needs, itself first, each once, in breadth-first order."""
        order, at = [root], 0
        while at < len(order):
            stack = list(self.definitions[order[at]].fields.values())
            while stack:
                node = stack.pop(0)
                stack.extend(node.arguments)
                if node.name in self.definitions and node.name not in order:
                    order.append(node.name)
            at += 1
        return order

    def json_schema(self, node: TypeNode) -> dict:
        """JSON Schema of a type; definitions become references."""
        if node.name in JSON_NAMES:
            return {"type": JSON_NAMES[node.name]}
        if node.name == "any":
            return {}
        if node.name == "list":
            return {"type": "array", "items": self.json_schema(node.arguments[0])}
        if node.name == "dict":
            return {"type": "object", "additionalProperties": self.json_schema(node.arguments[1])}
        return {"$ref": f"#/definitions/{node.name}"}

    def json_schema_definitions(self, root: str) -> dict[str, dict]:
        """JSON Schema of all definitions that ``root`` needs; internal fields are read-only and optional."""
        out = {}
        for name in self.references(root):
            d = self.definitions[name]
            if d.kind == "alias":
                out[name] = self.json_schema(d.fields["value"])
                continue
            properties = {}
            for f, t in d.fields.items():
                properties[f] = self.json_schema(t) | ({"readOnly": True} if f.startswith("_") else {})
            required = [f for f in d.fields if not f.startswith("_")]
            out[name] = {"type": "object", "properties": properties, "required": required}
        return out

    def example(self, node: TypeNode, depth: int = 5) -> object:
        """An example instance; below ``depth`` nested definitions stay empty."""
        node = self.unwrap(node)
        plain = {"str": "...", "int": 0, "float": 0.0, "bool": False, "any": None}
        if node.name in plain:
            return plain[node.name]
        if node.name == "list":
            return [self.example(node.arguments[0], depth - 1)] if depth > 0 else []
        if node.name == "dict":
            return {"name": self.example(node.arguments[1], depth - 1)} if depth > 0 else {}
        if depth <= 0:
            return {}
        return {f: self.example(t, depth - 1) for f, t in self.definitions[node.name].fields.items() if f[0] != "_"}

    def initial(self, node: TypeNode) -> object:
        """The value that a missing field starts with."""
        node = self.unwrap(node)
        empty = {"str": "", "int": 0, "float": 0.0, "bool": False, "any": None, "list": [], "dict": {}}
        if node.name in empty:
            return empty[node.name]
        d = self.definitions[node.name]
        return {f: d.defaults.get(f, self.initial(t)) for f, t in d.fields.items()}

    def field_rows(self) -> list[tuple[str, str, str, str, bool]]:
        """Catalogue rows: definition, kind, field, type, updatable."""
        return [
            (d.name, d.kind, f, show(t), not f.startswith("_") and f not in d.no_update)
            for d in self.definitions.values()
            for f, t in d.fields.items()
        ]


def show(node: TypeNode) -> str:
    return node.name + (f"[{', '.join(show(a) for a in node.arguments)}]" if node.arguments else "")


def validate(schema: Schema, node: TypeNode, value: object, path: str = "$", *, strict: bool = False) -> list[str]:
    """Violations with their paths: missing and unexpected fields, wrong containers, wrong values.

    Without ``strict`` only text where a number or boolean is due counts as a wrong value.
    """
    node = schema.unwrap(node)
    if node.name == "any":
        return []
    if node.name == "list":
        if not isinstance(value, list):
            return [f"{path}: not a list"]
        return [e for i, v in enumerate(value) for e in validate(schema, node.arguments[0], v, f"{path}[{i}]", strict=strict)]
    if node.name == "dict":
        if not isinstance(value, dict):
            return [f"{path}: not an object"]
        return [e for k, v in value.items() for e in validate(schema, node.arguments[1], v, f"{path}.{k}", strict=strict)]
    if node.name in PRIMITIVES:
        kinds = {"str": str, "int": int, "float": (int, float), "bool": bool}[node.name]
        fits = isinstance(value, kinds) and (node.name == "bool" or not isinstance(value, bool))
        wrong = not fits if strict else isinstance(value, str) and node.name != "str"
        return [f"{path}: not of type {node.name}"] if wrong else []
    if not isinstance(value, dict):
        return [f"{path}: not an object"]
    fields = schema.definitions[node.name].fields
    errors = [f"{path}.{f}: missing" for f in fields if f not in value and not f.startswith("_")]
    errors += [f"{path}.{k}: unexpected" for k in value if k not in fields]
    for f, t in fields.items():
        if f in value:
            errors += validate(schema, t, value[f], f"{path}.{f}", strict=strict)
    return errors


#: Settings that a definition takes from the one above if it has none of its own.
INHERITED = ("update_prompt_template", "gate_check_prompt_template", "branch_query_prompt_template", "new_entry_prompt_template")


def effective_setting(
    name: str, *, field_name: str | None = None, trigger: dict | None = None, overrides: dict | None = None, attributes: dict | None = None, defaults: dict | None = None
) -> object:
    """A setting by its levels: the trigger's, the data's own, the data's for this field, the schema's for this field,
    the definition's, its defaults; None if no level has it.  Fields have templates only."""
    of_field = f"{field_name}_prompt_template" if field_name and name.endswith("_prompt_template") else None
    levels = [(trigger, name), (overrides, name), (overrides, of_field), (defaults, of_field), (attributes, name), (defaults, name)]
    for level, key in levels:
        if key is not None and level and key in level and (level is not attributes or level[key] is not None):
            return level[key]
    return None


def inherit(child: dict, parent: dict, names: tuple[str, ...] = INHERITED) -> dict:
    """``child`` with those of ``names`` that it lacks (or has as None) and its parent has."""
    taken = {n: parent[n] for n in names if child.get(n) is None and parent.get(n) is not None}
    return {**child, **taken}
