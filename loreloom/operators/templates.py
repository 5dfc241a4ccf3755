"""Text templates compiled to column expressions.

The dialect: ``{{ name }}``, ``{{ item.field }}``, ``{% for item in name %}`` .. ``{% endfor %}`` and
``{% if name %}`` .. ``{% else %}`` .. ``{% endif %}`` over columns, structs, arrays and maps (items of a map
have ``key`` and ``value``).  A template that cannot be read is returned unchanged, as text; one without
marks of the dialect is a plain format, ``{name}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = re.compile(r"\{\{-?\s*(?P<name>[\w.]+)\s*-?\}\}|\{%-?\s*(?P<tag>[^%]*?)\s*-?%\}")
_FOR = re.compile(r"for (\w+) in ([\w.]+)")
_IF = re.compile(r"if ([\w.]+)")


@dataclass
class _Block:
    kind: str
    name: str = ""
    item: str = ""
    parts: list[object] = field(default_factory=list)
    otherwise: list[object] = field(default_factory=list)


class TemplateError(ValueError):
    """A template that cannot be read."""


def parse_template(text: str) -> list[object]:
    """Pieces of a template: text, names and blocks."""
    root = _Block("root")
    stack: list[tuple[_Block, list[object]]] = [(root, root.parts)]
    at = 0
    for mark in _MARK.finditer(text):
        stack[-1][1].append(text[at : mark.start()])
        at = mark.end()
        if mark["name"]:
            stack[-1][1].append(_Block("name", mark["name"]))
            continue
        tag = mark["tag"]
        if found := _FOR.fullmatch(tag):
            block = _Block("for", found[2], found[1])
        elif found := _IF.fullmatch(tag):
            block = _Block("if", found[1])
        elif tag == "else" and stack[-1][0].kind == "if":
            stack[-1] = (stack[-1][0], stack[-1][0].otherwise)
            continue
        elif tag in ("endfor", "endif") and stack[-1][0].kind == tag[3:]:
            stack.pop()
            continue
        else:
            raise TemplateError(f"unexpected tag: {tag}")
        stack[-1][1].append(block)
        stack.append((block, block.parts))
    stack[-1][1].append(text[at:])
    if len(stack) > 1:
        raise TemplateError(f"unclosed block: {stack[-1][0].kind}")
    return root.parts


def _lookup(name: str, scope: dict[str, tuple[Column, T.DataType]]) -> tuple[Column, T.DataType]:
    head, *rest = name.split(".")
    if head not in scope:
        raise TemplateError(f"unknown name: {head}")
    column, kind = scope[head]
    for step in rest:
        if isinstance(kind, T.StructType) and step in kind.fieldNames():
            column, kind = column[step], kind[step].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
        else:
            raise TemplateError(f"unknown step: {name}")
    return column, kind


def _truth(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(column != "", F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column != 0, F.lit(False))
    return column.isNotNull()


def _compile(parts: list[object], scope: dict[str, tuple[Column, T.DataType]]) -> Column:
    out: list[Column] = []
    for part in parts:
        if isinstance(part, str):
            if part:
                out.append(F.lit(part))
            continue
        column, kind = _lookup(part.name, scope)
        if part.kind == "name":
            shown = F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else column.cast("string")
            out.append(F.coalesce(shown, F.lit("")))
        elif part.kind == "if":
            out.append(F.when(_truth(column, kind), _compile(part.parts, scope)).otherwise(_compile(part.otherwise, scope)))
        else:
            if isinstance(kind, T.MapType):
                column = F.map_entries(column)
                kind = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
            if not isinstance(kind, T.ArrayType):
                raise TemplateError(f"not a list: {part.name}")
            item = kind.elementType
            lines = F.transform(column, lambda x: _compile(part.parts, {**scope, part.item: (x, item)}))  # noqa: B023
            out.append(F.coalesce(F.array_join(lines, ""), F.lit("")))
    return F.concat(*out) if out else F.lit("")


def render(template: str, columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``template`` over ``columns`` (each with its type); unreadable templates come back unchanged."""
    if "{{ " not in template and "{%" not in template:
        text = F.lit(template)
        for name, (column, _) in columns.items():
            text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
        return text
    try:
        return _compile(parse_template(template), columns)
    except TemplateError:
        return F.lit(template)


#: The engine's own templates of the sections of a context; users override them by name.
SECTIONS = {
    "current_scene": "Now: {{ what }}{% if where %} ({{ where }}){% endif %}\n",
    "character_list": "{% for name in names %}- {{ name }}\n{% endfor %}",
    "characters": "## {{ name }}\n{% if description %}{% for line in description %}{{ line }}\n{% endfor %}{% endif %}{% if traits %}Traits:\n{% for line in traits %}- {{ line }}\n{% endfor %}{% endif %}{% if attributes %}Attributes:\n{% for line in attributes %}- {{ line }}\n{% endfor %}{% endif %}",
    "groups": "## {{ name }}\n{% if aliases %}Also: {% for alias in aliases %}{{ alias }}; {% endfor %}\n{% endif %}{% for line in description %}{{ line }}\n{% endfor %}",
    "events": "{% for event in events %}* {{ event }}\n{% endfor %}",
    "scene": "Scene {{ number }}: {{ name }}\n",
    "event": "Event: {{ name }}{% if summary %} - {{ summary }}{% endif %}\n",
    "chapters": "{% for chapter in chapters %}Chapter {{ chapter.number }}: {{ chapter.summary }}\n{% endfor %}",
    "general_info": "{% for entry in info %}{{ entry.key }}: {{ entry.value }}\n{% endfor %}",
    "arcs": "{% for arc in arcs %}Arc: {{ arc.title }} [{{ arc.status }}]\n{% endfor %}",
    "lines": "{% for line in lines %}{{ line }}\n{% endfor %}",
}


def section_template(kind: str, user: dict[str, str] | None = None, stored: dict[str, str] | None = None) -> str:
    """The template of a section: the user's, else the stored one, else the engine's, else ``<EMPTY>``."""
    for source in (user, stored, SECTIONS):
        if source and source.get(kind):
            return source[kind]
    return "<EMPTY>"
