"""Tools over a knowledge base: a registry with checked arguments, and the six queries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.operators.knowledge import apply_patches, child_counts, get_path, path_text, search

_KINDS: dict[str, tuple[type, ...]] = {
    "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,),
}


@dataclass(frozen=True)
class Parameter:
    """An argument of a tool."""

    kind: str
    description: str = ""
    required: bool = True
    choices: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    """A named function with described arguments."""

    name: str
    description: str
    run: Callable[..., object]
    parameters: dict[str, Parameter] = field(default_factory=dict)

    def problem(self, arguments: dict[str, object]) -> str | None:
        """What is wrong with the arguments, or None."""
        for name, p in self.parameters.items():
            if name not in arguments:
                if p.required:
                    return f"missing argument: {name}"
                continue
            value = arguments[name]
            is_bool = isinstance(value, bool) and p.kind != "boolean"
            if is_bool or not isinstance(value, _KINDS[p.kind]):
                return f"{name} is not of type {p.kind}"
            if p.choices and value not in p.choices:
                return f"{name} is not one of {', '.join(p.choices)}"
        unknown = sorted(set(arguments) - set(self.parameters))
        return f"unknown argument: {unknown[0]}" if unknown else None

    def described(self) -> dict[str, object]:
        """The tool as a JSON function description."""
        properties = {
            n: {"type": p.kind, "description": p.description} | ({"enum": list(p.choices)} if p.choices else {})
            for n, p in self.parameters.items()
        }
        required = [n for n, p in self.parameters.items() if p.required]
        schema = {"type": "object", "properties": properties, "required": required}
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": schema}}


class Registry:
    """Tools by name; a name is taken once."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}
        self._listeners: list[Callable[[str, str, object], None]] = []

    def register(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"tool {tool.name} is registered already")
        self._tools[tool.name] = tool

    def unregister(self, name: str) -> bool:
        return self._tools.pop(name, None) is not None

    def take_over(self, others: list[Tool]) -> list[str]:
        """Register those of ``others`` whose names are free; the names taken over."""
        new = [t for t in others if t.name not in self._tools]
        for tool in new:
            if tool.name not in self._tools:
                self.register(tool)
        return [t.name for t in new]

    def names(self) -> list[str]:
        return list(self._tools)

    def listing(self) -> str:
        return "\n".join(f"- {t.name}({', '.join(t.parameters)}): {t.description}" for t in self._tools.values())

    def on_call(self, listener: Callable[[str, str, object], None]) -> None:
        """Call ``listener(name, status, output)`` after every execution."""
        self._listeners.append(listener)

    def execute(self, name: str, arguments: dict[str, object]) -> tuple[str, object]:
        """Status (ok or error) and the output or message."""
        tool = self._tools.get(name)
        problem = f"unknown tool: {name}" if tool is None else tool.problem(arguments)
        if problem:
            status, output = "error", problem
        else:
            try:
                status, output = "ok", tool.run(**arguments)
            except (ValueError, TypeError, KeyError) as error:
                status, output = "error", str(error)
        for listener in self._listeners:
            listener(name, status, output)
        return status, output


class KnowledgeBase:
    """Path queries over the leaves of a session's documents (``key``, ``path``, ``value``)."""

    def __init__(self, leaf_rows: DataFrame, key: list[str]) -> None:
        self.leaves, self.key = leaf_rows, key

    @staticmethod
    def _steps(path: str) -> list[str]:
        return [s for s in path.replace("[", ".").replace("]", "").replace('"', "").split(".") if s]

    def get(self, path: str) -> DataFrame:
        rows = get_path(self.leaves, self._steps(path))
        return rows.select(*self.key, path_text(F.col("path")).alias("path"), "value")

    def list(self, path: str = "") -> DataFrame:
        return child_counts(self.leaves, self.key, self._steps(path))

    def search(self, query: str, most: int = 10) -> DataFrame:
        return search(self.leaves, self.key, [query.lower()], most)

    def set(self, path: str, value: str) -> KnowledgeBase:
        """A new knowledge base with ``value`` at ``path`` of every document; at least two steps."""
        steps = self._steps(path)
        if len(steps) < 2:
            raise ValueError("a path to set needs at least two steps")
        written = self.leaves.select(*self.key).distinct().select(
            *self.key, F.lit(0).cast("bigint").alias("seq"), F.array(*[F.lit(s) for s in steps]).alias("path"), F.lit(value).alias("value")
        )
        return KnowledgeBase(apply_patches(self.leaves, written, self.key), self.key)


def list_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs by status with their titles in order; ``arcs``: ``ord``, ``title``, ``status``."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda a: a["title"])
    return arcs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), titles.alias("titles"))


def close_arc(arcs: DataFrame, title: str, conclusion: str, last_scene: int) -> DataFrame:
    """``arcs`` with the first one whose title contains, or is contained in, ``title``
    closed: its status, last scene and, unless it is empty, conclusion are set.  No match changes nothing."""
    low, wanted = F.lower("title"), F.lit(title.lower())
    fits = F.contains(low, wanted) | F.contains(wanted, low)
    first = arcs.where(fits & (F.col("title") != "")).agg(F.min("ord").alias("__first"))
    joined = arcs.join(F.broadcast(first), F.col("ord") == F.col("__first"), "left")
    chosen = F.col("__first").isNotNull()
    ending = F.concat(F.coalesce("summary", F.lit("")), F.lit(f"\n\nConclusion: {conclusion}" if conclusion else ""))
    return joined.select(
        "ord",
        "title",
        F.when(chosen, "concluded").otherwise(F.col("status")).alias("status"),
        F.when(chosen, F.lit(last_scene)).otherwise(F.col("ending_scene")).alias("ending_scene"),
        F.when(chosen, ending).otherwise(F.col("summary")).alias("summary"),
    )


class ArcBook:
    """The arcs of a story as tools see them; closing one replaces the table."""

    def __init__(self, arcs: DataFrame, last_scene: int) -> None:
        self.arcs, self.last_scene = arcs, last_scene

    def list(self) -> DataFrame:
        return list_arcs(self.arcs)

    def close(self, title: str, conclusion: str = "") -> DataFrame:
        self.arcs = close_arc(self.arcs, title, conclusion, self.last_scene)
        return self.arcs


def knowledge_tools(kb: KnowledgeBase, book: ArcBook | None = None) -> Registry:
    """The query tools over one knowledge base, and those over its arcs if there are any."""
    registry = Registry()
    path = Parameter("string", "steps joined by dots")
    registry.register(Tool("get_info", "Value at a path.", kb.get, {"path": path}))
    registry.register(Tool("list_paths", "Children of a path.", kb.list, {"path": Parameter("string", "steps", required=False)}))
    registry.register(Tool("search_info", "Leaves that contain a text.", kb.search, {"query": Parameter("string", "text")}))
    registry.register(Tool("set_info", "Write a value.", kb.set, {"path": path, "value": Parameter("string", "text")}))
    if book is not None:
        closing = {"title": Parameter("string", "of the arc"), "conclusion": Parameter("string", "how it ended", required=False)}
        registry.register(Tool("close_arc", "Close a running arc.", book.close, closing))
        registry.register(Tool("list_arcs", "Arcs by status.", book.list))
    return registry


_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.DOTALL)


def parse_call(text: str) -> tuple[str, dict[str, object]] | None:
    """Name and arguments of the first tool call of a text, None without one; arguments that are no object are empty."""
    found = _CALL.search(text)
    name = re.search(r"name:\s*([\w.]+)", found[1]) if found else None
    if name is None:
        return None
    given = re.search(r"arguments:\s*(.*?)\s*$", found[1], re.DOTALL)
    body = given[1] if given else ""
    try:
        arguments = json.loads(body if body.startswith("{") else "{" + body + "}")
    except ValueError:
        arguments = {}
    return name[1], arguments if isinstance(arguments, dict) else {}


def shown(output: object, most: int = 20) -> str:
    """A tool's output as JSON text; of a table its first rows, as a reader of an answer needs no more."""
    if isinstance(output, DataFrame):
        rows = [r.asDict(recursive=True) for r in output.limit(most + 1).collect()]
        return json.dumps({"rows": rows[:most], "more": len(rows) > most}, ensure_ascii=False, default=str)
    return json.dumps(output, ensure_ascii=False, default=str)


def tool_loop(generate: Callable[[str], str], prompt: str, registry: Registry, most: int = 5) -> tuple[str, list[tuple[str, str]]]:
    """Generate, run the tool that the answer calls, append its response, and so on: at most ``most`` calls.

    Returns the last answer and the calls made, each with its status.
    """
    calls: list[tuple[str, str]] = []
    answer = generate(prompt)
    while len(calls) < most:
        call = parse_call(answer)
        if call is None:
            break
        status, output = registry.execute(*call)
        calls.append((call[0], status))
        response = shown(output if status == "ok" else {"error": output})
        prompt = f"{prompt}\n{answer}\n<tool_response>{response}</tool_response>\n"
        answer = generate(prompt)
    return answer, calls
