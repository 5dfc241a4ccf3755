import json

import pytest
from pyspark.sql import functions as F

from loreloom.operators.knowledge import leaf_table
from loreloom.operators.providers import FunctionProvider, TableProvider, with_prompt_hash
from loreloom.operators.rendering import assemble, bullets, list_preview, render_entry
from loreloom.sources.documents import read_documents, read_raw_documents, read_snapshot, write_snapshot
from loreloom.tools import KnowledgeBase, Parameter, Registry, Tool, close_arc, knowledge_tools, list_arcs


@pytest.fixture(scope="module")
def kb(spark):
    docs = [(1, json.dumps({"characters": {"Ann": {"traits": ["tall", "kind"]}, "Bob": {"traits": []}}}))]
    return KnowledgeBase(leaf_table(spark.createDataFrame(docs, "s int, d string"), ["s"], "d"), ["s"])


def test_tools_over_a_knowledge_base(kb):
    tools = knowledge_tools(kb)
    calls = []
    tools.on_call(lambda name, status, _: calls.append((name, status)))
    status, rows = tools.execute("get_info", {"path": 'characters["Ann"].traits[0]'})
    assert status == "ok" and [r.value for r in rows.collect()] == ["tall"]
    assert {r.child: r.n_leaves for r in tools.execute("list_paths", {"path": "characters"})[1].collect()} == {"Ann": 2, "Bob": 1}
    assert [r.path for r in tools.execute("search_info", {"query": "KIND"})[1].collect()] == ["characters.Ann.traits.1"]
    changed = tools.execute("set_info", {"path": "characters.Bob", "value": "gone"})[1]
    assert {(r.path, r.value) for r in changed.get("characters.Bob").collect()} == {("characters.Bob", "gone")}
    assert tools.execute("set_info", {"path": "characters", "value": "x"})[0] == "error"
    assert tools.execute("nothing", {}) == ("error", "unknown tool: nothing")
    assert calls[-1] == ("nothing", "error") and len(calls) == 6


def test_arguments_are_checked():
    tool = Tool("t", "d", lambda **k: k, {"n": Parameter("integer"), "c": Parameter("string", required=False, choices=("a", "b"))})
    assert tool.problem({"n": 1, "c": "a"}) is None
    assert [tool.problem(a) for a in ({}, {"n": True}, {"n": "1"}, {"n": 1, "c": "z"}, {"n": 1, "x": 2})] == [
        "missing argument: n", "n is not of type integer", "n is not of type integer", "c is not one of a, b", "unknown argument: x",
    ]
    registry = Registry()
    registry.register(tool)
    with pytest.raises(ValueError):
        registry.register(tool)
    assert registry.unregister("t") and not registry.unregister("t")
    assert tool.described()["function"]["parameters"]["required"] == ["n"]


def test_arcs(spark):
    arcs = spark.createDataFrame(
        [(0, "The Long War", "active", None, "s"), (1, "War", "active", None, None), (2, "Peace", "concluded", 3, "p")],
        "ord int, title string, status string, ending_scene int, summary string",
    )
    closed = {r.ord: (r.status, r.ending_scene, r.summary) for r in close_arc(arcs, "long war", "over", 9).collect()}
    assert closed == {0: ("concluded", 9, "s\n\nConclusion: over"), 1: ("active", None, None), 2: ("concluded", 3, "p")}
    assert {r.status: r.titles for r in list_arcs(arcs).collect()} == {"active": ["The Long War", "War"], "concluded": ["Peace"]}
    assert close_arc(arcs, "nowhere", "x", 1).where("status = 'concluded'").count() == 1


def test_providers(spark):
    prompts = spark.createDataFrame([("a",), ("b",), ("a",)], "prompt string")
    hashed = with_prompt_hash(prompts).where("prompt = 'a'").distinct()
    answers = hashed.select("prompt_hash", F.lit(1).alias("attempt"), F.lit("yes").alias("answer"), F.lit(None).cast("string").alias("stop_reason"))
    got = {(r.answer, r.stop_reason) for r in TableProvider(answers).answer(prompts).collect()}
    assert got == {("yes", None), (None, "UNCHANGED")}
    assert {r.answer for r in FunctionProvider(lambda batch: [p.upper() for p in batch]).answer(prompts).collect()} == {"A", "B"}


def test_rendering(spark):
    df = spark.createDataFrame([("Ann", ["tall", None, " "], []), ("Bob", None, ["x"])], "n string, a array<string>, b array<string>")
    assert [r[0] for r in df.select(bullets(F.col("a"))).collect()] == ["- tall", "<EMPTY>"]
    text = df.select(render_entry(F.col("n"), {"Traits": F.col("a"), "Other": F.col("b")})).collect()
    assert [r[0] for r in text] == ["## Ann\nTraits:\n- tall", "## Bob\nOther:\n- x"]
    numbers = spark.createDataFrame([([str(i) for i in range(22)],)], "x array<string>")
    assert numbers.select(list_preview(F.col("x"))).first()[0].endswith("19, and 2 more")


def test_assembly_follows_the_configured_order(spark):
    sections = spark.createDataFrame([(1, "b", 1, "y"), (1, "a", 0, "x"), (1, "b", 0, "z"), (1, "q", 0, "?")], "k int, section string, ord int, text string")
    order = spark.createDataFrame([("b", 0, "B?"), ("a", 1, "A?")], "section string, section_ord int, prompt string")
    assert assemble(sections, ["k"], order).first().context == "B?\nz\ny\nA?\nx"


def test_documents_and_snapshots(spark, tmp_path):
    (tmp_path / "d.json").write_text('{ // note\n "b": 1, "a": {"c": null} }')
    assert read_documents(spark, str(tmp_path / "d.json"), "b int, a string").first().b == 1
    assert read_documents(spark, str(tmp_path / "none.json"), "b int").count() == 0
    assert json.loads(read_raw_documents(spark, str(tmp_path / "d.json")).first().doc) == {"b": 1, "a": {"c": None}}
    table = str(tmp_path / "table")
    write_snapshot(spark.createDataFrame([("s", "1", 1), ("s", "2", 2)], "session string, snapshot string, v int"), table, ["session", "snapshot"])
    write_snapshot(spark.createDataFrame([("s", "2", 3)], "session string, snapshot string, v int"), table, ["session", "snapshot"])
    assert {r.v for r in read_snapshot(spark, table, session="s").collect()} == {1, 3}
