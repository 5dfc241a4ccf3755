import hashlib
import json
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import nested as N
from loreloom.functions import text as X
from loreloom.operators import upkeep
from loreloom.operators.knowledge import leaf_table
from loreloom.operators.maintenance import gate_rejects, query_rejects
from loreloom.operators.providers import cached_by_seed, stream_tokens
from loreloom.operators.templates import SECTIONS, render, section_template
from loreloom.operators.vectors_text import embed_terms, similar_texts
from loreloom.schema.grammar import Schema, effective_setting, fill_placeholders, inherit
from loreloom.schema.story import STORY
from loreloom.sources.config import Templates, read_settings
from loreloom.sources.documents import clear_log, load_or_create, save_documents
from loreloom.streaming.events import is_top_level, nearest_ancestors, phase_events, step_messages
from loreloom.tools import Parameter, Registry, Tool, parse_call, tool_loop

KEY = ["i"]


def leaves(spark, *documents):
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)]
    return leaf_table(spark.createDataFrame(rows, "i int, d string"), KEY, "d")


def text(rows, *columns):
    return {(r.i, ".".join(r.path), *(r[c] for c in columns)) for r in rows.collect()}


def test_work_items_follow_the_schema(spark):
    doc = {"traits": ["a", None], "status": {"Guild": {"position": []}}, "milestones": [{"title": "x"}], "odd": {"deep": 1}, "relationships": {}}
    items = text(upkeep.work_items(leaves(spark, doc), KEY, "Character", STORY), "kind", "work")
    assert items == {
        (0, "", "Character", "node"), (0, "traits", "list[str]", "update"), (0, "status.Guild", "Position", "node"), (0, "status.Guild.position", "list[str]", "update"),
        (0, "description", "list[str]", "initialise"), (0, "attributes", "list[str]", "initialise"),
        (0, "status.Guild.aliases", "list[str]", "initialise"), (0, "status.Guild.events", "list[str]", "initialise"),
    }


def test_patches_write_and_replace(spark):
    before = leaves(spark, {"a": {"b": 1}, "l": ["x", "y"]}, {"a": {"b": 1}})
    answers = spark.createDataFrame(
        [
            (0, ["a"], 1, '[{"path": "b", "value": {"c": [1, "z"]}}, {"path": "n", "value": null}]', None),
            (0, [], 0, "path: l[1], value: w\npath: a.b, value: 5", None),
            (1, [], 0, "path: a.b, value: 2", " unchanged "),
        ],
        "i int, node_path array<string>, node_ord int, answer string, stop_reason string",
    )
    after = upkeep.run_pass(before, answers, KEY)
    assert text(after, "value") == {(0, "a.b.c.0", "1"), (0, "a.b.c.1", "z"), (0, "a.n", None), (0, "l.0", "x"), (0, "l.1", "w"), (1, "a.b", "1")}
    changes = text(upkeep.leaf_changes(before, after, KEY), "old", "new", "change")
    assert (0, "l.1", "y", "w", "changed") in changes and (0, "a.b", "1", None, "removed") in changes and (0, "a.n", None, None, "added") in changes


def test_writes_below_a_value_are_refused(spark):
    rows = leaves(spark, {"a": "text", "b": {}, "c": {"d": None}})
    patches = spark.createDataFrame([(0, 1, ["a", "x"], "1"), (0, 2, ["b", "x"], "1"), (0, 3, ["c"], "1"), (0, 4, ["c", "d", "e"], "1"), (0, 5, ["c", "d"], "1")], "i int, seq bigint, path array<string>, value string")
    assert text(upkeep.reject_below_values(rows, patches, KEY)) == {(0, "b.x"), (0, "c.d")}


def test_fuzzy_paths_level_by_level(spark):
    rows = leaves(spark, {"Characters": {"Ann Bell": {"traits": ["x", "y"]}, "Ann": {"traits": []}}}, {})
    wanted = spark.createDataFrame(
        [("equal", ["characters", "ANN", "traits"]), ("part", ["char", "bell", "trait", "1"]), ("back", ["char", "bell", "traits", "-1"]), ("whole", ["the characters", "Ann Bell", "traits", "0"]), ("none", ["x"]), ("deep", ["char", "bell", "traits", "0", "z"])],
        "asked string, steps array<string>",
    )
    run = lambda both: {(r.asked, ".".join(r.path)) for r in upkeep.resolve_steps(rows, wanted, KEY, both_ways=both).collect()}
    shared = {("equal", "Characters.Ann.traits"), ("part", "Characters.Ann Bell.traits.1")}
    assert run(True) == shared | {("whole", "Characters.Ann Bell.traits.0")}
    assert run(False) == shared | {("back", "Characters.Ann Bell.traits.1")}


def test_children_and_stamps(spark):
    rows = leaves(spark, {"a": {"x": 1, "y": 2}, "l": [1], "e": {}, "f": [], "v": "t", "_message_node": "1", "s": {"message_node": "2"}})
    got = {(r.child, r.kind, r.n) for r in upkeep.children_of(rows, KEY, 0).collect()}
    assert {("a", "object", 2), ("l", "list", 1), ("e", "object", 0), ("f", "list", 0), ("v", "value", 0)} <= got
    stamped = text(upkeep.stamp(rows, "message_node", F.lit("9")), "value")
    assert {(0, "_message_node", "9"), (0, "s.message_node", "9"), (0, "v", "t")} <= stamped


def test_gates_and_stop_reasons(spark):
    df = spark.createDataFrame([("YES", " no "), ("YES", None), ("Nothing", None), (None, None), ("no", "length")], "a string, s string")
    assert [r[0] for r in df.select(gate_rejects(F.col("a"), F.col("s"))).collect()] == [True, False, True, False, True]
    assert [r[0] for r in df.select(query_rejects(F.col("a"), F.col("s"))).collect()] == [True, False, False, False, True]


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("answer", "patches"),
    [
        ("NO", []), ("", []), (" END_OF_UPDATES", []), ("NOT much", []), (None, None),
        ('{"path": "a", "value": "x, y"}', [("a", '"x, y"', "string")]),
        ('[{"path": "a", "value": [1]}, {"path": 1, "value": 2}, {"value": 3}, 5, {"path": "b", "value": null}]', [("a", "[1]", "list"), ("b", "null", "null")]),
        ("path: a.b, value: True\npath : c , value : -1.5\npath: d, value: say \"hi\"\nnoise", [("a.b", "true", "boolean"), ("c", "-1.5", "float"), ("d", '"say \\"hi\\""', "string")]),
        ('path: a, value: {"k": 1}', [("a", '{"k": 1}', "dict")]), ("[1, 2]", []),
    ],
)
def test_patches_of_answers(spark, answer, patches):
    got = one(spark, X.patches_of, answer)
    assert (got and [tuple(p) for p in got]) == patches or (not got and not patches)


@pytest.mark.parametrize(
    ("answer", "kind", "value"),
    [
        (" 7 ", "int", "7"), ("7.5", "int", None), ("7.5", "float", "7.5"), ("Yes", "bool", "true"), ("off", "bool", "false"), ("a, b,", "list[str]", '["a","b"]'),
        ('["a"]', "list[str]", '["a"]'), ("a", "list[int]", None), ("<think>x</think>{}", "dict[str, int]", "{}"), ("a", "dict[str, int]", None), ('q"', "str", '"q\\""'), (None, "int", None),
    ],
)
def test_typed_answers(spark, answer, kind, value):
    assert one(spark, X.typed_answer, answer, kind) == value


def test_small_functions(spark):
    assert one(spark, lambda t: X.stop_hit(t, ["b", "a"], anywhere=False), "  a b") == "a"
    assert one(spark, lambda t: X.stop_hit(t, ["b", "a"], anywhere=True), "  a b") == "b"
    assert one(spark, X.clock_part, "2024-01-01T10:20:30") == "10:20:30" and one(spark, X.clock_part, "noon") is None
    assert [one(spark, X.template_dialect, t) for t in ("{{ a }}", "{% if a %}", "{a}")] == ["jinja", "jinja", "format"]
    assert one(spark, lambda s, o: X.tool_response(s, o, F.lit('a"b')), "error", "{}") == '{"error": "a\\"b"}'
    df = spark.createDataFrame([(["bb", "a", "cc", "", None, "a"], {"1": "b", "0": "a"}, {"0": "x", "2": "y"})], "n array<string>, m map<string,string>, o map<string,string>")
    row = df.select(
        N.longest_first(N.unique_names(F.col("n"))).alias("a"), N.map_to_list(F.col("m")).alias("b"), N.map_to_list(F.col("o")).alias("c"), N.merged(F.col("m"), F.col("o")).alias("d"),
        N.is_list_map(F.create_map().cast("map<string,string>")).alias("e"), N.list_to_map(F.col("n")).alias("f"), F.length(N.short_id(F.lit(3))).alias("g"), N.seed_of(F.lit(-1), F.lit("x")).alias("h"),
    ).first()
    assert row.a == ["bb", "cc", "a"] and row.b == ["a", "b"] and row.c is None and row.d == {"1": "b", "0": "x", "2": "y"}
    assert row.e is True and row.f["4"] is None and row.g == 8 and row.h >= 0


def test_templates(spark):
    df = spark.createDataFrame([("Ann", ["a", None], {"k": "v"}, ("p", 1)), (None, None, None, None)], "n string, l array<string>, m map<string,string>, s struct<x:string,y:int>")
    columns = {f.name: (F.col(f.name), f.dataType) for f in df.schema.fields}
    run = lambda t: [r[0] for r in df.select(render(t, columns)).collect()]
    assert run("{{ n }}:{% for x in l %}[{{ x }}]{% endfor %}{% if m %}{% for e in m %}{{ e.key }}={{ e.value }}{% endfor %}{% else %}none{% endif %}") == ["Ann:[a][]k=v", ":none"]
    assert run("{{ s.x }}{{ s.y }}") == ["p1", ""] and run("Hi {n}!") == ["Hi Ann!", "Hi !"]
    for broken in ("{{ q }} x", "{% for x in l %}", "{% endif %}", "{% for x in n %}{% endfor %}"):
        assert run(broken) == [broken] * 2
    assert section_template("arcs", {"arcs": "mine"}, {"arcs": "file"}) == "mine" and section_template("arcs", None, {"arcs": "file"}) == "file"
    assert section_template("nothing") == "<EMPTY>" and len(SECTIONS) == 11
    assert T.StringType() == columns["n"][1]


def test_similar_texts_equal_brute_force(spark):
    texts = {1: "the old bridge over the river", 2: "a river and a bridge", 3: "nothing here", 4: "", 5: "bridge bridge"}
    df = spark.createDataFrame([("g", i, t) for i, t in texts.items()], "g string, i int, t string")
    stored = embed_terms(df, ["g", "i"], "t")
    queries = embed_terms(df.where("i in (1, 5)").withColumnRenamed("i", "q"), ["g", "q"], "t")
    got = {}
    for r in similar_texts(queries, stored, ["g"], "q", ["i"], 2).collect():
        got.setdefault(r.q, {})[r.place] = (r.i, r.score)
    assert got[1][1] == (1, 1.0) and got[5] == {1: (5, 1.0), 2: (2, round(2 / (2 * 3**0.5), 6))}


def _similar(texts, asked, k):
    """By brute force: (group, query, item, score, place)."""

    def vectors(rows):
        of = defaultdict(Counter)
        for g, i, t in rows:
            words = [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w) >= 3]
            if g is not None and i is not None and words:
                of[g, i].update(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words)
        return of

    norm = lambda v: sum(n * n for n in v.values()) ** 0.5
    stored, rows = vectors(texts), []
    for (g, q), v in vectors(asked).items():
        scores = [(-round(d / (norm(v) * norm(w)), 6), i) for (h, i), w in stored.items() if g == h and (d := sum(n * w[b] for b, n in v.items()))]
        rows += [(g, q, i, -s, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(rows)


def test_similar_texts_are_the_same_by_list_and_by_place(spark):
    words = ["river", "bridge", "old", "the", "The", "of", "stone", "Ärger", "x1y", "gate"]
    pick = lambda i, n: " ".join(words[(i * 7 + j * j * (i % 3 + 1)) % 10] for j in range(n))
    texts = [("gh"[i % 2], i, pick(i, i % 13)) for i in range(40)] + [("g", 2, "one key, two texts: the gate"), (None, 1, "river"), ("g", None, "river"), ("g", 99, None), ("i", 1, "river")]
    asked = [("gh"[i % 2], i, pick(i + 3, i % 5)) for i in range(12)] + [("g", 4, "the old gate the"), (None, 1, "river"), ("h", None, "river"), ("k", 1, "river")]
    stored = embed_terms(spark.createDataFrame(texts, "g string, i int, t string"), ["g", "i"], "t")
    queries = embed_terms(spark.createDataFrame(asked, "g string, q int, t string"), ["g", "q"], "t")
    for few in (0, 15, 256):
        got = similar_texts(queries, stored, ["g"], "q", ["i"], 3, few).select("g", "q", "i", "score", "place")
        assert sorted(tuple(r) for r in got.collect()) == _similar(texts, asked, 3), few


def test_similar_texts_move_vectors_not_words(spark, moved_bytes):
    texts = [("g%d" % (i % 9), i, " ".join(f"{hash((i, k)) % 10**9:x}" for k in range(400)) + " river") for i in range(90)]
    asked = spark.createDataFrame([(f"g{i}", i, "river") for i in range(9)], "g string, q int, t string")
    stored = embed_terms(spark.createDataFrame(texts, "g string, i int, t string"), ["g", "i"], "t")
    moved = moved_bytes(spark, similar_texts(embed_terms(asked, ["g", "q"], "t"), stored, ["g"], "q", ["i"], 3))
    # A word takes two bytes, not a row.
    assert moved < 4 * 2 * 400 * len(texts), moved


def test_schema_settings_and_files(spark, tmp_path):
    assert fill_placeholders("list[{A}]", {"A": "dict[str, {B}]", "B": "int"}) == "list[dict[str, int]]"
    with pytest.raises(ValueError):
        fill_placeholders("{A}", {"A": "{A}"})
    (tmp_path / "s.json").write_text('{ // types\n "placeholders": {"T": "str"}, "definitions": {"D": {"fields": {"a//b": "{T}"}}}, "subjects": {"d": "D"} /* end */ }')
    schema = Schema.read(str(tmp_path / "s.json"))
    assert list(schema.definitions["D"].fields) == ["a//b"] and schema.subject_types() == {"d": "D"}
    levels = dict(trigger={}, overrides={"summary_prompt_template": "field"}, attributes={"update_prompt_template": "class"}, defaults={"x": 1})
    assert effective_setting("update_prompt_template", field_name="summary", **levels) == "field"
    assert effective_setting("update_prompt_template", **levels) == "class" and effective_setting("x", **levels) == 1 and effective_setting("y", **levels) is None
    assert effective_setting("x", trigger={"x": None}, defaults={"x": 1}) is None
    assert inherit({"a": 1, "update_prompt_template": None}, {"update_prompt_template": "p", "a": 2}) == {"a": 1, "update_prompt_template": "p"}
    path = str(tmp_path / "c" / "settings.json")
    assert read_settings(path, {"a": 1}) == {"a": 1} and not (tmp_path / "c").exists()
    assert read_settings(path, {"a": 1}, write_back=True) == {"a": 1} and read_settings(path, {"a": 2, "b": 3}) == {"a": 1, "b": 3}
    templates = Templates(path, {"u": "mine"})
    assert templates.get("u") == "mine" and templates.get("zz") == "<EMPTY>"
    built = []
    make = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert load_or_create(spark, str(tmp_path / "index"), make).count() == 3
    assert len(built) == 1 and clear_log(spark, str(tmp_path / "index")) and not clear_log(spark, str(tmp_path / "index"))
    doc = {"l": ["a", {"b": []}], "m": {"1": "x"}, "n": None}
    save_documents(leaves(spark, doc), KEY, str(tmp_path / "saved"))
    assert json.loads(spark.read.parquet(str(tmp_path / "saved")).first().doc) == doc


def test_events_steps_and_ancestors(spark):
    planned = spark.createDataFrame([("s", "a", 0), ("s", "b", 1)], "session string, phase string, ord int")
    reports = spark.createDataFrame([("s", "a", 5, "done"), ("s", "a", 9, "error"), ("s", "z", 1, "done")], "session string, phase string, at int, outcome string")
    assert {(r.seq, r.type, r.phase) for r in phase_events(planned, reports).collect()} == {(0, "phase_start", "a"), (1, "phase_done", "a"), (2, "phase_start", "b")}
    steps = spark.createDataFrame([("s", "a", 2, "active", "y"), ("s", "a", 1, "warning", "x")], "session string, phase string, seq int, status string, message string")
    assert [tuple(r) for r in step_messages(steps).collect()] == [("s", "a", "active", "x\ny", True)]
    ids = spark.createDataFrame([("s", p) for p in ("a", "a.b[0].c", "q.r")], "session string, phase string")
    known = spark.createDataFrame([("s", "a"), ("s", "a.b"), ("s", "a.b[0].c")], "session string, phase string")
    assert {(r.phase, r.ancestor) for r in nearest_ancestors(ids, known, ["session"]).collect()} == {("a", None), ("a.b[0].c", "a.b"), ("q.r", None)}
    assert [one(spark, is_top_level, p) for p in ("a", "a.b", "a[0]")] == [True, False, False]


def test_tool_loop_and_streams(spark):
    registry = Registry()
    registry.register(Tool("add", "d", lambda n: n + 1, {"n": Parameter("integer")}))
    asked = []

    def generate(prompt):
        asked.append(prompt)
        return "done" if '<tool_response>3</tool_response>' in prompt else '<tool_call>name: add\narguments: "n": 2</tool_call>'

    assert tool_loop(generate, "go", registry) == ("done", [("add", "ok")]) and len(asked) == 2
    assert len(tool_loop(lambda p: "<tool_call>name: gone</tool_call>", "go", registry, most=3)[1]) == 3
    assert parse_call("none") is None and parse_call("<tool_call>name: a arguments: [1]</tool_call>") == ("a", {})
    assert registry.take_over([Tool("add", "x", print), Tool("new", "x", print)]) == ["new"]
    assert list(stream_tokens(["He", "llo E", "ND", " x"], ["END"])) == ["He", "Hello ", "Hello "] or list(stream_tokens(["He", "llo E", "ND", " x"], ["END"]))[-1] == "Hello "
    assert list(stream_tokens(["a", "b"])) == ["a", "ab"] and list(stream_tokens(["E"], ["END"])) == ["E"]
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "seed int, attempt int, answer string")
    assert {(r.seed, r.answer) for r in cached_by_seed(df, "seed").collect()} == {(1, "a"), (2, "c")}
