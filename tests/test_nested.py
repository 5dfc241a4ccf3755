import json

from pyspark.sql import functions as F

from loreloom.functions.documents import members, object_text
from loreloom.operators.nested import flat_table, flat_tables

OBJECT = {"past": {"Raid": {"summary": "It // is \"x\" /* y */ \\"}, "None": None}, "scenes": None}


def texts(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    return {r.i: r.o for r in df.select("i", object_text(F.col("doc")).alias("o")).collect()}


def test_object_is_found_however_wrapped(spark):
    plain, pretty = json.dumps(OBJECT), json.dumps(OBJECT, indent=2, ensure_ascii=False)
    docs = [
        plain,
        "\ufeff" + pretty,
        json.dumps(plain),
        json.dumps(json.dumps(pretty)),
        f"```json\n{pretty}\n```",
        f"Here is the record:\n```\n{plain}\n```\n",
        f"// v2 {{ draft }}\n{plain}",
        f"/* revised {{1}} */ {plain}",
        "{ /* note */" + plain[1:],
        f"[{plain}]",
    ]
    assert all(json.loads(o) == OBJECT for o in texts(spark, docs).values())


def test_documents_without_an_object_give_null(spark):
    whole = json.dumps(OBJECT)
    docs = [None, "", "  ", "NO", "null", "[]", "[1, 2]", '"text"', whole[:-1], whole[: len(whole) // 2], json.dumps(whole)[:-9], "{ draft }"]
    assert set(texts(spark, docs).values()) == {None}


def test_very_long_strings_with_escapes(spark):
    long = {"past": {"A": {"summary": '\\"// ' * 20_000}}}
    assert json.loads(texts(spark, ["{ /* c */ " + json.dumps(long)[1:]])[0]) == long


def test_members_keep_order_and_places(spark):
    docs = ['["b", null, {"name": "a"}]', '{"z": {"x": 1}, "a": null}', '{"name": "lone", "x": 1}', "alone", None, "{}", "[]"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string")
    got = {r.i: r.m for r in df.select("i", members(F.col("doc")).alias("m")).collect()}
    assert [m.item for m in got[0]] == ["b", None, '{"name":"a"}']
    assert [m.key for m in got[1]] == ["z", "a"]
    assert [len(got[i]) for i in (2, 3, 5, 6)] == [1, 1, 0, 0] and got[4] is None


RECORDS = [
    (1, "current_scene", {"start": {"who": {"characters": ["A", None, {"name": "B", "location": None}, ""], "groups": {"G": {"location": "x"}}}, "when": {"message_node": "1_2_3"}}, "now": {"who": {"characters": {"0": {"name": "C"}}, "groups": "Lone"}, "when": {"_message_node": ""}}}),
    (2, "characters", {"entries": {"K": {"attributes": ["x", None, "y"]}, "L": {"attributes": "z"}, "M": {}}}),
    (3, "characters", {"N": {"attributes": {"0": "p", "1": ""}}}),
    (4, "events", {"past": [{"name": "P", "summary": "s"}, {"name": "Q", "summary": None}], "events": {"E": {"summary": "t"}}, "chapters": {"C": {"summary": "no"}}}),
]
EXPECTED = {
    (1, "when", "start", 0, "1_2_3"), (1, "participant", "start.characters", 0, "A"), (1, "participant", "start.characters", 2, "B"),
    (1, "participant", "start.groups", 0, "G"), (1, "participant", "now.characters", 0, "C"), (1, "participant", "now.groups", 0, "Lone"),
    (2, "attribute", "K", 0, "x"), (2, "attribute", "K", 2, "y"), (2, "attribute", "L", 0, "z"), (3, "attribute", "N", 0, "p"),
    (4, "event", "past", 0, "P"), (4, "event", "past", 1, "Q"), (4, "event", "events", 0, "E"),
    (4, "summary", "past/P", 0, "s"), (4, "summary", "events/E", 0, "t"),
}


def test_flat_tables(spark):
    rows = [(i, s, json.dumps(d), "clash") for i, s, d in RECORDS] + [(5, None, "{}", ""), (6, "events", None, ""), (7, "other", "{}", "")]
    df = spark.createDataFrame(rows, "record_id bigint, subject string, doc string, kind string")
    keys = {"record": "record_id", "subject": "subject", "doc": "doc"}
    assert {tuple(r) for r in flat_tables(df, **keys).collect()} == EXPECTED
    for kind in ("when", "participant", "attribute", "event", "summary"):
        assert {tuple(r) for r in flat_table(df, kind, **keys).collect()} == {e for e in EXPECTED if e[1] == kind}
    assert flat_tables(df.limit(0), **keys).count() == 0
