import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.functions import text as X
from loreloom.operators.conversation import first_by_text, interval_tags, messages_of, sentence_chunks
from loreloom.operators.graph import closure, overridden_edges
from loreloom.operators.knowledge import apply_patches, expand_list, leaf_table, pack_list
from loreloom.operators.maintenance import closes, gate_rejects, query_rejects, run_actions
from loreloom.operators.mentions import loose_mentions, quoted_speakers, referred_tokens, speaker_lines, tag_references, whole_word_mentions
from loreloom.operators.vectors import cosine_topk
from loreloom.streaming.events import phase_states, session_states, throttled, weighted_progress


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<think>a</think>b", "b"), ("x<ns:think>a\nb</ns:think> y", "y"), ("a<think>b", ""), ("b</think> c", "c"),
        ("<ns:think>a</think> b", ""), ("a</x:think>b</think>c", ""), (" plain ", " plain "), ("", ""), (None, None),
    ],
)
def test_strip_thinking(spark, text, expected):
    assert one(spark, X.strip_thinking, text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('a\n ```json\n{"x":1}\n``` b', '\n{"x":1}\n'), ('"""q"""', "q"), ("a ``` b ```", "a ``` b ```"), ('{"a": 1}{"b": 2} x', '{"b": 2}'),
        ('x {"a":\n1\n} y', '{"a":\n1\n}'), ('see {"a":{}} ok', 'see {"a":{}} ok'), ('[{"a": 1}, {"b": 2}]', '[{"a": 1}, {"b": 2}]'), ("none", "none"), (None, None),
    ],
)
def test_strip_fences(spark, text, expected):
    assert one(spark, X.strip_fences, text) == expected


def _unfenced(text):
    """The same rule by the regular expressions of another engine."""
    found = (re.search(p, text, re.MULTILINE | re.DOTALL | re.ASCII) for p in X.FENCES)
    return next((m[1] for m in found if m), text)


def test_fences_of_every_text_equal_brute_force(spark, tmp_path):
    from loreloom.plans.conversation import strip_fence

    texts = [
        "He went.", "  indented\n\ttext ", "\n\nlate", "", " ", "1. a", 'a "quoted" word"', '"all"', "a {b} c } d", "x ``` y", "x ```py\nz\n``` y",
        'a """b""" c', '""""""', "``````", "{", "}{", "\u2028line {é}\r\nend", "``` \r\n a```", "a`b``c", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: (r.fenced, r.quoted, r.bare) for r in strip_fence(spark, str(tmp_path)).collect()}
    assert rows == {
        i: (_unfenced(f"```json\n{t}\n```"), _unfenced(f'"""{t}"""'), _unfenced(t)) for i, t in enumerate(texts) if t is not None
    }


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("**Title**\n\nHe went\nhome.\n\n# Head\n\nEnd.", "He went\nhome.\n\n# Head\n\nEnd."),
        ('"All of it.\n \nQuoted."', "All of it.\n\nQuoted."),
        ('Here\'s my response as "Ann":\n\nShe left.', "She left."),
        ("of course, as requested: She left.", "She left."),
        ("Here is a long way home for us all.", "Here is a long way home for us all."),
        ("* **Move**: They left.\n\nThe places:\n\nWords that end as a title does but are a whole lot:", "They left.\n\nWords that end as a title does but are a whole lot:"),
        ("**a bold block of more than eight words stays in the text**", "**a bold block of more than eight words stays in the text**"),
        ("**a bold block of more than eight words that ends in:**", ""),
        ("One\r\n\r\nTwo\rmore", "One\n\nTwo\rmore"),
        ("", ""),
        (None, ""),
        ('"', ""),
    ],
)
def test_meaningful_paragraphs(spark, text, kept):
    assert one(spark, X.meaningful_paragraphs, text) == kept


def test_whole_texts_are_escaped(spark, tmp_path):
    import html

    from loreloom.plans.conversation import escape_whole

    texts = ["x" * 100 + "<b a=\"1\">&'" + "y" * 300 + "<", "&lt;", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    safe = {r.doc_id: r.safe for r in escape_whole(spark, str(tmp_path)).collect()}
    assert safe == {i: t if t is None else html.escape(t) for i, t in enumerate(texts)}


def test_summaries_come_from_metadata_as_whole_texts(spark, tmp_path):
    from loreloom.plans import conversation as C

    long = "It was over. " * 30 + "End."
    rows = [(1, ["A. B.", long, None, "C."], [(False,), (True,), (True,), None])] * 2 + [(2, ["D.", "E."], [(None,)]), (3, ["F."], None)]
    df = spark.createDataFrame(rows, "context_id bigint, messages array<string>, messages_metadata array<struct<is_summary: boolean>>")
    df.write.parquet(str(tmp_path / "retrieval_contexts.parquet"))
    run = lambda query: query(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in run(C.summary_chunks)] == [(1, "1_summary", 1, long, "System", True)]
    kept = {(1, "A."), (1, "B."), (1, "C."), (2, "D."), (2, "E."), (3, "F.")}
    assert {(r.conv_id, r.text) for r in run(C.delete_chunk)} == kept
    assert {(r.conv_id, r.text) for r in run(C.upsert_chunk)} == kept | {(1, long)}
    assert {(r.conv_id, r.message_idx) for r in run(C.tag_chunk) if r.state == "new"} == {(1, 1)}


def test_tool_calls(spark):
    call = "x <tool_call>name: kb.get\narguments: {}</tool_call>"
    assert one(spark, X.tool_call, call.format('{"a": 1}')).arguments == '{"a": 1}'
    assert one(spark, X.tool_call, call.format('"a": 1')).arguments == '{"a": 1}'
    assert one(spark, X.tool_call, call.format("{bad")).arguments == "{}"
    assert one(spark, X.tool_call, "nothing") is None


def test_path_steps(spark):
    assert one(spark, X.path_tokens, 'a.b[0]["c d"]') == ["a", "b", "0", "c d"]
    assert one(spark, X.path_tokens, "") == []


def test_messages_keep_places(spark):
    df = spark.createDataFrame([(1, ["Hi. Yes! ", None, "A\n\nB."])] * 2 + [(2, None), (None, ["x"]), (3, [])], "k bigint, m array<string>")
    rows = messages_of(df, "k", "m")
    assert {(r.conv_id, r.message_idx, r.role) for r in rows.collect()} == {(1, 0, "user"), (1, 2, "user")}
    assert {(r.node, r.text) for r in sentence_chunks(rows).collect()} == {("0_1_1", "Hi."), ("0_1_2", "Yes!"), ("2_1_1", "A"), ("2_2_1", "B.")}


def test_later_interval_wins(spark):
    points = spark.createDataFrame([("g", p) for p in (1, 3, 9)], "g string, p int")
    spans = spark.createDataFrame([("g", "first", 0, 1, 3), ("g", "second", 1, 3, 5), ("g", "empty", 2, 9, 1)], "g string, name string, ord int, lo int, hi int")
    assert {r.p: r.tag for r in interval_tags(points, spans, "g", "p").collect()} == {1: "first", 3: "second", 9: None}


def test_first_by_text_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (1, "a"), (5, None), (4, None)], "i int, t string")
    assert {(r.t, r.i) for r in first_by_text(df, [], "t", "i").collect()} == {("a", 1), (None, 4)}


def test_mentions_are_whole_words(spark):
    texts = spark.createDataFrame([("s", "Ann-Marie met Bob."), ("s", "Annex (bob)"), ("s", "")], "g string, text string")
    names = spark.createDataFrame([("s", "Ann"), ("s", "BOB"), ("s", "ann marie"), ("s", " "), ("t", "Bob"), ("s", ".*")], "g string, name string")
    got = {(r.text, r.name) for r in whole_word_mentions(texts, names, "g").collect()}
    assert got == {("Ann-Marie met Bob.", n) for n in ("Ann", "BOB", "ann marie")} | {("Annex (bob)", "BOB")}


def test_speakers(spark):
    df = spark.createDataFrame(
        [(1, '"Go," said Ann Bell.'), (2, 'Bob asked "why"'), (3, "Ann said nothing"), (4, None), (5, '"Nobody"')], "i int, text string"
    )
    assert {(r.i, r.speaker) for r in quoted_speakers(df, ["i"], "text").collect()} == {(1, "Ann Bell"), (2, "Bob")}
    lines = spark.createDataFrame([(1, "s", "Ann: hi\nnote: no\n bob LEE : yes\n: x"), (2, "s", None), (3, "s", ""), (4, "t", "Ann: hi")], "i int, g string, text string")
    names = spark.createDataFrame([("s", "Ann", "Ann Bell", 1), ("s", "Bob Lee", "Bob Lee", 0), ("s", "ann", "Anna", 3), ("s", "", "x", 0)], "g string, name string, speaker string, ord int")
    assert {(r.i, r.line_no, r.speaker) for r in speaker_lines(lines, names, ["i"], "text", "g").collect()} == {(1, 1, "Ann Bell"), (1, 3, "Bob Lee")}


def test_pronouns_are_tagged_where_they_stand(spark):
    df = spark.createDataFrame([(1, "g", "They saw Ann. Then she, and Bob: he left she, they"), (2, "g", None), (3, "g", ""), (4, "h", "they")], "i int, g string, text string")
    names = spark.createDataFrame([("g", "Ann Bell", "female", 0), ("g", "Bob", "male", 1), ("g", "Cy", None, 2), ("g", "Dee", None, 3)], "g string, name string, sex string, ord int")
    rows = referred_tokens(df, names, ["i"], "text", "g")
    got = {r.i: r.tagged for r in tag_references(rows, ["i"]).collect()}
    assert got == {1: "They [Cy/Dee] saw Ann. Then she, [Ann Bell] and Bob: he [Bob] left she, [Ann Bell] they [Cy/Dee]", 3: "", 4: "they"}


def test_loose_mentions_equal_all_pairs(spark):
    texts = [("g", "The Channel of Annecy"), ("g", "bob"), ("g", ""), ("h", "Ann"), ("g", "o LEE")]
    names = [("g", "Ann Lee"), ("g", "O"), ("g", " "), ("g", "Bobby"), ("h", "nn x")]
    got = {(r.g, r.text, r.name) for r in loose_mentions(spark.createDataFrame(texts, "g string, text string"), spark.createDataFrame(names, "g string, name string"), "g").collect()}
    fits = lambda t, n: any(w in t.lower() for w in (n.lower().split()[0], n.lower().split()[-1]))
    assert got == {(g, t, n) for g, t in texts for k, n in names if g == k and n.strip() and fits(t, n)}


def test_loose_mentions_are_the_same_by_list_and_by_index(spark):
    texts = [(g, a, t) for g in "gh" for a in "ab" for t in ("The Channel of Annecy", "bob", "", "o LEE", "Li\tand lEE", "nix nix")] + [(None, "a", "bob"), ("i", "a", "bob")]
    names = [("g", "Ann Lee"), ("g", "O"), ("g", " "), ("g", "Bobby"), ("h", "nn x"), ("h", "li"), ("h", " Lee Ann "), ("g", "O"), (None, "bob"), ("h", "nix nix")]
    said, called = spark.createDataFrame(texts, "g string, about string, text string"), spark.createDataFrame(names, "g string, name string")
    fits = lambda t, n: any(w in t.lower() for w in (n.lower().split()[0], n.lower().split()[-1]))
    every = sorted({(g, a, t, n) for g, a, t in texts for k, n in names if g and g == k and n.strip() and fits(t, n)})
    for few in (0, 5, 64):
        got = loose_mentions(said, called, "g", few).select("g", "about", "text", "name")
        assert sorted(tuple(r) for r in got.collect()) == every, few


@pytest.mark.parametrize("few", [0, 64])
def test_loose_mentions_move_texts_not_a_text_for_each_word(spark, moved_bytes, few):
    words = lambda i: " ".join(f"{hash((i, k)) % 10**12:x}" for k in range(300))
    texts = [(f"g{i % 9}", words(i) + " Ann") for i in range(90)]
    names = spark.createDataFrame([(f"g{i}", "Ann Lee") for i in range(9)], "g string, name string")
    moved = moved_bytes(spark, loose_mentions(spark.createDataFrame(texts, "g string, text string"), names, "g", few))
    assert moved < 4 * sum(len(t) for _, t in texts), moved


@pytest.mark.parametrize("lo", [0, 3, -700])
def test_long_intervals_need_few_cells(spark, lo):
    from loreloom.operators.conversation import _cells

    for hi in (lo, lo + 1, lo + 255, lo + 256, lo + 70_000, lo + 10**9):
        row = spark.range(1).select(_cells(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")).alias("c")).first()
        assert len(row.c) <= 510 * 4
        spans = sorted((c.cell << (8 * c.level), ((c.cell + 1) << (8 * c.level)) - 1) for c in row.c)
        assert spans[0][0] == lo and spans[-1][1] == hi and all(b + 1 == c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_closure_ends_on_cycles(spark):
    seeds = spark.createDataFrame([("g", "a"), ("h", "x")], "g string, node string")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("h", "q", "r")], "g string, src string, dst string")
    assert {tuple(r) for r in closure(seeds, edges, "g").collect()} == {("g", "a", 0), ("g", "b", 1), ("g", "c", 2), ("h", "x", 0)}


def test_override_keeps_weak_edges_without_strong_ones(spark):
    edges = spark.createDataFrame(
        [("s", "a", "b", 75), ("s", "a", "b", 10), ("s", "a", "c", 74), ("s", "a", "c", None)], "session_id string, src string, dst string, importance int"
    )
    assert {(r.dst, r.importance) for r in overridden_edges(edges).collect()} == {("b", 75), ("c", 74), ("c", None)}


def test_leaves_round_trip_containers(spark):
    doc = {"z": {"a": [1, {"b": "x"}], "e": {}}, "n": None, "l": []}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{}")], "i int, d string")
    got = {(r.i, ".".join(r.path), r.value) for r in leaf_table(df, ["i"], "d").collect()}
    assert got == {(1, "z.a.0", "1"), (1, "z.a.1.b", "x"), (1, "z.e", "{}"), (1, "n", None), (1, "l", "[]"), (3, "", "{}")}


def test_documents_of_any_depth_are_opened(spark):
    deep = {"x": 1.50, "s": "q\"", "e": [], "n": None}
    for _ in range(11):
        deep = {"a": [deep, True]}
    text = json.dumps(deep).replace("1.5", "1.50")
    df = spark.createDataFrame([(1, text), (2, '{"a": 1}')], "i int, d string")
    rows = leaf_table(df, ["i"], "d").collect()
    inner = ".".join(["a.0"] * 11)
    got = {(r.i, ".".join(r.path), r.value) for r in rows}
    assert {(1, f"{inner}.x", "1.50"), (1, f"{inner}.s", 'q"'), (1, f"{inner}.e", "[]"), (1, f"{inner}.n", None), (1, "a.1", "true"), (2, "a", "1")} <= got
    assert len(got) == 4 + 11 + 1 and all(len(r.path) == len(r.ord) for r in rows)


def test_last_patch_wins_and_replaces_below(spark):
    leaves = spark.createDataFrame([(1, ["a", "b"], "0"), (1, ["a", "c"], "0"), (1, ["d"], "0")], "k int, path array<string>, value string")
    patches = spark.createDataFrame(
        [(1, 1, ["d"], "1"), (1, 2, ["d"], "2"), (1, 3, ["a", "b"], "3"), (1, 4, ["a"], "4"), (1, 5, ["a", "x"], "5")], "k int, seq bigint, path array<string>, value string"
    )
    got = {(".".join(r.path), r.value) for r in apply_patches(leaves, patches, ["k"]).collect()}
    assert got == {("d", "2"), ("a", "4"), ("a.x", "5")}


def test_pack_is_the_inverse_of_expand(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, ["c"])], "k int, x array<string>")
    assert {r.k: r["items"] for r in pack_list(expand_list(df, ["k"], "x"), ["k"]).collect()} == {1: ["a", None, "b"], 2: ["c"]}


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr("loreloom.operators.vectors.BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(90, 8)).round(3)
    matrix[5] = matrix[7]
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(matrix)] + [(900, None, 0), (901, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {}
    for r in cosine_topk(df.where("vec_id % 10 = 0 or vec_id = 5"), df, 4).collect():
        got.setdefault(r.query_id, {})[r.place] = r.vec_id
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    for q, best in got.items():
        scores = np.round(unit @ unit[q], 9)
        scores[q] = -9
        assert [best[i] for i in range(1, 5)] == sorted(range(90), key=lambda i: (-scores[i], i))[:4]
    assert set(got) == {*range(0, 90, 10), 5}


def test_decisions(spark):
    assert [one(spark, gate_rejects, t) for t in ("no thanks", "is unchanged", "YES")] == [True, True, False]
    assert [one(spark, query_rejects, t) for t in ("no thanks", " no ", "YES")] == [False, True, False]
    assert one(spark, lambda t: closes(t, F.lit(None).cast("string"), F.lit(3), (4, 10)), "YES") is False
    assert one(spark, lambda t: closes(t, F.lit(None).cast("string"), F.lit(10), (4, 10)), "no") is True


def test_failed_gate_prunes_its_subtree(spark):
    actions = spark.createDataFrame(
        [(1, "a", 0, "gate_check", None), (1, "a", 1, "update", None), (1, "a", 2, "notify", "gate_check_fail"), (1, "a.b", 0, "update", None), (1, "ab", 0, "update", None)],
        "turn int, node string, action_ord int, action string, condition string",
    )
    run = lambda failed: {(r.node, r.action) for r in run_actions(actions, ["turn"], F.lit(failed)).collect()}
    assert run(True) == {("a", "gate_check"), ("a", "notify"), ("ab", "update")}
    assert run(False) == {("a", "gate_check"), ("a", "update"), ("a.b", "update"), ("ab", "update")}


EVENTS = [
    ("s", 1, "phase_start", "old"), ("s", 2, "session_start", None), ("s", 3, "phase_start", "p"), ("s", 4, "phase_start", "p"),
    ("s", 5, "phase_done", "p"), ("s", 6, "phase_done", "p"), ("s", 7, "phase_start", "q"), ("s", 8, "phase_error", "q"), ("s", 9, "phase_start", "r"),
    ("t", 1, "phase_start", "p"), ("t", 2, "session_end", None),
]


def test_fold_resets_on_start(spark):
    events = spark.createDataFrame(EVENTS, "session string, seq bigint, type string, phase string")
    assert {(r.session, r.phase, r.state) for r in phase_states(events).collect()} == {("s", "p", "done"), ("s", "q", "error"), ("s", "r", "active"), ("t", "p", "active")}
    assert {tuple(r) for r in session_states(events).collect()} == {("s", True, 1, 1, 1), ("t", False, 1, 0, 0)}
    weights = spark.createDataFrame([("p", 3), ("q", 1), ("r", 2)], "phase string, weight int")
    assert {r.session: r.percent for r in weighted_progress(phase_states(events), weights).collect()} == {"s": 66.7, "t": 0.0}


def test_throttle_needs_size_and_time(spark):
    rows = [(1, i, 20.0, float(i)) for i in range(12)] + [(2, 0, 1.0, 0.0), (None, 1, 1.0, 1.0), (2, 1, 90.0, 1.0), (2, 2, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, n double, t double")
    got = {tuple(r) for r in throttled(df, "k", "o", F.col("n"), F.col("t"), 50, 3).collect()}
    assert got == {(1, 0), (1, 3), (1, 6), (1, 9), (2, 0), (2, 2)}
