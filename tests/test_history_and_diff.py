import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loreloom.functions.statements import statement_digest
from loreloom.operators import history, running, snapshot_diff
from loreloom.operators.history import attribute_versions, version_rows
from loreloom.operators.snapshot_diff import snapshot_changes
from loreloom.operators.snapshots import snapshot_neighbours

SCHEMA = "s string, q int, k string, at timestamp, x array<string>, kind string"
NOON = dt.datetime(2024, 1, 1, 12)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, sessions=3, span=400):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        seqs = sorted(rng.sample(range(span), 60))
        state = {}
        for q in seqs:
            for k in "abcde":
                if rng.random() < 0.1:
                    state.pop(k, None)
                elif rng.random() < 0.2 or k not in state:
                    state[k] = [rng.choice(["one", "two", "three"])]
            if not state:
                state["a"] = ["one"]
            for k, x in state.items():
                rows.append((f"s{s}", q, k, NOON, x, "c"))
                if rng.random() < 0.1:
                    rows.append((f"s{s}", q, k, NOON - dt.timedelta(hours=1), ["late and wrong"], "c"))
    rng.shuffle(rows)
    return rows


def by_snapshot(rows):
    newest = {}
    for s, q, k, at, x, _ in rows:
        if None not in (s, q, k) and ((s, q, k) not in newest or newest[s, q, k][0] < at):
            newest[s, q, k] = (at, frozenset(v.lower().replace(" ", "") for v in x or [] if v))
    return {key: x for key, (_, x) in newest.items()}


def brute_versions(rows, snaps):
    facts = by_snapshot(rows)
    out = set()
    for s, k in {(s, k) for s, _, k in facts}:
        order = sorted(q for t, q in snaps if t == s)
        i = 0
        while i < len(order):
            if (s, order[i], k) not in facts:
                i += 1
                continue
            j = i
            while j + 1 < len(order) and facts.get((s, order[j + 1], k)) == facts[s, order[i], k]:
                j += 1
            out.add((s, k, order[i], order[j + 1] if j + 1 < len(order) else -1))
            i = j + 1
    return out


def brute_changes(rows, snaps):
    facts = by_snapshot(rows)
    out = set()
    for s in {t for t, _ in snaps}:
        order = sorted(q for t, q in snaps if t == s)
        for p, q in zip(order, order[1:]):
            for k in {k for t, r, k in facts if t == s and r in (p, q)}:
                old, new = facts.get((s, p, k)), facts.get((s, q, k))
                if old != new:
                    out.add((s, q, k, "added" if old is None else "removed" if new is None else "changed"))
    return out


def versions_of(spark, rows, extra=()):
    df = rows_of(spark, rows)
    snaps = df.select("s", "q").unionByName(spark.createDataFrame(list(extra), "s string, q int")) if extra else df.select("s", "q")
    return attribute_versions(df, snaps, session="s", seq="q", entry="k", loaded="at", payload=["x"])


def changes_of(spark, rows):
    df = rows_of(spark, rows)
    return snapshot_changes(
        df, df.select("s", "q"), series=["kind", "s"], seq="q", session="s", key="k", loaded="at", digest=statement_digest(F.col("x"))
    )


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_versions_equal_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(history, "ROUNDS_PER_SHUFFLE", levels)
    rows = random_rows(7)
    snaps = {(r[0], r[1]) for r in rows}
    got = [tuple(r) for r in versions_of(spark, rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_versions(rows, snaps)


def test_rounds_are_pairwise_and_logarithmic(spark, monkeypatch):
    levels = []
    one_round = history.merge_round
    monkeypatch.setattr(history, "merge_round", lambda runs, level, home: levels.append(level) or one_round(runs, level, home))
    rows = [("s", q, "k", NOON, ["same"], "c") for q in range(14)]
    assert [tuple(r) for r in versions_of(spark, rows).collect()] == [("s", "k", 0, -1)]
    assert levels == [1, 2, 3, 4]
    # A round merges pairs: after the first, 14 unit intervals are 7 runs.
    units = spark.createDataFrame([("k", 0, q, q + 1, q - 1, 7) for q in range(14)], "e string, home long, lo long, hi long, before long, digest long")
    first = one_round(units, 1, ["e", "home"])
    assert sorted((r.lo, r.hi) for r in first.collect()) == [(q, q + 2) for q in range(0, 14, 2)]
    assert sorted((r.lo, r.hi) for r in one_round(first, 2, ["e", "home"]).collect()) == [(0, 4), (4, 8), (8, 12), (12, 14)]


def test_versions_of_edge_cases(spark):
    rows = [
        ("s", 5, "k", NOON, ["A"], "c"),
        ("s", 5, "k", NOON, ["A"], "c"),
        ("s", 2**30, "k", NOON, ["a "], "c"),
        ("s", -3, "k", None, None, "c"),
        ("s", 0, None, NOON, ["z"], "c"),
        (None, 1, "k", NOON, ["z"], "c"),
        ("s", None, "k", NOON, ["z"], "c"),
    ]
    got = {tuple(r) for r in versions_of(spark, rows).collect()}
    # Snapshot 0 was delivered without the entry, so nothing holds there.
    assert got == {("s", "k", -3, 0), ("s", "k", 5, -1)}
    assert versions_of(spark, []).count() == 0


def test_a_snapshot_of_another_table_ends_a_version(spark):
    rows = [("s", 1, "k", NOON, ["a"], "c"), ("s", 3, "k", NOON, ["a"], "c")]
    got = {tuple(r) for r in versions_of(spark, rows, extra=[("s", 2)]).collect()}
    assert got == {("s", "k", 1, 2), ("s", "k", 3, -1)}


def test_version_rows_carry_the_payload(spark):
    rows = rows_of(spark, [("s", 1, "k", NOON, ["A"], "c"), ("s", 1, "k", NOON - dt.timedelta(1), ["old"], "c"), ("s", 2, "k", NOON, ["a"], "c")])
    versions = attribute_versions(rows, rows.select("s", "q"), session="s", seq="q", entry="k", loaded="at", payload=["x"])
    full = version_rows(rows, versions, session="s", seq="q", entry="k", loaded="at", keep=["x"])
    assert [tuple(r) for r in full.collect()] == [("s", "k", 1, -1, ["A"])]


@pytest.mark.parametrize(("share", "bits"), [(1 / 12, 2), (1, 10)])
@pytest.mark.parametrize("prefix", ["", "the same long beginning of every key "])
def test_changes_equal_brute_force(spark, monkeypatch, share, bits, prefix):
    monkeypatch.setattr(running, "HOT_SHARE", share)
    monkeypatch.setattr(snapshot_diff, "BLOCK_BITS", bits)
    monkeypatch.setattr(snapshot_diff, "MEAN_CHUNK", 2)
    rows = [(s, q, prefix + k, at, x, c) for s, q, k, at, x, c in random_rows(11)]
    got = [(r.s, r.q, r.k, r.change_kind) for r in changes_of(spark, rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_changes(rows, {(r[0], r[1]) for r in rows})


def test_changes_of_edge_cases(spark):
    assert changes_of(spark, []).count() == 0
    assert changes_of(spark, [("s", 1, "k", NOON, ["a"], "c")]).count() == 0
    rows = [("s", 1, "k", NOON, None, "c"), ("s", 2, "k", NOON, [], "c"), ("s", 2, None, NOON, ["a"], "c"), ("s", 3, "m", NOON, [" "], "c")]
    got = {(r.q, r.k, r.change_kind) for r in changes_of(spark, rows).collect()}
    assert got == {(3, "k", "removed"), (3, "m", "added")}


def test_neighbours_cross_blocks(spark):
    seqs = [-5, 0, 1023, 1024, 5000, 10**9]
    df = spark.createDataFrame([("s", q) for q in seqs] * 2 + [("s", None), (None, 3)], "s string, q int")
    got = {r.q: (r.prev_seq, r.next_seq) for r in snapshot_neighbours(df, "s", "q")[0].collect()}
    assert got == {q: (seqs[i - 1] if i else None, seqs[i + 1] if i + 1 < len(seqs) else None) for i, q in enumerate(seqs)}
