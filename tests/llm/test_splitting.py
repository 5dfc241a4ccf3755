import random

import pytest
from pyspark.sql import functions as F

from loreloom.llm.splitting import RangeMaximum, boundaries, split_items, split_points

import numpy as np


def test_range_maximum_equals_brute_force():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 200)
    table = RangeMaximum(values, 64)
    for _ in range(500):
        i = int(rng.integers(0, 199))
        j = int(rng.integers(i + 1, min(200, i + 64) + 1))
        top = values[i:j].max()
        assert table.best(i, j) == max(k for k in range(i, j) if values[k] == top)


def brute(text, limit, overlap):
    """The same rule by looking at every place of every window."""
    places, strengths = boundaries(text)
    strength = dict(zip(places.tolist(), strengths.tolist()))
    pieces, start = [], 0
    while len(text) - start > limit:
        window = [p for p in range(start + limit // 2, start + limit + 1) if p in strength]
        window = window or [p for p in range(start + overlap + 1, start + limit // 2) if p in strength]
        cut = max(window, key=lambda p: (strength[p], p)) if window else start + limit
        pieces.append((start, cut))
        words = [p for p in range(cut - overlap, cut) if p in strength]
        start = words[0] if words else cut - overlap
    return [*pieces, (start, len(text))]


@pytest.mark.parametrize("seed", range(8))
def test_pieces_equal_brute_force_and_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "a, ", "end. ", "x\n", "y\n\n", "longer-one ", "é😀 ", "“q.” "]) for _ in range(300))
    for limit, overlap in ((100, 20), (60, 0), (1200, 120)):
        pieces = split_points(text, limit, overlap)
        assert pieces == brute(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        assert all(0 < b - a <= limit for a, b in pieces)
        assert all(0 <= b - c <= overlap for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_text_without_boundaries():
    pieces = split_points("x" * 5000, 1200, 120)
    assert pieces[:2] == [(0, 1200), (1080, 2280)] and pieces[-1][1] == 5000
    accents = "é" * 1000
    assert all(accents[b : b + 1] != "́" for _, b in split_points(accents, 101, 10)[:-1])


def test_a_natural_cut_in_the_lower_half_is_taken():
    text = "a" * 560 + ". " + "b" * 900
    assert split_points(text)[0] == (0, 562)
    early = "a" * 100 + " " + "b" * 1300
    assert split_points(early)[0] == (0, 1200)  # shorter than the overlap: no progress is possible there


def test_a_letter_with_many_marks_stays_whole():
    text = "x" * 1150 + "e" + "\u0301" * 100 + "y" * 600
    assert split_points(text)[0] == (0, 1150)
    marks = "\u0301" * 3000
    assert split_points(marks)[-1][1] == 3000


def test_limit_itself_is_one_piece():
    assert split_points("y" * 1200) == [(0, 1200)] and split_points("") == [(0, 0)]
    assert len(split_points("y" * 1201)) == 2
    with pytest.raises(ValueError):
        split_points("a", 100, 50)


def test_items_keep_place_and_metadata(spark):
    long = "One sentence here. " * 200
    rows = [(1, ["short", None, "", long], ["m0", "m1"]), (2, None, None), (3, [], ["m"]), (4, [long], None)]
    df = spark.createDataFrame(rows, "id bigint, items array<string>, meta array<string>")
    got = split_items(df, keep=["id"], items="items", metadata="meta").collect()
    assert {(r.id, r.ord, r.oversized, r.metadata) for r in got} == {(1, 0, False, "m0"), (1, 3, True, None), (4, 0, True, None)}
    pieces = sorted((r.piece_no, r.start, r.text) for r in got if r.id == 4)
    assert all(long[s : s + len(t)] == t for _, s, t in pieces) and len(pieces) == got[-1].n_pieces
    assert split_items(df.limit(0), keep=["id"], items="items", metadata="meta").count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, ["a"], ["m"], "t")], "id bigint, items array<string>, meta array<string>, text string")
    assert split_items(df, keep=["id"], items="items", metadata="meta").select(F.col("text")).first()[0] == "a"
