import random
from collections import Counter, defaultdict

import pytest

from loreloom.llm.packing import best_fit_plan, pack


def brute_best_fit(sizes, capacity):
    """Room left in each container by best-fit decreasing, item by item."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= size]
        if fits:
            best = min(fits)
            room.remove(best)
            room.append(best - size)
        else:
            room.append(capacity - size)
    return Counter(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    sizes = [rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(1, 300))]
    load, ranks = Counter(), defaultdict(list)
    for s in best_fit_plan(dict(Counter(sizes)), capacity):
        for i in range(s.count):
            load[s.first_container + i] += s.size
            ranks[s.size].append(s.first_rank + i)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in Counter(sizes).items()}
    assert sorted(load) == list(range(len(load))) and max(load.values()) <= capacity
    assert Counter(capacity - x for x in load.values()) == brute_best_fit(sizes, capacity)


def test_empty_and_bad_plans():
    assert best_fit_plan({}, 10) == []
    with pytest.raises(ValueError):
        best_fit_plan({11: 1}, 10)


def test_pack_places_everything_once(spark, monkeypatch):
    monkeypatch.setattr("loreloom.llm.packing.SLOTS_AT_ONCE", 5)
    sizes = [1, 5, 5, 5, 5, 5, 5, 5, 9, 10, 11, 25, 30, 0, None] + [3] * 40
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc bigint, n bigint, size string")
    rows = pack(df, "doc", "n", 10).collect()
    load, tokens, pieces = Counter(), Counter(), defaultdict(list)
    for r in rows:
        load[r.container_id] += r.n_tokens
        tokens[r.doc] += r.n_tokens
        pieces[r.doc].append((r.piece, r.token_from, r.n_tokens))
    assert max(load.values()) <= 10
    assert tokens == {i: n for i, n in enumerate(sizes) if n}
    assert sorted(pieces[11]) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert all(len(p) == 1 for i, p in pieces.items() if sizes[i] <= 10)
    assert pack(df.limit(0), "doc", "n", 10).count() == 0
