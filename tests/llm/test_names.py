import itertools
import random

import pytest

from loreloom.llm.name_forms import Comparer, Lexicon, Reader, frame, mentions, tokens_of
from loreloom.llm.names import (
    LEAST_SHARED,
    candidate_forms,
    connected_components,
    link_names,
    q_grams,
    spelling_pairs,
    typed_names,
)

LEXICON = Lexicon.of([("Will", "Wilmarund", "nickname"), ("Capt.", "Captain", "title"), ("Cttee.", "Committee", "abbreviation")])


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("Brimere, Ann", ("ann", "brimere")), ("AnnBrimere", ("ann", "brimere")), ("Capt. Ann  Brimére", ("ann", "brimere")),
        ("Ann 'Annie' T. Brimere", ("ann", "brimere")), ("B. Ann", ("ann", "b")), ("E.P.S.B.", ("@epsb",)), ("The Guild of Kessel", ("guild", "kessel")),
    ],
)
def test_tokens(name, tokens):
    assert tokens_of(name, LEXICON) == tokens


def test_likeness():
    like = lambda a, b, r={}: Comparer(LEXICON, {"k": r}).forms(tokens_of(a, LEXICON), tokens_of(b, LEXICON), "k")
    assert like("Ann Brimere", "Brimere Ann") == 1
    assert like("Wilmarund Brimere", "Will Brimere") > 0.9
    assert like("Ann Brimere", "Ann Brimeree") > 0.85
    assert like("Ann Brimere", "Oswald Brimere") < 0.6
    assert like("Ann Brimere II", "Ann Brimere") == 0
    assert like("First Kessel Guild", "Second Kessel Guild") < 0.66
    assert like("E.P.S.B.", "Ember Point Sickle Brigade") > 0.9
    known = {t: 0.1 for t in ("alden", "aldan", "rudley")}
    assert like("Alden Rudley", "Aldan Rudley") > 0.83 > like("Alden Rudley", "Aldan Rudley", known)


def test_written_names_of_a_statement():
    usual = frozenset({"in", "the"})
    assert mentions("In Kessel they know this cook as Rom, but the papers say Rudello, Rosa.", usual) == ["Kessel", "Rom", "Rudello, Rosa."]
    assert mentions("Guild of Kessel and Thornby met Ann 'Annie' Brimere.", usual) == ["Guild of Kessel and Thornby", "Ann 'Annie' Brimere."]
    assert mentions("", usual) == mentions("nothing here", usual) == []
    long = "A" + "b" * 90
    assert mentions(f"He met {long} Brimere.", usual) == ["He", f"{long} Brimere."]


def test_reading_tells_the_subject_from_what_is_said():
    read = Reader(LEXICON).read
    r = read("Nobody knows why  Ann Brimere goes by Rosy now.", "Rosy")
    assert r.own and "ann brimere" in r.names and "|" in r.words
    r = read("Ann Brimerre is a clock mender from Old Kessel.", "Ann Brimere")
    assert r.words == ["|", "|", "is", "|", "clock", "mender", "from", "^old", "^kessel"]
    assert frame(r.words, frozenset({"is", "from"})) == ("| | is | * from ^", ["clock mender", "^old ^kessel"])
    assert not read("The road was empty.", "Ann Brimere").own


def test_prefix_filter_loses_no_similar_pair(spark, monkeypatch):
    monkeypatch.setattr("loreloom.llm.names.COMMON_GRAMS", 5)
    rng = random.Random(5)
    syllables = ["bri", "mer", "dan", "ko", "lu", "tar", "ve", "sso"]
    forms = sorted({" ".join("".join(rng.choices(syllables, k=2)) for _ in range(rng.randint(1, 3))) for _ in range(120)})
    df = spark.createDataFrame([(i, 1 if i % 2 else 2, "k", f) for i, f in enumerate(forms)], "f bigint, block bigint, kind string, form string")
    got = {(r.f, r.g) for r in candidate_forms(df).collect()}
    for (i, a), (j, b) in itertools.combinations(enumerate(forms), 2):
        x, y = set(q_grams(a)), set(q_grams(b))
        if i % 2 == j % 2 and len(x & y) / len(x | y) >= LEAST_SHARED:
            assert (i, j) in got
        if i % 2 != j % 2:
            assert (i, j) not in got


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (101, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ROWS = [
    ("s1", "Ann Brimere", ["Ann Brimere is a cook from Kessel."], None),
    ("s2", "Brimere, Ann", ["Ann Brimere is a cook from Kessel.", None], None),
    ("s3", "Ann Brimeree", None, None),
    ("s3", "Rosy", ["Rosy is the name people use for Ann Brimere."], None),
    ("s2", "Anna Brimere", ["Anna Brimere is a printer from Thornby."], None),
    ("s1", "Oswald Brimere", ["Not much is known of Oswald Brimere."], None),
    ("s9", "Ann Brimere", [], None),
    ("s1", "…", [], None),
    (None, "Ann Brimere", [], None),
    ("s1", None, [], None),
]


def others():
    """People of thirty other worlds, from whose statements the frames are learned."""
    rng = random.Random(1)
    jobs = ["cook", "printer", *(a + "wright" for a in ("ship", "wheel", "play", "mill", "cart", "plough", "boat", "house", "gate", "bell"))]
    towns = ["Kessel", "Thornby", *(a + "ford" for a in ("Ash", "Salt", "Stone", "Vane", "Gull", "Marrow", "Nettle", "Ember", "Low", "Hollow"))]
    names = ["Tovald Rusk", "Ilse Marn", "Pell Ogden", "Quin Aster"]
    return [(f"o{w}", n, [f"{n} is a {rng.choice(jobs)} from {rng.choice(towns)}."], None) for w in range(30) for n in names]


def test_variants_link_within_their_world(spark):
    states = spark.createDataFrame((ROWS + others()) * 2, "session_id string, entry_key string, description array<string>, world string")
    sessions = spark.createDataFrame(
        [("s1", "w"), ("s2", "w"), ("s3", "w"), ("s3", "w"), ("s9", "other"), ("s8", None)] + [(f"o{w}", f"v{w}") for w in range(30)],
        "session_id string, world_hash string",
    )
    pairs = spelling_pairs(link_names(typed_names(states, sessions, "character", aliases=None), LEXICON)).collect()
    same = ["Ann Brimere", "Ann Brimeree", "Brimere, Ann", "Rosy"]
    assert sorted((r.kind, r.world_hash, r.name_a, r.name_b) for r in pairs) == [("character", "w", a, b) for a, b in itertools.combinations(same, 2)]


def test_no_names(spark):
    states = spark.createDataFrame([], "session_id string, entry_key string, description array<string>")
    sessions = spark.createDataFrame([], "session_id string, world_hash string")
    assert link_names(typed_names(states, sessions, "character", aliases=None), LEXICON).count() == 0
