import random
import re
import unicodedata

import numpy as np
import pytest

from loreloom.llm import quality
from loreloom.llm.quality import fit_type_model, statistics_of, text_statistics, text_types, vote_patterns, with_votes, word_hash

COMMON = ["the", "of", "and", "a", "to", "in", "he", "was", "it", "had", "with", "that", "for", "they", "she", "by"]
PROSE = "He waited by the old bridge, and the rain had not stopped. \"It was the last boat,\" she said. They went in silence to the house of the miller."
TEXTS = {
    1: (PROSE, "prose"),
    2: ((PROSE + " And then it was over for a while.\n") * 2, "prose"),
    3: ("\n".join(f"- a {w} for the road" for w in ("lamp", "rope", "coat", "map", "bell")), "list"),
    4: ("1. well\n2. stair\n3. bell\n4. lantern\n5. door", "list"),
    5: ("name\tplace\tage\nAnn\tKessel\t31\nBob\tThornby\t44\nCy\tAshfall\t29", "table"),
    6: ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "table"),
    7: ("of the gate " * 60, "junk"),
    8: ("3a323ec2b270683fd114d2908e8375c9739cb0501f266941\n" * 6, "junk"),
    9: ("\n".join(f"https://x.invalid/{i}?a={i}" for i in range(9)), "junk"),
    10: (None, None),
    11: ("", None),
    12: (" \n\t ", None),
}


@pytest.fixture(scope="module")
def typed(spark):
    rows = [(i, t, "clash") for i, (t, _) in TEXTS.items()]
    df = spark.createDataFrame(rows * 3, "doc_id bigint, text string, n_words string")
    votes = with_votes(text_statistics(df, "doc_id", "text", COMMON)).cache()
    return text_types(votes, fit_type_model(vote_patterns(votes))).collect()


def test_types(typed):
    assert {(r.doc_id, r.text_type) for r in typed} == {(i, kind) for i, (_, kind) in TEXTS.items()}
    assert len(typed) == 3 * len(TEXTS)


def test_posteriors_and_statistics(typed):
    by_id = {r.doc_id: r for r in typed}
    for r in typed:
        assert abs(r.p_prose + r.p_list + r.p_table + r.p_junk - 1) < 1e-9
    assert by_id[1].n_words == len(PROSE.split()) and by_id[1].n_chars == sum(not c.isspace() for c in PROSE)
    assert by_id[10].n_words == by_id[12].n_words == 0 and by_id[11].common_share == 0


def test_no_documents_and_no_words(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    votes = with_votes(text_statistics(df, "doc_id", "text", []))
    assert text_types(votes, fit_type_model(vote_patterns(votes))).count() == 0


def test_em_recovers_hidden_rates():
    from loreloom.llm.quality import LABELLING_FUNCTIONS

    rng = random.Random(3)
    patterns = {}
    for _ in range(4000):
        kind = rng.choices(["prose", "list", "table", "junk"], [0.6, 0.2, 0.1, 0.1])[0]
        votes = sum((rng.random() < (0.9 if f.target == kind else 0.03)) << i for i, f in enumerate(LABELLING_FUNCTIONS))
        patterns[votes] = patterns.get(votes, 0) + 1
    model = fit_type_model(patterns)
    assert abs(model.prior["prose"] - 0.6) < 0.03
    for f in LABELLING_FUNCTIONS:
        assert abs(model.rate[f.name][f.target] - 0.9) < 0.06


def test_symbols_without_words_are_junk_and_blank_texts_are_not(spark):
    noise = ["=+_#*|-#/::_=+", "|*//^/+_#|.#+~\n#~#-|=|~~-*-^^/~-#\n|-|-|", "- #\n- *\n- ~", "|---|---|\n|---|---|", "...!!"]
    blank = [None, "", " \n", "\u00a0\u3000\n"]
    texts = [PROSE] * 8 + [t for t, kind in TEXTS.values() if kind] + noise + blank
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    votes = with_votes(text_statistics(df, "doc_id", "text", COMMON)).cache()
    patterns = vote_patterns(votes)
    assert sum(patterns.values()) == len(texts) - len(blank)
    types = {r.doc_id: r.text_type for r in text_types(votes, fit_type_model(patterns)).collect()}
    first = len(texts) - len(noise) - len(blank)
    assert [types[first + i] for i in range(len(noise))] == ["junk"] * len(noise)
    assert [types[len(texts) - 1 - i] for i in range(len(blank))] == [None] * len(blank)


def plain_statistics(text):
    """Some statistics by looking at the text character by character."""
    letter = lambda c: unicodedata.category(c)[0] in "LN"
    dark = [c for c in text if c not in " \t\n\x0b\f\r"]
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text)
    pairs = [(a.lower(), b.lower()) for a, b in zip(words, words[1:])]
    lines = [x for x in re.split(r"\r\n|[\n\r\x85\u2028\u2029]", text) if x.strip()]
    ended = [x for x in lines if re.search(r"[.!?…][\"'”’»)\]]*\s*$", x)]
    marks = re.findall(r"(?<=[^\W_\"'”’»)\]])[.!?…]+[\"'”’»)\]]*(?=\s|$)", text)
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_chars": len(dark) if text.strip() else 0,
        "n_words": len(words),
        "distinct_pairs": len(set(pairs)),
        "mean_word_length": share(sum(map(len, words)), len(words)),
        "symbol_share": share(sum(not letter(c) for c in dark), len(dark)),
        "digit_share": share(sum(unicodedata.category(c)[0] == "N" for c in dark), len(dark)),
        "common_share": share(sum(re.split("['’]", w.lower())[0] in COMMON for w in words), len(words)),
        "end_line_share": share(len(ended), len(lines)),
        "mark_rate": share(len(marks), len(words)),
    }


@pytest.mark.parametrize("at_once", [50, 10**6])
def test_statistics_equal_a_plain_count(spark, monkeypatch, at_once):
    monkeypatch.setattr(quality, "CHARS_AT_ONCE", at_once)
    rng = random.Random(4)
    bits = ["the ", "House", " of", "don't ", "’tis ", "x9 ", "é", "ß ", ".", "!\" ", "\n", "\r\n", "\t", "|", "—", " 12", "。", "日本 ", "İ ", "..) "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", " ", PROSE, "a" * 5000]
    known = np.unique(np.array([word_hash(w) for w in COMMON], dtype=np.uint64))
    got = [statistics_of(batch, known) for batch in quality._batches(texts)]
    for name in plain_statistics(""):
        values = np.concatenate([g[name] for g in got])
        for text, value in zip(texts, values, strict=True):
            assert abs(value - plain_statistics(text)[name]) < 1e-9, (name, text)


def test_mean_word_length_leaves_symbols_out():
    facts = statistics_of(["ab — cdef |||"], np.array([], dtype=np.uint64))
    assert facts["mean_word_length"][0] == 3
