from pathlib import Path

import pytest

from loreloom.llm.tokenizing import DEFAULT_VOCABULARY, Encoder, count_tokens, encode_documents, load_pairs

pytestmark = pytest.mark.skipif(not Path(DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")

TEXTS = [
    "Hello world, it's  us!", "<|endoftext|> a<|endoftext|>", "a" * 3000, "ab" * 2000 + " aaa" * 50, "   ", "\t\n\n x",
    "Ünïcode 漢字 \U0001f3fb​", "don't DON'T 12345 6,7", "", "x", "   y", "q" * 7 + "é" * 9,
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_public_library(reference):
    ids, counts = Encoder(load_pairs()).encode(TEXTS)
    at, want = 0, reference(TEXTS)
    for n, expected in zip(counts, want):
        assert ids[at : at + n].tolist() == expected
        at += n


def test_documents(spark, reference, monkeypatch):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(98, None, ""), (99, "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_documents(df, "doc_id", "text").collect()}
    assert got[98] == got[99] == [] and [got[i] for i in range(len(TEXTS))] == reference(TEXTS)
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr("loreloom.llm.tokenizing.CACHED_WORDS", 2)
    encoder = Encoder(load_pairs())
    for text in TEXTS:
        assert encoder.encode([text])[0].tolist() == reference([text])[0]
