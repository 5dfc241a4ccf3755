"""Byte-level BPE encoding of whole corpora in batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array.  In each round the
rank of every neighbouring pair is found by binary search over the sorted pair keys,
every word merges all occurrences of its lowest-ranked pair, and words without a
known pair leave the array.  Merging all occurrences at once equals merging the
leftmost first, as a merged symbol only takes part in pairs of higher rank.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public tokenizer's file lies; every function takes another path.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pre-tokenizing pattern of byte_bpe_50k.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker remembers; beyond that it forgets all and goes on.
CACHED_WORDS = 400_000
#: Characters that a worker encodes at a time.
CHARACTERS_AT_ONCE = 2_000_000

_SHIFT = 20
_NO_RANK = np.iinfo(np.int64).max


@dataclass(frozen=True)
class PairTable:
    """A BPE vocabulary as arrays; its size is fixed by the tokenizer's file."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    bytes for themselves, the others in order from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_pairs(path: str = DEFAULT_VOCABULARY) -> PairTable:
    """Read vocabulary and merges of a byte-level BPE in the ``tokenizers`` JSON format."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
    merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
    keys = (left << _SHIFT) | right
    order = np.argsort(keys, kind="stable")
    byte_ids = np.array([vocabulary[letter] for letter in _byte_letters()], dtype=np.int64)
    return PairTable(byte_ids, keys[order], order.astype(np.int64), merged[order])


def merge_words(words: list[bytes], table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Encode words; returns all ids in one array and the number of ids of each word."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbols = table.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int64), lengths)
    done_ids: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    while symbols.size:
        rank = np.full(symbols.size, _NO_RANK, dtype=np.int64)
        together = np.flatnonzero(owner[:-1] == owner[1:])
        pair = (symbols[together] << _SHIFT) | symbols[together + 1]
        at = np.minimum(np.searchsorted(table.keys, pair), table.keys.size - 1)
        known = table.keys[at] == pair
        together, at = together[known], at[known]
        rank[together] = table.ranks[at]
        place = np.zeros(symbols.size, dtype=np.int64)
        place[together] = at

        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, symbols.size]))
        growing = lowest != _NO_RANK
        if not growing.all():
            done_ids.append(symbols[~growing])
            done_owner.append(owner[~growing])
            symbols, owner, rank, place, lowest = (x[growing] for x in (symbols, owner, rank, place, lowest))
            if not symbols.size:
                break
        hits = np.flatnonzero(rank == lowest)
        # Hits in neighbouring places overlap (a a a): every second one of such a run counts.
        fresh = np.r_[True, np.diff(hits) != 1]
        run_start = hits[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        hits = hits[(hits - run_start) % 2 == 0]
        symbols[hits] = table.merged[place[hits]]
        keep = np.ones(symbols.size, dtype=bool)
        keep[hits + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if not done_ids:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    all_owner = np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return np.concatenate(done_ids)[order], np.bincount(all_owner, minlength=len(words))


class Encoder:
    """Encodes texts with a memory of words; one for each Python worker task."""

    def __init__(self, table: PairTable) -> None:
        self._table = table
        self._split = regex.compile(WORD_PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self._row: dict[str, int] = {}
        self._ids = np.zeros(0, dtype=np.int32)
        self._start = np.zeros(0, dtype=np.int64)
        self._count = np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, counts = merge_words([w.encode("utf-8") for w in words], self._table)
        starts = self._ids.size + np.cumsum(counts) - counts
        self._row.update(zip(words, range(self._start.size, self._start.size + len(words)), strict=True))
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        self._start = np.concatenate([self._start, starts])
        self._count = np.concatenate([self._count, counts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array and the number of ids of each text."""
        split = [self._split(t) if t else [] for t in texts]
        if len(self._row) > CACHED_WORDS:
            self._forget()
        known = self._row
        fresh = {w for words in split for w in words if w not in known}
        if fresh:
            self._learn(list(fresh))
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        rows = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=int(sizes.sum()))
        counts = self._count[rows]
        ends = np.r_[0, np.cumsum(counts)]
        text_ends = ends[np.r_[0, np.cumsum(sizes)]]
        gather = np.arange(ends[-1]) + np.repeat(self._start[rows] - ends[:-1], counts)
        return self._ids[gather], np.diff(text_ends)


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARACTERS_AT_ONCE, never splitting a text."""
    begin, load = 0, 0
    for i, text in enumerate(texts):
        load += len(text or "")
        if load >= CHARACTERS_AT_ONCE:
            yield begin, i + 1
            begin, load = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _mapped(documents: DataFrame, id_column: str, text_column: str, path: str, counts_only: bool) -> DataFrame:
    pairs = documents.sparkSession.sparkContext.broadcast(load_pairs(path))
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pairs.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _portions(texts):
                ids, counts = encoder.encode(texts[begin:end])
                keys = batch.column(0).slice(begin, end - begin)
                if counts_only:
                    value = pa.array(counts, type=pa.int64())
                else:
                    offsets = pa.array(np.r_[0, np.cumsum(counts)], type=pa.int32())
                    value = pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, value], names=["id", "value"])

    kind = "bigint" if counts_only else "array<int>"
    mapped = documents.select(id_column, text_column).mapInArrow(run, f"id {id_type}, value {kind}")
    return mapped


def encode_documents(
    documents: DataFrame, id_column: str, text_column: str, path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``id_column`` and ``ids`` (array of int) of every document, without special tokens.

    A null or empty text gives an empty list; a blank one is encoded as it stands, and
    the spelling of a special token is ordinary text.  The vocabulary is broadcast; its
    size is that of the tokenizer's file, whatever the corpus.
    """
    mapped = _mapped(documents, id_column, text_column, path, counts_only=False)
    return mapped.withColumnsRenamed({"id": id_column, "value": "ids"})


def count_tokens(
    documents: DataFrame, id_column: str, text_column: str, path: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``id_column`` and ``n_tokens`` of every document, as ``encode_documents`` would give them."""
    mapped = _mapped(documents, id_column, text_column, path, counts_only=True)
    return mapped.withColumnsRenamed({"id": id_column, "value": "n_tokens"})
