"""Text quality statistics and text types learned from noisy threshold votes.

Statistics are column expressions over whole texts.  Each labelling function is a
threshold on statistics that fires for one type (prose, list, table, junk).  How
often each fires for each type is learned by expectation-maximization over the
agreements of the votes of all documents; a document's type is its posterior.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions.documents import let

TYPES = ("prose", "list", "table", "junk")
#: Characters of texts that are read in one go; a longer text is read by itself.
CHARS_AT_ONCE = 1_000_000

_ITEM = re.compile(
    r"\s*(?:(?:[-–—*•·◦▪‣+]{1,2}|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\[[ xX]?\]|[☐☑✓])\s+\S"
    r"|\d{1,4}\s?[x×]\s+\S)", re.ASCII
)
_INLINE_ITEMS = re.compile(r"\s*\(?\d{1,2}[.)].*[|;,]\s*\(?2[.)]", re.ASCII)
_BARS = re.compile(r"\|[^|]*\|")
_GAP = re.compile(r"[^\s.!?…:;,\"”] {2,}\S", re.ASCII)
_RULE = re.compile(r"[\s|+=-]{5,}", re.ASCII)
_DELIMITED = re.compile(r"[^,;]*(?:[,;](?! )[^,;]*){3,}")
_SHEET = re.compile(r"[^:.!?,;\"]{1,40}:\s*[^\s:][^.!?:]{0,40}", re.ASCII)
_MACHINE = re.compile(
    r"\s*(?:https?://\S+|[0-9a-fA-F]{16,}|[A-Za-z0-9+/=]{32,}|[\[(]?\d[\d:.,/ T-]{4,}[\])]?\s+\S.*|[<{}\[\]].*[>{}\[\];,])\s*",
    re.ASCII,
)
_LEVEL = re.compile(r"\b(?:DEBUG|INFO|WARN|ERROR|FATAL|debug|info|warn|error|fatal)\b[: ]", re.ASCII)
_LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "debug", "info", "warn", "error", "fatal")
_ASSIGNED = re.compile(r"\w=\w+\s+\w+=", re.ASCII)
_CRUMBS = re.compile(r"(?:\S+ > ){2}", re.ASCII)
#: A line of at most so many characters without a sentence end looks like an entry of a list.
SHORT_LINE = 45

#: Classes of code points, as bits.
_LETTER, _DIGIT, _SPACE, _BLANK, _BREAK, _MARK, _CLOSER, _USUAL = (1 << i for i in range(8))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of every code point."""
    bits = np.zeros(0x110000, dtype=np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            bits[code] |= _LETTER
            small = chr(code).lower()
            if len(small) == 1:
                lower[code] = ord(small)
        elif kind[0] == "N":
            bits[code] |= _DIGIT
        elif kind[0] == "Z":
            bits[code] |= _BLANK
    for chars, bit in (
        (" \t\n\x0b\f\r", _SPACE | _BLANK),
        ("\x85", _BLANK),
        ("\n\r\x85\u2028\u2029", _BREAK),
        (".!?…", _MARK),
        ("\"'”’»)]", _CLOSER),
        (".,;:!?'\"()“”‘’«»¿¡…–—-", _USUAL),
    ):
        for c in chars:
            bits[ord(c)] |= bit
    return bits, lower


_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(n: int, factor: int = _FACTOR) -> np.ndarray:
    steps = np.full(n, factor, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Spans:
    """64-bit hashes of spans of a sequence of code points, from one running sum."""

    def __init__(self, codes: np.ndarray) -> None:
        self._shift = _powers(codes.size + 1, _INVERSE)
        self._sums = np.zeros(codes.size + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(codes.size), dtype=np.uint64, out=self._sums[1:])

    def hash(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal spans of equal length have equal hashes wherever they lie."""
        raw = self._sums[ends] - self._sums[begins]
        return (raw * self._shift[begins]) ^ (ends - begins).astype(np.uint64)


def word_hash(word: str) -> int:
    codes = np.frombuffer(word.lower().encode("utf-32-le"), dtype=np.uint32)
    return int(_Spans(codes).hash(np.array([0]), np.array([codes.size]))[0])


def line_shape(line: str, ends: bool) -> str:
    """The shape of one line: machine, list, table, short or "" (running text).

    ``ends`` tells whether it ends as a sentence does.  A plain search for a needed character comes
    before each costly pattern.
    """
    if (
        _MACHINE.fullmatch(line)
        or (any(level in line for level in _LEVELS) and _LEVEL.search(line))
        or ("=" in line and _ASSIGNED.search(line))
        or (" > " in line and _CRUMBS.search(line))
    ):
        return "machine"
    if _ITEM.match(line) or (line.lstrip()[:1] in "(0123456789" and _INLINE_ITEMS.match(line)):
        return "list"
    inner = line.strip(" ")
    if (
        "\t" in inner
        or ("|" in line and _BARS.search(line))
        or ("  " in inner and _GAP.search(line))
        or _RULE.fullmatch(line)
        or (line.count(",") + line.count(";") >= 3 and _DELIMITED.fullmatch(line))
        or (":" in line and _SHEET.fullmatch(line))
    ):
        return "table"
    return "short" if len(inner) <= SHORT_LINE and not ends else ""


#: Statistics in the order of the result, and how they are typed.
STATISTICS = (
    "n_chars", "n_words", "distinct_pairs", "mean_word_length", "symbol_share", "odd_share", "foreign_share", "digit_share",
    "separator_rate", "end_line_share", "common_share", "common_run_share", "mark_rate", "list_share", "table_share",
    "machine_share", "short_share", "repeat_share",
)
_COUNTS = ("n_chars", "n_words", "distinct_pairs")


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=np.asarray(whole) > 0)


def _distinct(document: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct ``values`` by document."""
    mixed = values * np.uint64(_FACTOR) + document.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    first = np.unique(mixed, return_index=True)[1]
    return np.bincount(document[first], minlength=n)


def statistics_of(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of ``texts``; ``common`` are the sorted ``word_hash`` of the frequent words."""
    bits, lower = _tables()
    n = len(texts)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    # A line end after each text parts it from the next.
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    kind = bits[codes]

    def count(mask: np.ndarray) -> np.ndarray:
        """Marked code points of each text."""
        sums = np.zeros(codes.size + 1, dtype=np.int32)
        np.cumsum(mask, dtype=np.int32, out=sums[1:])
        return (sums[ends - 1] - sums[begins]).astype(np.int64)

    is_space = (kind & _SPACE) > 0
    letter = (kind & (_LETTER | _DIGIT)) > 0
    inked = count((kind & _BLANK) == 0)
    n_chars = np.where(inked > 0, lengths - count(is_space), 0)
    other = ~letter & ~is_space

    # Words: runs of letters and digits, with apostrophes between them.
    apostrophe = (codes == ord("'")) | (codes == ord("’"))
    inside = letter.copy()
    inside[1:-1] |= apostrophe[1:-1] & letter[:-2] & letter[2:]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    word_begins, word_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    document = np.searchsorted(ends, word_begins, side="right")
    n_words = np.bincount(document, minlength=n)
    word_chars = np.bincount(document, weights=word_ends - word_begins, minlength=n)
    low = _Spans(lower[codes])
    hashes = low.hash(word_begins, word_ends)
    # A contraction is as common as what stands before its apostrophe.
    heads = word_ends.copy()
    marks = np.flatnonzero(apostrophe & inside)
    if marks.size:
        place = np.searchsorted(word_begins, marks, side="right") - 1
        np.minimum.at(heads, place, marks)
    head_hashes = low.hash(word_begins, heads)
    if common.size:
        spot = np.minimum(np.searchsorted(common, head_hashes), common.size - 1)
        is_common = common[spot] == head_hashes
    else:
        is_common = np.zeros(word_begins.size, dtype=bool)
    same = document[1:] == document[:-1]
    dark = np.zeros(codes.size + 1, dtype=np.int32)
    np.cumsum(~is_space, dtype=np.int32, out=dark[1:])
    adjacent = same & (dark[word_begins[1:]] == dark[heads[:-1]])
    run = is_common[:-1] & is_common[1:] & adjacent
    n_common = np.bincount(document, weights=is_common, minlength=n)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    distinct_pairs = _distinct(document[:-1][same], pairs[same], n)

    # Sentence marks: after a letter or a closing mark, before white space, closing marks aside.
    mark, closer = (kind & _MARK) > 0, (kind & _CLOSER) > 0
    index = np.arange(codes.size, dtype=np.int32)
    past_closers = np.minimum.accumulate(np.where(closer, codes.size - 1, index)[::-1])[::-1]
    mark_edge = np.diff(mark.astype(np.int8), prepend=0, append=0)
    mark_begins, mark_ends = np.flatnonzero(mark_edge == 1), np.flatnonzero(mark_edge == -1)
    good = mark_begins > 0
    good &= letter[mark_begins - 1] | closer[mark_begins - 1]
    good &= is_space[past_closers[np.minimum(mark_ends, codes.size - 1)]]
    n_marks = np.bincount(np.searchsorted(ends, mark_begins[good], side="right"), minlength=n)

    separator = np.zeros(codes.size, dtype=bool)
    separator[:-1] = np.isin(codes[:-1], [ord(c) for c in ";|•·"]) & is_space[1:]

    # Lines that are not blank.
    breaks = np.flatnonzero((kind & _BREAK) > 0)
    line_begins = np.r_[0, breaks[:-1] + 1] if breaks.size else breaks
    ink = np.zeros(codes.size + 1, dtype=np.int32)
    np.cumsum((kind & _BLANK) == 0, dtype=np.int32, out=ink[1:])
    kept = ink[breaks] > ink[line_begins]
    line_begins, line_ends = line_begins[kept], breaks[kept]
    line_document = np.searchsorted(ends, line_begins, side="right")
    n_lines = np.bincount(line_document, minlength=n)
    last_dark = np.maximum.accumulate(np.where(is_space, 0, index))
    last_open = np.maximum.accumulate(np.where(closer | is_space, 0, index))
    at_end = last_dark[line_ends - 1]
    final = np.where(closer[at_end], last_open[at_end], at_end)
    ended = mark[final] & (final >= line_begins)
    trimmed_begins = np.minimum.accumulate(np.where(codes == 32, codes.size - 1, index)[::-1])[::-1][line_begins]
    trimmed_ends = np.maximum.accumulate(np.where(codes == 32, 0, index))[line_ends - 1] + 1
    lines = _Spans(codes).hash(trimmed_begins, trimmed_ends)
    distinct_lines = _distinct(line_document, lines, n)
    size = line_ends - line_begins
    whole = np.bincount(line_document, weights=size, minlength=n)
    shapes = np.array(
        [line_shape(joined[a:b], e) for a, b, e in zip(line_begins.tolist(), line_ends.tolist(), ended.tolist(), strict=True)], dtype=object
    )

    def in_lines(shape: str) -> np.ndarray:
        return _share(np.bincount(line_document, weights=size * (shapes == shape), minlength=n), whole)

    repeated = np.maximum(
        np.where(n_words > 1, 1 - _share(distinct_pairs, n_words), 0.0),
        np.where(n_lines > 1, 1 - _share(distinct_lines, n_lines), 0.0),
    )
    return {
        "n_chars": n_chars,
        "n_words": n_words,
        "distinct_pairs": distinct_pairs,
        "mean_word_length": _share(word_chars, n_words),
        "symbol_share": _share(count(other), n_chars),
        "odd_share": _share(count(other & ((kind & _USUAL) == 0)), n_chars),
        "foreign_share": _share(count(codes > 0x7F), n_chars),
        "digit_share": _share(count((kind & _DIGIT) > 0), n_chars),
        "separator_rate": _share(count(separator), n_words),
        "end_line_share": _share(np.bincount(line_document, weights=ended, minlength=n), n_lines),
        "common_share": _share(n_common, n_words),
        "common_run_share": _share(np.bincount(document[:-1][run], minlength=n), n_common),
        "mark_rate": _share(n_marks, n_words),
        "list_share": in_lines("list"),
        "table_share": in_lines("table"),
        "machine_share": in_lines("machine"),
        "short_share": np.where(n_lines > 2, in_lines("short"), 0.0),
        "repeat_share": repeated,
    }


def _batches(texts: list[str]) -> Iterable[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHARS_AT_ONCE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def text_statistics(documents: DataFrame, id_column: str, text_column: str, common: list[str]) -> DataFrame:
    """Per-document statistics: one row for each row of ``documents``, any text.

    Columns: ``id_column``, ``n_chars`` (without white space), ``n_words``,
    ``distinct_pairs`` (different pairs of neighbouring words), ``mean_word_length`` (characters of words for
    each word), ``symbol_share`` (characters that are neither letters nor digits), ``odd_share`` (those of them that are
    no usual punctuation either), ``foreign_share`` (characters beyond
    ASCII), ``digit_share``, ``separator_rate`` (semicolons, bars and bullets for each
    word), ``end_line_share`` (lines ending in punctuation), ``common_share`` (words in
    ``common``), ``common_run_share`` (of common words, those followed by another),
    ``mark_rate`` (sentence ends for each word), ``list_share``, ``table_share``,
    ``machine_share`` and ``short_share`` (characters in lines of that shape) and
    ``repeat_share`` (of lines or word pairs, the repeats).
    Null, empty and blank texts have zeros.

    Texts cross to Python in Arrow batches and are read as arrays of code points: classes by one table,
    words and lines as spans with running hashes, frequent words by binary search over their hashes.
    """
    known = np.unique(np.array([word_hash(w) for w in common], dtype=np.uint64))
    schema = ", ".join(f"{name} {'bigint' if name in _COUNTS else 'double'}" for name in STATISTICS)

    @F.pandas_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def facts(texts: pd.Series) -> pd.DataFrame:
        plain = ["" if t is None else t for t in texts]
        parts = [statistics_of(batch, known) for batch in _batches(plain)]
        return pd.DataFrame({name: np.concatenate([p[name] for p in parts]) if parts else [] for name in STATISTICS})

    read = documents.select(F.col(id_column).alias("__id"), facts(F.col(text_column)).alias("__facts"))
    return read.select(F.col("__id").alias(id_column), *[F.col(f"__facts.{name}").alias(name) for name in STATISTICS])


@dataclass(frozen=True)
class LabellingFunction:
    """A vote for ``target`` where ``test`` holds; ``trust`` is the initial rate for its type."""

    name: str
    target: str
    test: Callable[[], Column]
    trust: float = 0.7


def _c(name: str) -> Column:
    return F.col(name)


def _loops() -> Column:
    """Few word pairs over and over: such a text votes for prose nowhere.

    A text of n words that goes on saying new things has far more different pairs than the square root of n.
    """
    return (_c("repeat_share") > 0.75) & (_c("distinct_pairs") < 4 * F.sqrt("n_words"))


def _symbols_only() -> Column:
    """Neither letter nor digit: such a text is no prose, and its bars and dashes hold no list or table."""
    return (_c("n_chars") > 0) & (_c("n_words") == 0)


LABELLING_FUNCTIONS = (
    LabellingFunction("prose_marks", "prose", lambda: _c("mark_rate").between(0.02, 0.34) & ~_loops() & ~_symbols_only()),
    LabellingFunction("prose_words", "prose", lambda: _c("common_share").between(0.2, 0.64) & ~_loops() & ~_symbols_only()),
    LabellingFunction("prose_lines", "prose", lambda: (_c("end_line_share") >= 0.4) & ~_loops() & ~_symbols_only()),
    LabellingFunction(
        "prose_shape",
        "prose",
        lambda: (_c("list_share") + _c("table_share") + _c("machine_share") + _c("short_share") < 0.3)
        & (_c("odd_share") < 0.03)
        & ((_c("separator_rate") < 0.1) | (_c("mark_rate") > 0.03))
        & ~_loops() & ~_symbols_only(),
    ),
    LabellingFunction(
        "prose_text",
        "prose",
        lambda: _c("mean_word_length").between(3, 8) & (_c("symbol_share") <= 0.1) & ~_loops() & ~_symbols_only(),
    ),
    LabellingFunction(
        "junk_dense", "junk", lambda: ((_c("mean_word_length") > 12) | (_c("symbol_share") > 0.4)) & (_c("table_share") < 0.5), 0.3
    ),
    LabellingFunction("list_items", "list", lambda: (_c("list_share") > 0.5) & ~_symbols_only()),
    LabellingFunction("list_short", "list", lambda: (_c("short_share") > 0.5) & ~_symbols_only(), 0.3),
    LabellingFunction(
        "list_some", "list", lambda: (_c("list_share") + _c("short_share") > 0.5) & ~_symbols_only()
    ),
    LabellingFunction(
        "list_inline",
        "list",
        lambda: (_c("separator_rate") > 0.08) & (_c("mark_rate") < 0.03) & (_c("table_share") < 0.5),
        0.2,
    ),
    LabellingFunction("table_rows", "table", lambda: (_c("table_share") > 0.5) & ~_symbols_only()),
    LabellingFunction("table_digits", "table", lambda: (_c("table_share") > 0.3) & (_c("digit_share") > 0.03), 0.4),
    LabellingFunction("table_plain", "table", lambda: (_c("table_share") > 0.5) & (_c("mark_rate") < 0.02) & ~_symbols_only(), 0.6),
    LabellingFunction("junk_machine", "junk", lambda: _c("machine_share") > 0.5, 0.3),
    LabellingFunction(
        "junk_symbols", "junk", lambda: ((_c("odd_share") > 0.2) & (_c("table_share") < 0.5)) | _symbols_only(), 0.3
    ),
    LabellingFunction("junk_foreign", "junk", lambda: (_c("foreign_share") > 0.25) & (_c("common_share") < 0.1), 0.3),
    LabellingFunction("junk_loops", "junk", lambda: _loops() & (_c("n_words") >= 6), 0.3),
    LabellingFunction(
        "junk_rare",
        "junk",
        lambda: (_c("common_share") < 0.08)
        & (_c("n_words") >= 8)
        & (_c("list_share") + _c("table_share") + _c("short_share") < 0.3),
        0.4,
    ),
    LabellingFunction("junk_heap", "junk", lambda: (_c("common_share") > 0.66) & (_c("n_words") >= 20), 0.3),
    LabellingFunction("junk_unmarked", "junk", lambda: (_c("common_run_share") > 0.64) & (_c("n_words") >= 20), 0.3),
)


@dataclass(frozen=True)
class TypeModel:
    """Prior of each type and the rate at which each labelling function fires for it."""

    names: tuple[str, ...]
    prior: dict[str, float]
    rate: dict[str, dict[str, float]]


def fit_type_model(patterns: dict[int, int], rounds: int = 60) -> TypeModel:
    """Expectation-maximization over vote patterns (bit i is the vote of function i) and their numbers of documents.

    Votes are taken as independent given the type; the starting rates say what each
    function is for, the agreements of the votes set the rest.  Rates are smoothed and
    a function's rate for its own type stays above that for any other type, so that
    types keep their meaning.  No pattern at all gives the starting rates.
    """
    functions = LABELLING_FUNCTIONS
    own = np.array([[t == f.target for t in TYPES] for f in functions])
    start = np.where(own, np.array([f.trust for f in functions])[:, None], 0.04)
    prior = np.array([0.7 if t == "prose" else 0.1 for t in TYPES])
    rate = start.copy()
    masks = np.array(sorted(patterns), dtype=np.int64)
    counts = np.array([patterns[int(m)] for m in masks], dtype=float)
    votes = ((masks[:, None] >> np.arange(len(functions))) & 1).astype(float)
    for _ in range(rounds if patterns else 0):
        score = np.log(prior) + votes @ np.log(rate) + (1 - votes) @ np.log(1 - rate)
        weights = np.exp(score - score.max(axis=1, keepdims=True))
        weights *= (counts / weights.sum(axis=1))[:, None]
        total = 1 + weights.sum(axis=0)
        fired = 2 * start + votes.T @ weights
        prior = total / total.sum()
        learned = np.clip(fired / (total + 1), 0.002, 0.99)
        other = np.where(own, 0, learned).max(axis=1)
        floor = np.minimum(other * 1.1, other + 0.02)
        rate = np.where(own, np.minimum(0.99, np.maximum(learned, floor[:, None])), learned)
    return TypeModel(
        tuple(f.name for f in functions),
        {t: float(prior[j]) for j, t in enumerate(TYPES)},
        {f.name: {t: float(rate[i, j]) for j, t in enumerate(TYPES)} for i, f in enumerate(functions)},
    )


def with_votes(statistics: DataFrame) -> DataFrame:
    """The statistics with one boolean column ``vote_...`` for each labelling function."""
    return statistics.select("*", *[f.test().alias(f"vote_{f.name}") for f in LABELLING_FUNCTIONS])


def vote_patterns(votes: DataFrame) -> dict[int, int]:
    """Documents by vote pattern, bit i for function i.

    The count runs over all documents that are not blank and is combined before the shuffle.  There
    are at most 2^functions patterns (a million, 16 bytes each), whatever the size of the corpus.
    """
    mask = F.lit(0)
    for i, f in enumerate(LABELLING_FUNCTIONS):
        mask = mask + F.when(F.col(f"vote_{f.name}"), 1 << i).otherwise(0)
    counted = votes.where(F.col("n_chars") > 0).groupBy(mask.alias("mask")).count().collect()
    return {r["mask"]: r["count"] for r in counted}


def text_types(votes: DataFrame, model: TypeModel) -> DataFrame:
    """``votes`` with the posterior of each type (``p_...``) and the likeliest ``text_type``.

    A null or blank document has type null; one of symbols alone has a type.
    """
    scores = []
    for t in TYPES:
        score = F.lit(math.log(model.prior[t]))
        for name in model.names:
            rate = model.rate[name][t]
            score = score + F.when(F.col(f"vote_{name}"), F.lit(math.log(rate))).otherwise(F.lit(math.log(1 - rate)))
        scores.append(score)

    def shares(logs: Column) -> Column:
        weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
        return let(weights, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda n, y: n + y)))

    types = F.array(*[F.lit(t) for t in TYPES])
    best = let(F.col("__p"), lambda p: F.get(types, (F.array_position(p, F.array_max(p)) - 1).cast("int")))
    scored = votes.withColumn("__p", let(F.array(*scores), shares))
    return scored.select(
        *votes.columns,
        *[F.get("__p", F.lit(i)).alias(f"p_{t}") for i, t in enumerate(TYPES)],
        F.when(F.col("n_chars") > 0, best).alias("text_type"),
    )
