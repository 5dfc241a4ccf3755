"""Splitting of oversized texts at natural boundaries.

A sparse table over the boundary strengths of a text answers range-maximum queries:
the strongest boundary in the window of permissible piece lengths is the cut, ties go
to the right; then the next piece begins an overlap before the cut.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1_200
OVERLAP = 120

#: Boundary strengths: blank line, line end, sentence end, clause end, word end.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 5, 4, 3, 2, 1
_SENTENCE_ENDS = ".!?…。！？"
_CLAUSE_ENDS = ",;:—–、，；："
_CLOSERS = "\"'”’»)]}」』"
_JOINERS = "‍️︎"
_SPACES = [c for c in range(0x3001) if chr(c).isspace()]
_INDEX_BITS = 40


def _codes(letters: str) -> np.ndarray:
    return np.array([ord(c) for c in letters], dtype=np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end naturally (after a run of white space, or after a
    full-width mark) and their strengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = np.isin(points, _SPACES)
    edge = np.diff(blank.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lines = np.r_[0, np.cumsum(points == ord("\n"))]
    breaks = lines[ends] - lines[begins]

    before = points[np.maximum(begins - 1, 0)]
    closed = np.isin(before, _codes(_CLOSERS))
    before = np.where(closed, points[np.maximum(begins - 2, 0)], before)
    strength = np.full(begins.size, WORD, dtype=np.int64)
    strength[np.isin(before, _codes(_CLAUSE_ENDS))] = CLAUSE
    strength[np.isin(before, _codes(_SENTENCE_ENDS))] = SENTENCE
    strength[breaks == 1] = LINE
    strength[breaks > 1] = PARAGRAPH

    wide = np.flatnonzero(np.isin(points, _codes("。！？、，；：")))
    wide = wide[wide + 1 < points.size]
    wide = wide[~blank[wide + 1]] + 1
    wide_strength = np.where(np.isin(points[wide - 1], _codes(_SENTENCE_ENDS)), SENTENCE, CLAUSE)
    places = np.r_[ends, wide]
    order = np.argsort(places, kind="stable")
    return places[order], np.r_[strength, wide_strength][order]


class RangeMaximum:
    """Sparse table; ``best(i, j)`` is the last place of the maximum of ``values[i:j]``."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        coded = (values.astype(np.int64) << _INDEX_BITS) | np.arange(values.size)
        self._levels = [coded]
        width = 1
        while 2 * width <= min(longest, values.size):
            last = self._levels[-1]
            self._levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, i: int, j: int) -> int:
        level = (j - i).bit_length() - 1
        row = self._levels[level]
        return int(max(row[i], row[j - (1 << level)])) & ((1 << _INDEX_BITS) - 1)


def _belongs_before(text: str, place: int) -> bool:
    """Whether the character at ``place`` is part of the letter or symbol before it."""
    code = text[place]
    return (
        unicodedata.combining(code) > 0
        or code in _JOINERS
        or "\U0001f3fb" <= code <= "\U0001f3ff"
        or text[place - 1] == "‍"
    )


def _hard_cut(text: str, least: int, cut: int) -> int:
    """A cut without a boundary, moved left off marks that belong to the letter before.

    Only marks that fill the whole window from ``least`` on are cut apart.
    """
    place = cut
    while place >= least and _belongs_before(text, place):
        place -= 1
    return place if place >= least else cut


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of the pieces of ``text``, in code points.

    A text within the limit is one piece.  A piece ends at the strongest boundary in the
    upper half of the permissible lengths; if there is none, at the strongest in the lower
    half (of pieces longer than the overlap, so that the next one gets on), and only in a
    text without any boundary there at the limit.  The next begins at the first word in the
    last ``overlap`` characters before the cut, else exactly ``overlap`` before it.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be below half the limit")
    size = len(text)
    if size <= limit:
        return [(0, size)]
    places, strengths = boundaries(text)
    table = RangeMaximum(strengths, limit + 1)
    pieces, start = [], 0
    while size - start > limit:
        least = start + overlap + 1
        short, low, high = (int(i) for i in np.searchsorted(places, [least, start + limit // 2, start + limit + 1]))
        if high > low:
            cut = int(places[table.best(low, high)])
        elif low > short:
            cut = int(places[table.best(short, low)])
        else:
            cut = _hard_cut(text, least, start + limit)
        pieces.append((start, cut))
        again = int(np.searchsorted(places, cut - overlap))
        start = int(places[again]) if again < places.size and places[again] < cut else cut - overlap
    pieces.append((start, size))
    return pieces


def split_pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """``array<struct<start, piece>>`` of a text; Arrow batches, only for oversized texts."""

    @F.pandas_udf("array<struct<start:int,piece:string>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else [(a, t[a:b]) for a, b in split_points(t, limit, overlap)]
        )

    return pieces(text)


def split_items(
    rows: DataFrame,
    *,
    keep: list[str],
    items: str,
    metadata: str,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Pieces of every item of the array column ``items``.

    Result: ``keep``, ``ord`` (the item's place from 0), ``oversized``, ``piece_no``,
    ``n_pieces``, ``start`` (of the piece in the item), ``text`` and ``metadata`` (the
    element of the metadata array at the item's place, null if that array is null or
    shorter).  Null and empty items give no piece but keep their place; only oversized
    items cross to Python, and whole.
    """
    exploded = rows.select(
        *keep, F.posexplode(items).alias("ord", "__item"), F.col(metadata).alias("__all")
    ).select(*keep, "ord", "__item", F.get("__all", F.col("ord")).alias("metadata"))
    present = exploded.where(F.col("__item").isNotNull() & (F.col("__item") != ""))
    oversized = F.char_length("__item") > limit
    cut = split_pieces(F.when(oversized, F.col("__item")), limit, overlap)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("__item").alias("piece")))
    pieces = present.select(*keep, "ord", oversized.alias("oversized"), F.coalesce(cut, whole).alias("__pieces"), "metadata")
    return pieces.select(
        *keep, "ord", "oversized", F.size("__pieces").alias("n_pieces"), F.posexplode("__pieces").alias("piece_no", "__p"), "metadata"
    ).select(
        *keep,
        "ord",
        "oversized",
        "piece_no",
        "n_pieces",
        F.col("__p.start").alias("start"),
        F.col("__p.piece").alias("text"),
        "metadata",
    )
