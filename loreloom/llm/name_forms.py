"""Forms of a typed name and the likeness of two names.

A spelling has several forms: itself, its aliases and the names written in its
descriptions, each as normal tokens.  Two forms are compared by soft weighted token
similarity: tokens are paired one to one, a pair counts by how alike the tokens are
(typing error, initial, abbreviation, nickname) and by how rare they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import regex

#: Words that carry no identity in a name.
FILLERS = frozenset({"the", "of", "and", "de", "von", "van", "del", "la"})
#: Marks of generation; two names that differ in them are two people.
GENERATIONS = frozenset({"ii", "iii", "iv", "jr", "sr", "junior", "senior", "elder", "younger"})
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_QUOTED = re.compile(r"['\"‘’“”«»]\s*([^'\"‘’“”«»]+?)\s*['\"‘’“”«»]")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ACRONYM = re.compile(r"^(?:[A-Za-z]\.\s?){2,}$|^[A-Z]{2,}$")
#: A written name: capitalised words, with commas, quotation marks and small joining words between them.
_RUN = regex.compile(
    r"""(?<![\w'’])\p{Lu}[\w.'’-]*(?:[,'"’”»]*[ ]+(?:(?:of|and|the|&)[ ]+){0,2}['"‘“«]*\p{Lu}[\w.'’-]*)*"""
)
_FIRST = regex.compile(r"\W*(\p{Lu}[\w'’-]*)\W+(?:(?:of|and|the|&) )*")
#: A statement that begins with two words in capitals.
STARTS_WITH_NAME = r"^[^\p{L}]*\p{Lu}[^\s,]*,?\s+(?:(?:of|and|the|&)\s+){0,2}[^\p{L}\s]?\p{Lu}"
_START = regex.compile(STARTS_WITH_NAME)
#: Names of plain words, which need no further reading.
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]+,? )*[A-Z]?[a-z]+")
_SWAPS = str.maketrans({"0": "o", "1": "l", "3": "e", "5": "s"})


def plain(text: str) -> str:
    """Lower case without accents, single spaces."""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).lower().split())


@dataclass(frozen=True)
class Lexicon:
    """Known short forms: nicknames, titles and abbreviations (lower case, without dots)."""

    full: dict[str, frozenset[str]] = field(default_factory=dict)
    titles: frozenset[str] = frozenset()
    #: Frequent words: a capital that begins a statement is none of its name if it is one of these.
    usual: frozenset[str] = frozenset()

    @staticmethod
    def of(rows: Iterable[tuple[str, str, str]], usual: Iterable[str] = ()) -> Lexicon:
        full: dict[str, set[str]] = {}
        titles: set[str] = set()
        for form, full_form, kind in rows:
            short, long = plain(form).rstrip("."), plain(full_form).rstrip(".")
            if kind == "title":
                titles |= {short, long}
            else:
                full.setdefault(short, set()).add(long)
        return Lexicon({k: frozenset(v) for k, v in full.items()}, frozenset(titles), frozenset(plain(w) for w in usual))


def tokens_of(name: str, lexicon: Lexicon) -> tuple[str, ...]:
    """Normal tokens of a name, sorted; a quoted nickname, titles and fillers are left out."""
    if _PLAIN.fullmatch(name):
        found = [t for t in _CAMEL.sub(" ", name).lower().replace(",", " ").split() if t not in FILLERS and t not in lexicon.titles]
        long = [t for t in found if len(t) > 1]
        if found:
            return tuple(sorted(long if len(long) >= 2 else found))
    if _ACRONYM.match(name.strip()):
        return ("@" + re.sub(r"[^a-z]", "", name.lower()),)
    rest = _QUOTED.sub(" ", name)
    rest = _CAMEL.sub(" ", rest if rest.strip() else name)
    found = []
    for token in _TOKEN.findall(plain(rest)):
        token = re.sub(r"['’]s$", "", token).replace("'", "").replace("’", "")
        if any(c.isalpha() for c in token):
            token = token.translate(_SWAPS)
        if token not in FILLERS and token not in lexicon.titles:
            found.append(token)
    if not found:
        found = [t for t in _TOKEN.findall(plain(name)) if t not in FILLERS] or [plain(name)]
    long = [t for t in found if len(t) > 1]
    if len(long) >= 2:
        found = long
    return tuple(sorted(found))


def mentions(statement: str, usual: frozenset[str] = frozenset()) -> list[str]:
    """Written names in a statement: longest runs of capitalised words.

    A comma, a quotation mark, "of", "and" or "the" stays in a run if a capitalised word follows.
    A first word that is a ``usual`` one has its capital from its place and is left out.
    """
    found = _RUN.findall(statement)
    first = _FIRST.match(statement)
    if found and first is not None and plain(first[1]) in usual and statement.startswith(found[0], first.start(1)):
        rest = statement[first.end() : first.start(1) + len(found[0])]
        found[:1] = [rest] if rest[:1].isupper() else []
    return found


class Own:
    """The words of one name, to find them in statements."""

    def __init__(self, tokens: tuple[str, ...]) -> None:
        self.letters = tokens[0][1:] if tokens and tokens[0].startswith("@") else None
        self.words = frozenset(t for t in tokens if len(t) > 2)
        self.near: dict[str, list[str]] = {}
        for t in self.words:
            if len(t) > 4:
                self.near.setdefault(t[0], []).append(t)
        stems = {part for t in self.words for part in ((t,) if len(t) < 6 else (t[:4], t[-4:]))}
        self._stems = [*stems, *([self.letters] if self.letters else [])]
        self._spelled = self.letters is not None

    def may_be_in(self, text: str) -> bool:
        """Whether ``text`` (lower case) holds a piece of the name: a plain search before words are parted."""
        return any(stem in text for stem in self._stems) or (self._spelled and "." in text[:-1])

    def has(self, word: str) -> bool:
        """Whether ``word`` is one of the name's, a typing error aside."""
        if word in self.words or word == self.letters:
            return True
        near = self.near.get(word[0])
        return near is not None and any(abs(len(word) - len(o)) < 2 and _edits(word, o, 1) < 2 for o in near)


@dataclass(frozen=True)
class Reading:
    """What one statement says of the name it stands under."""

    #: Names it writes, as tokens joined by blanks.
    names: list[str]
    #: Whether it names its subject.
    own: bool
    #: If so, its words in order: plain, a capital's as "^word", the subject's own as "|".
    words: list[str]


class Reader:
    """Reads statements under one lexicon; remembers written names, which recur."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.tokens = lru_cache(maxsize=200_000)(lambda name: tokens_of(name, lexicon))
        self.own = lru_cache(maxsize=20_000)(lambda name: Own(self.tokens(name)))

    def read(self, statement: str, name: str) -> Reading:
        text = " ".join(statement.split())
        own = self.own(name)
        if not own.may_be_in(text.lower() if text.isascii() else plain(text)):
            # Of a statement on something else only a name that it begins with may be its subject's.
            if _START.match(text) is None:
                return Reading([], False, [])
            first = mentions(text, self.lexicon.usual)[:1]
            return Reading([f for f in (" ".join(self.tokens(m)) for m in first) if f.strip()], False, [])
        names = sorted({" ".join(t) for t in map(self.tokens, mentions(text, self.lexicon.usual)) if any(t)})
        said = _TOKEN.findall(text)
        folded = [_folded(word) for word in said]
        mine = [word in own.words or (word[0] in own.near and own.has(word)) or word == own.letters for word in folded]
        if not any(mine) and (own.letters is None or "@" + own.letters not in names):
            return Reading(names, False, [])
        # Initials, and capitals beside the subject's own words, are parts of its name too.
        last = len(said) - 1
        for i in [i for i, own_word in enumerate(mine) if own_word]:
            j = i + 1
            while j <= last and said[j][0].isupper():
                mine[j] = True
                j += 1
            j = i - 1
            while j >= 0 and (j == 0 or said[j][0].isupper()):
                mine[j] = True
                j -= 1
        words = [
            "|" if own_word or len(word) == 1 else f"^{word}" if i and raw[0].isupper() else word
            for i, (word, raw, own_word) in enumerate(zip(folded, said, mine, strict=True))
        ]
        return Reading(names, True, words)


@lru_cache(maxsize=100_000)
def _folded(word: str) -> str:
    return plain(word).translate(_SWAPS) if any(c.isalpha() for c in word) else word


def frame(words: Iterable[str], common: frozenset[str]) -> tuple[str, list[str]]:
    """A statement's frame, its runs of uncommon words replaced by their sort (* or ^), and these runs.

    A run changes where capitals begin or end, so it is proper or plain as a whole.
    """
    parts: list[str] = []
    runs: list[str] = []
    going = ""
    for word in words:
        sort = "" if word == "|" or word.lstrip("^") in common else "^" if word.startswith("^") else "*"
        if not sort:
            parts.append(word)
        elif sort == going:
            runs[-1] += " " + word
        else:
            parts.append(sort)
            runs.append(word)
        going = sort
    return " ".join(parts), runs


def _edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbouring letters may swap), or ``most + 1``."""
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1  # an edit changes at most two letters of the sets
    begin, end = 0, 0
    shorter = min(len(a), len(b))
    while begin < shorter and a[begin] == b[begin]:
        begin += 1
    while end < shorter - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _is_abbreviation(short: str, long: str) -> bool:
    if len(short) < 2 or len(long) < len(short) + 2 or short[0] != long[0]:
        return False
    letters = iter(long)
    return all(c in letters for c in short)


#: Of two known tokens, the share that the rarer has of the other's worlds for these to be two names.
ESTABLISHED_SHARE = 0.25


def token_weight(share: float) -> float:
    """What a token counts: 1 if few worlds know it, less the more do."""
    return 1 / (1 + math.log(1 + 200 * share))


class Comparer:
    """Compares forms under one lexicon; remembers the likeness of token pairs."""

    def __init__(self, lexicon: Lexicon, known: dict[str, dict[str, float]]) -> None:
        """``known``: by kind the tokens that many worlds know and their share of the worlds."""
        self.lexicon = lexicon
        self.known = known
        self._weights = {kind: {t: token_weight(s) for t, s in tokens.items()} for kind, tokens in known.items()}
        self._short = lru_cache(maxsize=200_000)(self._short_likeness)
        self._typo = lru_cache(maxsize=200_000)(self._typo_likeness)
        self._token = lru_cache(maxsize=500_000)(self.token)

    def _short_likeness(self, short: str, long: str) -> float:
        """Likeness of a nickname, initial or abbreviation to the whole."""
        full = self.lexicon.full
        if short in full.get(long, ()) or long in full.get(short, ()):
            return 0.95
        if len(short) == 1:
            return 0.8 if long[:1] == short else 0.0
        likeness = 0.0
        if any(_edits(name, long, 2) <= 2 for name in full.get(short, ())):
            likeness = 0.85
        if len(short) >= 3 and long.startswith(short) and len(long) >= len(short) + 2:
            likeness = max(likeness, 0.88)
        elif _is_abbreviation(short, long):
            likeness = max(likeness, 0.75)
        return likeness

    @staticmethod
    def _typo_likeness(short: str, long: str) -> float:
        most = 1 if len(long) <= 4 else 2 if len(long) <= 7 else 3
        edits = _edits(short, long, most)
        return 1 - edits / len(long) * (0.8 if edits == 1 else 1.0) if edits <= most else 0.0

    def token(self, a: str, b: str, kind: str) -> float:
        """0 to 1: how likely the two tokens were meant as the same."""
        if a == b:
            return 1.0
        short, long = (a, b) if (len(a), a) <= (len(b), b) else (b, a)
        likeness = self._short(short, long)
        if likeness >= 0.95 or len(short) == 1:
            return likeness
        known = self.known.get(kind, {})
        few, many = sorted((known.get(a, 0.0), known.get(b, 0.0)))
        if few > 0 and few >= ESTABLISHED_SHARE * many:
            return likeness
        return max(likeness, self._typo(short, long))

    def forms(self, a: tuple[str, ...], b: tuple[str, ...], kind: str) -> float:
        """Soft weighted token similarity of two forms."""
        if a == b:
            return 1.0
        if not (GENERATIONS.isdisjoint(a) and GENERATIONS.isdisjoint(b)) and GENERATIONS.intersection(a) != GENERATIONS.intersection(b):
            return 0.0
        for one, other in ((a, b), (b, a)):
            if len(one) == 1 and one[0].startswith("@"):
                letters = sorted(one[0][1:])
                return 0.93 if len(other) > 1 and sorted(t[0] for t in other) == letters else 0.0
        weights = self._weights.get(kind, {})
        left, right = list(a), list(b)
        met = total = 0.0
        for token in a:
            if token in right:  # equal tokens pair first
                left.remove(token)
                right.remove(token)
                weight = weights.get(token, 1.0)
                met += weight
                total += weight
        if left and right:
            scored = [(self._token(x, y, kind), i, j) for i, x in enumerate(left) for j, y in enumerate(right)]
            gone_left, gone_right = set(), set()
            for likeness, i, j in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
                if likeness < 0.5:
                    break
                if i not in gone_left and j not in gone_right:
                    gone_left.add(i)
                    gone_right.add(j)
                    weight = max(weights.get(left[i], 1.0), weights.get(right[j], 1.0))
                    met += likeness * weight
                    total += weight
            left = [t for i, t in enumerate(left) if i not in gone_left]
            right = [t for j, t in enumerate(right) if j not in gone_right]
        if not total:
            return 0.0
        missing = sum(weights.get(t, 1.0) * (1.0 if len(t) > 1 else 0.3) for t in (*left, *right))
        likeness = met / (total + 0.5 * missing)
        return likeness * (0.7 if left and right else 1.0)


#: Greatest likeness through a form of initials or an acronym, and of a single token.
SHORT_LIKENESS, SINGLE_LIKENESS = 0.82, 0.72
