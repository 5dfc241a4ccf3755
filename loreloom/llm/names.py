"""Linking the spellings under which people typed one person or organisation.

Spellings of a block (here: a world) that share a rare token q-gram are candidates
(a prefix-filtered set-similarity join on the q-grams of their forms); candidates are
verified by soft weighted token similarity and by what their descriptions say.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.name_forms import (
    SHORT_LIKENESS,
    SINGLE_LIKENESS,
    STARTS_WITH_NAME,
    Comparer,
    Lexicon,
    Reader,
    frame,
)
from loreloom.session import cut_lineage

#: Letters of a q-gram, and the Jaccard similarity of q-grams below which forms are not compared.
Q = 3
LEAST_SHARED = 0.33
#: The most frequent q-grams, which come last in the order of the prefix filter.
COMMON_GRAMS = 2_000
#: A likeness that links full names by itself; one that links with an agreeing profile.
STRONG, SUPPORTED = 0.83, 0.66
#: Most sessions whose worlds are broadcast (about 100 bytes each).
BROADCAST_SESSIONS = 200_000
#: Share of worlds up to which a name in a statement is rare, and from which on a word is common.
RARE_NAME, COMMON_WORD = 1 / 32, 0.4
#: Share of all statements that makes their frame usual, and of a frame's statements beyond which
#: what fills a place of it belongs to the frame.
USUAL_FRAME, FRAME_SHARE = 1 / 300, 0.25
#: Share of worlds (and number) from which on a token is known: a name of its own, no typing error.
KNOWN_SHARE, LEAST_WORLDS = 1 / 200, 4
#: Lead in score that an ambiguous short form needs over its second-best entity.
LEAD = 0.1


#: Stems that are looked for one by one in generated code; names of more words have the rest looked for too.
_FIRST_STEMS = 6


def _stems(name: Column) -> Column:
    """Beginnings and ends of the words of a name, in lower case."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(F.left(w, F.lit(4)), F.right(w, F.lit(4))))))


def _may_tell(name: Column, stems: Column, text: Column) -> Column:
    """Whether a statement may be read for a name: it holds the name or a stem of it, or begins with a name."""
    low = F.lower(text)
    held = F.contains(text, name)
    for i in range(_FIRST_STEMS):
        held = held | F.coalesce(F.contains(low, F.get(stems, F.lit(i))), F.lit(False))
    more = F.when(F.size(stems) > _FIRST_STEMS, F.exists(stems, lambda w: F.contains(low, w))).otherwise(F.lit(False))
    return held | more | F.rlike(text, F.lit(STARTS_WITH_NAME))


def typed_names(states: DataFrame, sessions: DataFrame, kind: str, *, aliases: str | None) -> DataFrame:
    """Distinct texts of the spellings of a kind: ``kind``, ``world``, ``name``, ``role``, ``text``.

    A spelling has itself (role ``name``), its aliases (``alias``) and the statements of its
    descriptions (``said``), each as a row of its own, so that a spelling of which much is said
    is no large row.  Copies are combined before anything is shuffled.
    """

    def texts(column: Column, role: str) -> Column:
        listed = F.transform(column, lambda t: F.struct(F.lit(role).alias("role"), t.alias("text")))
        return F.coalesce(listed, F.array().cast("array<struct<role:string,text:string>>"))

    lists = [texts(F.array("entry_key"), "name"), texts(F.col("description"), "said")]
    if aliases:
        lists.append(texts(F.col(aliases), "alias"))
    known = F.col("session_id").isNotNull() & F.col("entry_key").isNotNull()
    entries = states.where(known)
    worlds = sessions.select("session_id", F.col("world_hash").alias("world")).where(F.col("world").isNotNull()).distinct()
    if sessions.count() <= BROADCAST_SESSIONS:
        worlds = F.broadcast(worlds)
    return (
        entries.select("session_id", F.col("entry_key").alias("name"), _stems(F.col("entry_key")).alias("stems"), F.concat(*lists).alias("texts"))
        .join(worlds, "session_id")
        .select("world", "name", "stems", F.inline("texts"))
        .where(F.col("text").isNotNull() & (F.col("text") != ""))
        .where((F.col("role") != "said") | _may_tell(F.col("name"), F.col("stems"), F.col("text")))
        .select(F.lit(kind).alias("kind"), "world", "name", "role", "text")
        .distinct()
    )


def _lists(batch: pa.RecordBatch) -> list[list]:
    """Columns as lists; by way of pandas, which makes Python values of text several times faster."""
    frame = batch.to_pandas()
    return [frame[c].tolist() for c in frame.columns]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _read(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``kind``, ``block``, ``node``, ``what``, ``value`` of all texts, by the 64-bit hashes of worlds and spellings;
    ``world`` and ``name`` stand in the rows of a spelling itself.

    ``what``: ``key`` and ``alias`` (a typed form), ``own`` (a name of several words in a statement that
    names its subject), ``other`` (any further name) and ``words`` (of a statement that names its subject).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)

        for batch in batches:
            rows: dict[tuple[str, int, int, str, str, str | None, str | None], None] = {}
            for kind, block, node, world, name, role, text in zip(*_lists(batch), strict=True):
                if role != "said":
                    form = " ".join(reader.tokens(text))
                    if form.strip() and role == "name":
                        rows[kind, block, node, "key", form, world, name] = None
                    elif form.strip():
                        rows[kind, block, node, "alias", form, None, None] = None
                    continue
                reading = reader.read(text, name)
                for form in reading.names:
                    several = " " in form or form.startswith("@")
                    if several or reading.own:
                        rows[kind, block, node, "own" if several and reading.own else "other", form, None, None] = None
                if reading.own:
                    rows[kind, block, node, "words", " ".join(reading.words), None, None] = None
            yield _batch(list(rows), facts)

    node = F.xxhash64("kind", "world", "name")
    keyed = texts.select("kind", F.xxhash64("kind", "world").alias("block"), node.alias("node"), "world", "name", "role", "text")
    facts = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("node", pa.int64()), *[(c, pa.string()) for c in ("what", "value", "world", "name")]])
    return keyed.mapInArrow(read, "kind string, block bigint, node bigint, what string, value string, world string, name string")


def _few_worlds(facts: DataFrame, share: float) -> Column:
    """Whether ``worlds`` is few: at most ``share`` of the worlds of the kind, or two."""
    by_kind = {r["kind"]: r["n"] for r in facts.groupBy("kind").agg(F.count_distinct("block").alias("n")).collect()}
    most = F.lit(2)
    for kind, n in by_kind.items():
        most = F.when(F.col("kind") == kind, F.lit(max(2, int(share * n)))).otherwise(most)
    return F.col("worlds") <= most


def _node_forms(facts: DataFrame) -> DataFrame:
    """``kind``, ``block``, ``node``, ``form``: typed forms, and the names in statements that are evidence.

    A name of several words in a statement on its subject is evidence, and so is any other name there, or
    at the beginning of a statement, that is also typed in this world; but not one of several words that statements of many worlds write, as they
    do places.
    """
    typed = facts.where(F.col("what").isin("key", "alias")).withColumnRenamed("value", "form")
    own = facts.where("what = 'own'").select("kind", "block", "node", F.col("value").alias("form")).distinct()
    spelled = typed.groupBy("block", "form").agg(F.max(F.col("what") == "key").alias("keyed"))
    other = facts.where("what = 'other'").select("kind", "block", "node", F.col("value").alias("form")).distinct()
    several = F.contains("form", F.lit(" ")) | F.startswith("form", F.lit("@"))
    other = other.join(spelled, ["block", "form"]).where(several | F.col("keyed"))
    columns = ["kind", "block", "node", "form"]
    named = own.select(columns).unionByName(other.where(several).select(columns))
    worlds = own.groupBy("kind", "form").agg(F.count_distinct("block").alias("worlds")).where(~_few_worlds(facts, RARE_NAME))
    parts = [
        typed.select(columns),
        named.join(worlds.select("kind", "form"), ["kind", "form"], "left_anti").select(columns),
        other.where(~several).select(columns),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def _profiles(facts: DataFrame) -> DataFrame:
    """``node`` and ``profile``: the distinct words that statements on it fill their frames with.

    A frame is what a statement shares with others: its common words (of many worlds) in order.  What
    fills a place of a usual frame describes the subject, unless one filling has so large a share of
    the place that it belongs to the frame.
    """
    said = facts.where("what = 'words'").select("kind", "block", "node", F.col("value").alias("words"))
    plain_words = F.filter(F.array_distinct(F.split(F.translate("words", "^", ""), " ")), lambda w: w != "|")
    # Near the threshold a few per cent of the count decide nothing, hence sketches in place of a shuffle of all words.
    found = said.select("kind", "block", F.explode(plain_words).alias("word"))
    usual = found.groupBy("kind", "word").agg(F.approx_count_distinct("block", 0.03).alias("worlds")).where(~_few_worlds(facts, COMMON_WORD))
    common: dict[str, set[str]] = {}
    for row in usual.select("kind", "word").collect():
        common.setdefault(row["kind"], set()).add(row["word"])

    shapes = pa.schema([("kind", pa.string()), ("node", pa.int64()), ("frame", pa.string()), ("runs", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {kind: frozenset(words) for kind, words in common.items()}
        for batch in batches:
            rows = []
            for kind, node, words in zip(*_lists(batch), strict=True):
                shape, runs = frame(words.split(" "), known.get(kind, frozenset()))
                rows.append((kind, node, shape, runs))
            yield _batch(rows, shapes)

    framed = said.select("kind", "node", "words").mapInArrow(cut, "kind string, node bigint, frame string, runs array<string>")
    framed = cut_lineage(framed.select("kind", "node", F.xxhash64("frame").alias("frame"), "runs"))
    places = framed.select("kind", "node", "frame", F.posexplode("runs").alias("place", "run"))
    frames = framed.groupBy("kind", "frame").agg(F.count(F.lit(1)).alias("n"))
    every = frames.groupBy("kind").agg(F.sum("n").alias("all"))
    frames = frames.join(F.broadcast(every), "kind").where(F.col("n") >= F.col("all") * USUAL_FRAME).select("kind", "frame", "n")
    fillings = places.groupBy("kind", "frame", "place", "run").agg(F.count(F.lit(1)).alias("k"))
    telling = fillings.join(frames, ["kind", "frame"]).where(F.col("k") <= F.col("n") * FRAME_SHARE).drop("k", "n")
    described = places.join(telling, ["kind", "frame", "place", "run"]).select("node", F.explode(F.split("run", " ")).alias("word"))
    word = F.struct(F.startswith("word", F.lit("^")).alias("proper"), F.xxhash64("word").alias("h"))
    return described.groupBy("node").agg(F.collect_set(word).alias("profile"))


def _distinct_forms(nodes: DataFrame) -> DataFrame:
    """Each form of a block once: ``f`` (its hash), ``block``, ``kind``, ``form``."""
    return nodes.select("block", "kind", "form").distinct().select(F.xxhash64("block", "form").alias("f"), "block", "kind", "form")


def held_tokens(forms: DataFrame) -> DataFrame:
    """``kind``, ``token``, in how many worlds (``n``) and forms (``c``) it is."""
    tokens = forms.select("kind", "block", F.explode(F.split("form", " ")).alias("token"))
    return tokens.groupBy("kind", "token", "block").agg(F.count(F.lit(1)).alias("c")).groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))


def known_tokens(forms: DataFrame, held: DataFrame) -> dict[str, dict[str, float]]:
    """By kind the tokens that at least ``KNOWN_SHARE`` of the worlds know, with their share of the worlds.

    If worlds know v tokens on average there are at most v / ``KNOWN_SHARE`` such tokens, whatever the
    number of worlds; all others are rare and need no entry.
    """
    worlds = {r["kind"]: r["w"] for r in forms.groupBy("kind").agg(F.count_distinct("block").alias("w")).collect()}
    known: dict[str, dict[str, float]] = {}
    for kind, w in worlds.items():
        rows = held.where((F.col("kind") == kind) & (F.col("n") >= max(LEAST_WORLDS, w * KNOWN_SHARE))).collect()
        known[kind] = {r["token"]: r["n"] / w for r in rows}
    return known


def q_grams(form: str) -> list[str]:
    """Distinct q-grams of a form's tokens, each token with marks at both ends."""
    grams: dict[str, None] = {}
    for token in form.split(" "):
        padded = f"^{token}$"
        for i in range(max(1, len(padded) - Q + 1)):
            grams[padded[i : i + Q]] = None
    return list(grams)


def initials_key(form: str) -> str | None:
    """Sorted initials of a name of several tokens, sorted letters of an acronym."""
    tokens = form.split(" ")
    if form.startswith("@"):
        return "@" + "".join(sorted(form[1:]))
    return "@" + "".join(sorted(t[0] for t in tokens)) if len(tokens) > 1 else None


def candidate_forms(forms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Pairs ``f`` < ``g`` of a block's forms with like q-gram sets.

    Prefix filter: a form keeps its ``n - ceil(t n) + 1`` first q-grams in one order of
    all q-grams; two forms with a Jaccard similarity of ``t`` or more share one of these.
    The order puts the ``COMMON_GRAMS`` most frequent last, so that few forms meet by
    chance; any order is exact, hence this bound on what the driver learns drops nothing.
    Every form also keeps its initials as one key, so that acronyms meet.
    """

    @F.pandas_udf("array<string>")
    def all_grams(texts: pd.Series) -> pd.Series:
        return texts.map(q_grams)

    tokens = held_tokens(forms) if held is None else held
    counted = tokens.select(F.explode(all_grams("token")).alias("gram"), "c").groupBy("gram").agg(F.sum("c").alias("count"))
    common = [r["gram"] for r in counted.orderBy(F.desc("count"), "gram").limit(COMMON_GRAMS).collect()]
    late = {gram: COMMON_GRAMS - i for i, gram in enumerate(common)}

    @F.pandas_udf("array<string>")
    def kept(texts: pd.Series) -> pd.Series:
        def of(form: str) -> list[str]:
            key = initials_key(form)
            if form.startswith("@"):
                return ["0", key]
            ordered = sorted(q_grams(form), key=lambda g: (late.get(g, 0), g))
            n = len(ordered)
            first = ordered[: n - math.ceil(n * LEAST_SHARED) + 1]
            return [str(n), *first] if key is None else [str(n), *first, key]

        return texts.map(of)

    listed = forms.select("block", "f", kept("form").alias("kept"))
    index = cut_lineage(
        listed.select(
            "block",
            "f",
            F.get("kept", F.lit(0)).cast("short").alias("n"),
            F.posexplode(F.slice("kept", F.lit(2), F.size("kept"))).alias("place", "gram"),
        ).select(
            F.xxhash64("block", "gram").alias("key"),
            "f",
            F.col("place").cast("short").alias("place"),
            # Names meet by their initials only with an acronym (0), not with each other (-1).
            F.when(~F.startswith("gram", F.lit("@")), F.col("n")).otherwise(F.when(F.col("n") == 0, 0).otherwise(-1)).cast("short").alias("n"),
        )
    )
    # Both sides are the same exchange: columns are told apart by alias, not renamed.
    one, other = index.alias("one"), index.alias("other")
    n, m = F.col("one.n"), F.col("other.n")
    least, most = F.least(n, m), F.greatest(n, m)
    # What two forms can share at most if this is the first q-gram they share, and what they must.
    shared = F.least(n - F.col("one.place"), m - F.col("other.place"))
    needed = F.lit(LEAST_SHARED / (1 + LEAST_SHARED)) * (n + m) - 1e-6
    alike = ((least > 0) & (least >= most * LEAST_SHARED) & (shared >= needed)) | (most == 0)
    met = one.join(other, F.col("one.key") == F.col("other.key")).where((F.col("one.f") < F.col("other.f")) & alike)
    met = met.select(F.col("one.f").alias("f"), F.col("other.f").alias("g"))
    return met.select("f", "g").distinct()


def _alike_forms(pairs: DataFrame, forms: DataFrame, held: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``f``, ``g``, ``likeness`` of the candidates that are at least ``SUPPORTED``."""
    # Keys are hashes of world and q-gram: two worlds whose keys happen to be equal are told apart here.
    joined = pairs.join(forms, "f").join(forms.select(F.col("f").alias("g"), "block", F.col("form").alias("form_g")), ["g", "block"])
    known = known_tokens(forms, held)

    likely = pa.schema([("f", pa.int64()), ("g", pa.int64()), ("likeness", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comparer = Comparer(lexicon, known)

        @lru_cache(maxsize=200_000)
        def read(form: str) -> tuple[tuple[str, ...], frozenset[str]]:
            return tuple(form.split(" ")), frozenset(q_grams(form))

        def similar(form: str, x: frozenset[str], other: str, y: frozenset[str]) -> bool:
            """Whether the pair belongs to the similarity join; acronyms meet by their letters."""
            shared = len(x & y)
            return shared >= LEAST_SHARED * (len(x) + len(y) - shared) or "@" in (form[0], other[0])

        for batch in batches:
            rows = []
            for f, g, kind, form, form_g in zip(*_lists(batch), strict=True):
                (one, x), (other, y) = read(form), read(form_g)
                if similar(form, x, form_g, y):
                    likeness = comparer.forms(one, other, kind)
                    if likeness >= SUPPORTED:
                        rows.append((f, g, likeness))
            yield _batch(rows, likely)

    columns = joined.select("f", "g", "kind", "form", "form_g")
    return columns.mapInArrow(compare, "f bigint, g bigint, likeness double")


def _form_kind(form: Column) -> Column:
    """``full`` (two whole tokens), ``short`` (initials or an acronym) or ``single``."""
    tokens = F.split(form, " ")
    whole = F.size(F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.startswith(t, F.lit("@"))))
    several = (F.size(tokens) > 1) | F.startswith(form, F.lit("@"))
    return F.when(whole >= 2, "full").when(several, "short").otherwise("single")


def _agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """Points of agreement and contradictions of two profiles; what is unknown is neither.

    Plain words (what someone is) in common count two points, proper ones (where) one; of each sort
    two profiles contradict if both have words and share none.
    """
    agree, contradict = F.lit(0), F.lit(0)
    for proper, points in ((False, 2), (True, 1)):
        sorts = [F.transform(F.filter(p, lambda x: x["proper"] == proper), lambda x: x["h"]) for p in (a, b)]  # noqa: B023
        shared = F.arrays_overlap(*sorts)
        known = (F.size(sorts[0]) > 0) & (F.size(sorts[1]) > 0)
        agree = agree + F.when(known & shared, points).otherwise(0)
        contradict = contradict + F.when(known & ~shared, 1).otherwise(0)
    return agree, contradict


def scored_pairs(nodes: DataFrame, profiles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``a`` < ``b``, ``likeness`` of their likest forms, whether each of these is a full
    name, and how far their profiles ``agree`` and ``contradict``."""
    forms = cut_lineage(_distinct_forms(nodes))
    held = cut_lineage(held_tokens(forms))
    alike = _alike_forms(candidate_forms(forms, held), forms, held, lexicon)
    holders = nodes.select(F.xxhash64("block", "form").alias("f"), "node", _form_kind(F.col("form")).alias("kind"))
    others = holders.withColumnsRenamed({"f": "g", "node": "other", "kind": "other_kind"})
    across = alike.join(holders, "f").join(others, "g")
    equal = holders.withColumn("g", F.col("f")).join(others, "g").withColumn("likeness", F.lit(1.0))
    columns = ["node", "kind", "other", "other_kind", "likeness"]
    pairs = across.select(*columns).unionByName(equal.select(*columns)).where(F.col("node") != F.col("other"))
    kinds = F.array("kind", "other_kind")
    most = (
        F.when(F.array_contains(kinds, "single") & ~F.array_contains(kinds, "short"), SINGLE_LIKENESS)
        .when(F.array_contains(kinds, "single") | F.array_contains(kinds, "short"), SHORT_LIKENESS)
        .otherwise(1.0)
    )
    ahead = F.col("node") < F.col("other")
    full, other_full = F.col("kind") == "full", F.col("other_kind") == "full"
    best = F.max(
        F.struct(
            F.least("likeness", most).alias("likeness"),
            F.when(ahead, full).otherwise(other_full).alias("full_a"),
            F.when(ahead, other_full).otherwise(full).alias("full_b"),
        )
    )
    likest = (
        pairs.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .agg(best.alias("best"))
        .select("a", "b", "best.*")
        .where(F.col("likeness") >= SUPPORTED)
    )
    joined = likest.join(profiles.withColumnsRenamed({"node": "a", "profile": "pa"}), "a", "left").join(
        profiles.withColumnsRenamed({"node": "b", "profile": "pb"}), "b", "left"
    )
    agree, contradict = _agreement(F.col("pa"), F.col("pb"))
    return joined.select("a", "b", "likeness", "full_a", "full_b", agree.alias("agree"), contradict.alias("contradict"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that has an edge.

    Alternating large-star and small-star rounds: each node hands its neighbours to the
    least of them.  The rounds are logarithmic in practice, each ends in a reliable
    checkpoint, and the driver sees two numbers of each to know when nothing changes.
    """
    current = cut_lineage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        current = cut_lineage(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        seen = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == state:
            break
        state = seen
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _consistent(links: DataFrame, against: DataFrame) -> DataFrame:
    """``links`` without those that would bridge two contradicting names.

    Where a spelling links to two names that ``against`` sets apart, only its likelier
    link stays (both do if they are equally likely).
    """
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "likeness")
    directed = both.select("e.x", "e.y", "likeness")
    apart = against.select(F.explode(F.array(F.struct(F.col("a").alias("y"), F.col("b").alias("z")), F.struct(F.col("b").alias("y"), F.col("a").alias("z")))).alias("e")).select("e.y", "e.z")
    rival = directed.withColumnsRenamed({"y": "z", "likeness": "other"})
    weaker = directed.join(apart, "y").join(rival, ["x", "z"]).where(F.col("likeness") < F.col("other"))
    dropped = weaker.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return links.select("a", "b").join(dropped, ["a", "b"], "left_anti")


def link_names(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Entities of spellings: ``kind``, ``world``, ``name``, ``entity``, linked spellings only.

    ``texts``: distinct ``kind``, ``world``, ``name``, ``role`` and ``text`` (see ``typed_names``).  Full names that are alike and not contradicted link at once;
    a short form (initials, a single token, an acronym) that fits several entities goes
    to the one it fits clearly best, or to none.  Names without letters or digits,
    and worlds with one name, link nothing; an empty table gives no rows.
    """
    facts = cut_lineage(_read(texts, lexicon))
    nodes = cut_lineage(_node_forms(facts))
    scored = cut_lineage(scored_pairs(nodes, _profiles(facts), lexicon))
    alike = (F.col("likeness") >= 0.99) & (F.col("contradict") < 2)
    fits = (F.col("contradict") == 0) | (F.col("agree") >= 2 * F.col("contradict")) | alike
    supported = (F.col("agree") >= 2) & (F.col("contradict") == 0)
    both_full = F.col("full_a") & F.col("full_b")
    sure = ((F.col("likeness") >= STRONG) & both_full & fits) | ((F.col("likeness") >= 0.7) & (F.col("agree") >= 3) & fits)
    strong = _consistent(scored.where(sure), scored.where(~fits))
    first = cut_lineage(connected_components(strong))

    weak = scored.where(~sure & fits & (((F.col("likeness") >= 0.78) & ~both_full) | supported))
    short_side = F.when(~F.col("full_a") & ~F.col("full_b"), F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o"))))
    short_side = short_side.when(~F.col("full_a"), F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")))).otherwise(
        F.array(F.struct(F.col("b").alias("s"), F.col("a").alias("o")))
    )
    score = F.col("likeness") + 0.1 * (F.col("agree") - F.col("contradict"))
    directed = weak.select(F.explode(short_side).alias("d"), score.alias("score")).select("d.s", "d.o", "score")
    component = F.coalesce("component", F.col("o"))
    toward = (
        directed.join(first.withColumnRenamed("node", "o"), "o", "left")
        .select("s", component.alias("target"), "score")
        .groupBy("s", "target")
        .agg(F.max("score").alias("score"))
    )
    own = first.withColumnsRenamed({"node": "s", "component": "own"})
    toward = toward.join(own, "s", "left").where(F.col("own").isNull() | (F.col("own") != F.col("target")))
    ranked = Window.partitionBy("s").orderBy(F.desc("score"), "target")
    chosen = (
        toward.withColumn("place", F.row_number().over(ranked))
        .withColumn("next", F.lead("score").over(ranked))
        .where((F.col("place") == 1) & (F.col("next").isNull() | (F.col("score") >= F.col("next") + LEAD)))
        .select(F.col("s").alias("a"), F.col("target").alias("b"))
    )
    stars = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    entities = connected_components(stars.unionByName(chosen))
    spelled = facts.where("what = 'key'").select("kind", "world", "name", "node")
    return spelled.join(entities, "node").select("kind", "world", "name", F.col("component").alias("entity"))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of an entity, ``name_a`` the smaller: the stated result."""
    side = linked.select("entity", "kind", "world", "name")
    return (
        side.withColumnRenamed("name", "name_a")
        .join(side.withColumnRenamed("name", "name_b"), ["entity", "kind", "world"])
        .where(F.col("name_a") < F.col("name_b"))
        .select("kind", F.col("world").alias("world_hash"), "name_a", "name_b")
    )
