"""Which entities a text mentions, speaks as, or is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import loose_words


def whole_word_mentions(texts: DataFrame, names: DataFrame, group: str) -> DataFrame:
    """``texts`` x ``names`` of one group where the name occurs as whole words.

    ``texts`` has a column ``text``, ``names`` one ``name``.  The join is on ``group`` and on that word of
    the name that fewest texts of the group hold, so a common first word brings nothing together.
    """
    words = texts.withColumn("__loose", loose_words(F.col("text")))
    tokens = words.withColumn("__word", F.explode(F.array_distinct(F.split(F.trim("__loose"), " "))))
    counts = tokens.groupBy(group, "__word").agg(F.count(F.lit(1)).alias("__n"))
    keyed = names.withColumn("__name", loose_words(F.col("name"))).where(F.trim("__name") != "")
    parts = keyed.select(group, "__name").distinct().select(group, "__name", F.explode(F.array_distinct(F.split(F.trim("__name"), " "))).alias("__word"))
    # A name of which no text has some word occurs nowhere.
    held = parts.join(counts, [group, "__word"], "left").groupBy(group, "__name").agg(
        F.min_by("__word", F.struct(F.coalesce("__n", F.lit(0)), "__word")).alias("__word"), F.min(F.coalesce("__n", F.lit(0))).alias("__least")
    )
    keyed = keyed.join(held.where(F.col("__least") > 0).drop("__least"), [group, "__name"])
    return (
        tokens.join(keyed, [group, "__word"])
        .where(F.contains("__loose", F.col("__name")))
        .drop("__loose", "__word", "__name")
    )


def _grams(word: Column, size: int) -> Column:
    """Distinct pieces of ``size`` letters of a word."""
    places = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(places, lambda i: F.substr(word, i, F.lit(size)))))


#: Words of names up to which a group's texts are compared with each of them; larger groups use an index.
FEW_WORDS = 64


def loose_mentions(texts: DataFrame, names: DataFrame, group: str, few: int = FEW_WORDS) -> DataFrame:
    """``texts`` x ``names`` of one group where full name, first or last word occur
    anywhere, whatever the case.

    A full name holds its first word, so first and last words decide, and one lies within one word of a
    text.  A group of up to ``few`` such words brings them as one row to each of its texts; those of a larger
    group go by an index (``_indexed_mentions``), so no text is compared with very many names.
    """
    words = F.split(F.regexp_replace(F.lower("name"), r"^\s+|\s+$", ""), r"\s+")
    ends = F.array_distinct(F.array(F.element_at(words, 1), F.element_at(words, -1)))
    wanted = names.select(group, "name").distinct().where(F.trim("name") != "").select(group, "name", F.explode(ends).alias("__end"))
    wanted = wanted.where(F.col("__end") != "")
    short = lambda size: F.max((F.length("__end") == size).cast("int")).alias(f"__has{size}")
    sizes = wanted.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), short(1), short(2))
    listed = wanted.join(sizes.where(F.col("__n") <= few).select(group), group, "left_semi")
    listed = listed.groupBy(group).agg(F.collect_list(F.struct("__end", "name")).alias("__listed"))
    low = F.lower("text")
    held = F.transform(F.filter("__listed", lambda w: F.contains(low, w["__end"])), lambda w: w["name"])
    hits = texts.join(listed, group).withColumn("name", F.explode(F.array_distinct(held))).drop("__listed")
    hits = hits.unionByName(_indexed_mentions(texts, wanted, sizes.where(F.col("__n") > few).drop("__n"), group))
    return hits.join(names.distinct(), [group, "name"]) if set(names.columns) - {group, "name"} else hits


def _indexed_mentions(texts: DataFrame, wanted: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """``loose_mentions`` of the groups of ``sizes``, which says whether words of one or two letters are wanted there.

    Words of names meet the distinct words of a group's texts by a piece of up to three letters (a q-gram
    index, verified).  Texts stand in it as hashes; the texts of a hash are verified once more.
    """
    texts = texts.join(sizes.select(group), group, "left_semi").withColumn("__text", F.xxhash64("text"))
    said = texts.select(group, "__text", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("__token")).where(F.col("__token") != "").distinct()
    tokens = said.select(group, "__token").distinct().join(sizes, group)
    grams = [F.when(F.col(f"__has{size}") == 1, _grams(F.col("__token"), size)) for size in (1, 2)]
    pieces = F.flatten(F.array_compact(F.array(*grams, _grams(F.col("__token"), 3))))
    index = tokens.select(group, "__token", F.explode(pieces).alias("__piece"))
    wanted = wanted.join(sizes.select(group), group, "left_semi")
    keys = wanted.select(group, "__end").distinct().withColumn("__piece", F.left("__end", F.lit(3)))
    found = index.join(keys, [group, "__piece"]).where(F.contains("__token", F.col("__end"))).select(group, "__token", "__end")
    met = said.join(found, [group, "__token"]).select(group, "__text", "__end").distinct()
    hits = texts.join(met, [group, "__text"]).where(F.contains(F.lower("text"), F.col("__end"))).drop("__text")
    return hits.join(wanted, [group, "__end"]).drop("__end").distinct()


def entity_lists(mentions: DataFrame, key: list[str], name: str) -> DataFrame:
    """Sorted distinct names of each text, joined by bars."""
    return mentions.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(name)), "|").alias("entities"))


def speaker_lines(texts: DataFrame, names: DataFrame, key: list[str], text: str, group: str) -> DataFrame:
    """Lines that open with ``Name:`` of a known name, and who speaks in them, numbered from 1.

    ``names``: ``group``, ``name`` (as written: a spelling or an alias), ``speaker`` and ``ord``.  Case and
    white space around do not count; a name that several have is the first one's.
    """
    lines = texts.select(*key, group, F.posexplode(F.split(text, "\n")).alias("__i", "line"))
    said = lines.withColumn("__name", F.lower(F.regexp_extract("line", r"^\s*([^:]*?)\s*:", 1))).where(F.col("__name") != "")
    known = names.withColumn("__name", F.lower(F.trim("name"))).where(F.col("__name") != "")
    known = known.groupBy(group, "__name").agg(F.min_by("speaker", F.struct("ord", "speaker")).alias("speaker"))
    return said.join(known, [group, "__name"]).select(*key, (F.col("__i") + 1).alias("line_no"), "speaker")


#: Pronouns by sex; any other sex has the last list.
PRONOUNS = {
    "male": ("he", "him", "his", "himself"),
    "female": ("she", "her", "hers", "herself"),
    None: ("they", "them", "their", "theirs", "themself", "themselves"),
}


def pronouns_of(sex: Column) -> Column:
    lists = {kind: F.array(*[F.lit(w) for w in words]) for kind, words in PRONOUNS.items()}
    return F.when(sex == "male", lists["male"]).when(sex == "female", lists["female"]).otherwise(lists[None])


def referred_tokens(texts: DataFrame, names: DataFrame, key: list[str], text: str, group: str) -> DataFrame:
    """Words of texts with whom they refer to: ``key``, ``pos`` (from 1), ``word``, ``named``, ``refers_to``.

    ``names``: ``group``, ``name``, ``sex``, ``ord``; a word that is one of a name's words (of three letters
    or more) names it, the first of several.  ``refers_to`` is given for pronouns: the name mentioned last
    if the pronoun fits it, else all of the group that it fits, joined by "/".  Texts are walked word by
    word, the window spans one text.
    """
    everyone = [w for words in PRONOUNS.values() for w in words]
    tokens = texts.select(*key, group, F.posexplode(F.split(text, " ")).alias("__i", "word"))
    tokens = tokens.withColumn("__bare", F.lower(F.regexp_replace("word", r"[^\p{L}]", "")))
    listed = names.withColumn("__fits", pronouns_of(F.col("sex")))
    words = listed.select(group, "name", "ord", "__fits", F.explode(F.split(F.lower("name"), r"[^\p{L}]+")).alias("__bare"))
    known = words.where(F.length("__bare") > 2).groupBy(group, "__bare").agg(
        F.min_by(F.struct("name", "__fits"), F.struct("ord", "name")).alias("__named")
    )
    marked = tokens.join(known, [group, "__bare"], "left")
    along = Window.partitionBy(*key).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__last", F.last("__named", ignorenulls=True).over(along))
    fitting = listed.select(group, "name", F.explode("__fits").alias("__bare")).distinct()
    fitting = fitting.groupBy(group, "__bare").agg(F.array_join(F.array_sort(F.collect_set("name")), "/").alias("__all"))
    is_pronoun = F.col("__bare").isin(*everyone)
    last = F.when(F.array_contains("__last.__fits", F.col("__bare")), F.col("__last.name"))
    return marked.join(fitting, [group, "__bare"], "left").select(
        *key, (F.col("__i") + 1).alias("pos"), "word", F.col("__named.name").alias("named"), F.when(is_pronoun, F.coalesce(last, "__all")).alias("refers_to")
    )


def tag_references(referred: DataFrame, key: list[str]) -> DataFrame:
    """``tagged``: the texts again, each pronoun followed by whom it refers to in brackets where it stands."""
    word = F.when(F.col("refers_to").isNull(), F.col("word")).otherwise(F.concat("word", F.lit(" ["), "refers_to", F.lit("]")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", word.alias("w"))))
    return referred.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda t: t["w"]), " ").alias("tagged"))


def speakers_among(paragraphs: DataFrame, speakers: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """Distinct speakers of each paragraph that are among the names it holds, joined by bars (a set intersection)."""
    met = speakers.join(names.withColumnRenamed("name", "speaker"), [*key, "speaker"], "left_semi")
    found = met.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("speaker")), "|").alias("speakers"))
    return paragraphs.select(*key).distinct().join(found, key, "left")


def union_in_order(parts: list[tuple[DataFrame, int]], key: list[str], name: str, order: str) -> DataFrame:
    """Union of name lists without repeats, in the order first seen; earlier lists first."""
    rows = None
    for part, rank in parts:
        ranked = part.select(*key, F.col(name), F.struct(F.lit(rank).alias("list"), F.col(order).alias("at")).alias("__seen"))
        rows = ranked if rows is None else rows.unionByName(ranked)
    first = rows.groupBy(*key, name).agg(F.min("__seen").alias("__seen"))
    along = Window.partitionBy(*key).orderBy("__seen", name)
    return first.select(*key, name, F.row_number().over(along).alias("place"))


#: Verbs of speech, as lemmas.
SPEECH_VERBS = (
    "say", "tell", "ask", "reply", "shout", "whisper", "exclaim", "mutter", "state", "declare", "respond", "add", "continue",
    "begin", "murmur", "interject", "question", "answer", "stammer", "insist", "suggest", "warn",
)
_IRREGULAR = {"say": "said", "tell": "told", "begin": "began"}


def _past(verb: str) -> str:
    if verb in _IRREGULAR:
        return _IRREGULAR[verb]
    if verb.endswith("e"):
        return verb + "d"
    return verb[:-1] + "ied" if verb.endswith("y") and verb[-2] not in "aeiou" else verb + "ed"


def speech_pattern() -> str:
    """A verb of speech in past or present tense (a rule in place of a lemmatizer)."""
    return "(?:" + "|".join(f"{_past(v)}|{v}s" for v in SPEECH_VERBS) + ")"


def quoted_speakers(sentences: DataFrame, key: list[str], text: str) -> DataFrame:
    """Who speaks in a quoted sentence: a capitalised name before or after a verb of speech.

    A sentence without a quotation mark has no speaker; the name after the verb comes first.
    """
    name, verb = r"(\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?)", speech_pattern()
    after = F.regexp_extract(text, rf"\b{verb} {name}", 1)
    before = F.regexp_extract(text, rf"{name} {verb}\b", 1)
    speaker = F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit("")))
    quoted = F.rlike(F.col(text), F.lit("[\"“”«»]"))
    return sentences.where(quoted & speaker.isNotNull()).select(*key, speaker.alias("speaker"))
