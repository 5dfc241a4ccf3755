"""Text functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom.functions.documents import let

#: Sentinel put after a sentence end before splitting there.
_CUT = "\u0001"
SENTENCE_GAP = r"([.!?])\s+"


def strip_space(text: Column) -> Column:
    """Without white space at both ends (every kind, not blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(text: Column, gap: str = "\n\n") -> Column:
    """Trimmed non-empty paragraphs; null for null."""
    parts = F.transform(F.split(text, gap), strip_space)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences: a cut after ``.``, ``!`` or ``?`` and white space.

    A rule in place of a trained tokenizer: abbreviations end a sentence.
    """
    marked = F.regexp_replace(text, SENTENCE_GAP, "$1" + _CUT)
    return F.filter(F.transform(F.split(marked, _CUT), strip_space), lambda s: s != "")


def node_id(message: Column, paragraph: Column, sentence: Column) -> Column:
    """The address of a sentence: message, paragraph and sentence number."""
    return F.concat_ws("_", message, paragraph, sentence)


def node_parts(node: Column) -> Column:
    """``struct<msg, para, sent>`` of an address; parts that are not numbers are null."""
    part = lambda i: F.try_to_number(F.get(F.split(node, "_"), F.lit(i)), F.lit("9999999999")).cast("int")
    return F.struct(part(0).alias("msg"), part(1).alias("para"), part(2).alias("sent"))


def loose_words(text: Column) -> Column:
    """Lower case, letters and digits only, single blanks, a blank at both ends: whole
    words can then be found by plain search."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def has_quote(text: Column) -> Column:
    """Whether a quotation mark occurs; the ASCII apostrophe counts, so contractions do."""
    return F.rlike(text, F.lit("[\"'“”‘’]"))


def strip_thinking(text: Column) -> Column:
    """What follows the model's thoughts.

    A text without any mark stays as it stands.  With an opening mark all before the first fitting
    closing mark goes, what stood before the opening one too; without a closing mark nothing is
    left.  A lone closing mark takes what stands before it.  Marks may carry a name (``<ns:think>``),
    which the closing one repeats.
    """
    opened, closed = r"(?s)<((?:.+?:)?)think>", r"(?s)</(?:.+?:)?think>"
    name = F.regexp_extract(text, opened, 1)
    has_open = F.rlike(text, F.lit(opened))
    own_close = F.concat(F.lit("</"), name, F.lit("think>"))
    after_own = F.substr(text, F.position(own_close, text) + F.length(own_close))
    after_any = F.regexp_replace(text, r"(?s)^.*?</(?:.+?:)?think>", "")
    ended = F.when(name != "", F.contains(text, own_close)).otherwise(F.rlike(text, F.lit(closed)))
    rest = F.regexp_replace(F.when(name != "", after_own).otherwise(after_any), r"^\s+", "")
    return F.when(ended, rest).when(has_open, F.lit("")).otherwise(text)


#: What counts as the inside of an answer, tried in this order; lines end at line feeds only.
FENCES = (
    r'^[ \t]*(?:```(?:\S*)?|""")(.*?)(?:```|""")',
    r"^(?:\}|\S.*?\})(\{.*\})",
    r"(\{.*?^\})",
)


def strip_fences(text: Column) -> Column:
    """The inside of the first block that a line opens with a fence or triple quotes, else an object that follows
    another one's end, else an object whose end begins a line, else the text."""
    hit = lambda p: F.when(F.rlike(text, F.lit(f"(?msd){p}")), F.regexp_extract(text, f"(?msd){p}", 1))
    return F.coalesce(*[hit(p) for p in FENCES], text)


def strip_response(text: Column) -> Column:
    """``strip_thinking`` and then ``strip_fences``."""
    return let(strip_thinking(text), strip_fences)


def strip_markers(text: Column) -> Column:
    """Without path markers: a blank, twelve ``<``, a blank and the path to the line's end."""
    return F.regexp_replace(text, r" <{12} [^\n]*", "")


def mark_field(value: Column, path: Column) -> Column:
    return F.concat(value, F.lit(" " + "<" * 12 + " "), path)


#: White space of one byte, the same class in every dialect.
_WHITE = r"[\t-\r ]"
#: Introductions that a model puts before its answer, whatever the case.
INTRODUCTIONS = (
    r"(?:Here's|Here is) my response as \"\w+\":",
    r"(?:Of course|Certainly|Here is the response|Here's the story|Here is your story), as requested:",
)
#: Words from which on a block that looks like a title is a paragraph.
TITLE_WORDS = 8


def meaningful_paragraphs(text: Column) -> Column:
    """Paragraphs that say something, joined by blank lines; empty for null.

    Quotation marks around the whole text and an introduction are removed, the text is cut at blank
    lines, a list mark with a bold title before a paragraph goes, and blocks that are titles are
    dropped: bold ones that are short or end in a colon, others that are short and end in a colon.
    """
    trim = lambda t: F.regexp_replace(t, rf"^{_WHITE}+|{_WHITE}+$", "")
    bare = trim(F.coalesce(text, F.lit("")))
    wrapped = F.startswith(bare, F.lit('"')) & F.endswith(bare, F.lit('"'))
    bare = F.when(wrapped, trim(F.substr(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))))).otherwise(bare)
    for introduction in INTRODUCTIONS:
        bare = F.regexp_replace(bare, rf"(?i)^{introduction}{_WHITE}*", "")
    blocks = F.transform(F.split(trim(bare), rf"\n{_WHITE}*\n+"), trim)
    blocks = F.transform(
        F.filter(blocks, lambda b: b != ""),
        lambda b: F.regexp_replace(b, rf"^{_WHITE}*[*-]{_WHITE}*\*\*([^\n]*?)\*\*:{_WHITE}*", ""),
    )

    def few(block: Column) -> Column:
        return F.size(F.filter(F.split(block, rf"{_WHITE}+"), lambda w: w != "")) < TITLE_WORDS

    def is_title(block: Column) -> Column:
        inside = trim(F.substr(block, F.lit(3), F.greatest(F.length(block) - 4, F.lit(0))))
        colon = F.endswith(block, F.lit(":"))
        bold = F.startswith(block, F.lit("**")) & F.endswith(block, F.lit("**"))
        return (bold & (few(inside) | F.endswith(inside, F.lit(":")))) | (few(block) & colon)

    return F.array_join(F.filter(blocks, lambda b: ~is_title(b)), "\n\n")


def strip_prefixes(text: Column, prefixes: list[str]) -> Column:
    """Without each of ``prefixes``, in this order and once, whatever the case."""
    for prefix in prefixes:
        text = F.regexp_replace(text, rf"(?i)^\Q{prefix}\E\s*", "")
    return text


def command_flags(text: Column) -> dict[str, Column]:
    """Which command a message begins with, and the message without it."""
    flags = {name: F.startswith(text, F.lit(f"NEXT {name.upper()}:")) for name in ("scene", "chapter", "arc")}
    rest = F.ltrim(F.regexp_replace(text, r"^NEXT (?:SCENE|CHAPTER|ARC):", ""))
    return {**{f"is_{n}": f for n, f in flags.items()}, "rest": rest}


def preview(text: Column, most: int = 200) -> Column:
    """The first ``most`` characters with dots after them, or all of a shorter text."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def title_of_id(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def path_tokens(path: Column) -> Column:
    """Steps of a path: ``a.b[0]["c"]`` gives ``a, b, 0, c``."""
    dotted = F.regexp_replace(path, r"\[([^\]]+)\]", ".$1")
    parts = F.split(F.regexp_replace(dotted, "[\"']", ""), r"\.")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def references(template: Column) -> Column:
    """References of a template to other subjects: ``{subjects.a.b}``."""
    return F.regexp_extract_all(template, F.lit(r"(\{subjects\.[^}]+\})"), F.lit(1))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with every ``{key}`` replaced; unknown keys stay as they are."""
    filled = F.lit(template)
    for key, value in values.items():
        filled = F.replace(filled, F.lit("{" + key + "}"), value)
    return filled


def tool_call(text: Column) -> Column:
    """``struct<name, arguments>`` of the first tool call; arguments that are no JSON
    object are ``{}``, no call gives null."""
    body = F.regexp_extract(text, r"(?s)<tool_call>(.*?)</tool_call>", 1)
    name = F.trim(F.regexp_extract(body, r"name:\s*([\w.]+)", 1))
    given = F.regexp_extract(body, r"(?s)arguments:\s*(.*?)\s*$", 1)
    braced = F.when(F.startswith(given, F.lit("{")), given).otherwise(F.concat(F.lit("{"), given, F.lit("}")))
    arguments = F.when(F.json_object_keys(braced).isNotNull(), braced).otherwise(F.lit("{}"))
    return F.when(name != "", F.struct(name.alias("name"), arguments.alias("arguments")))


#: A patch: where to write, what (as JSON), and how that is read.
PATCHES = "array<struct<path:string,value:string,kind:string>>"


def patches_of(answer: Column) -> Column:
    """The valid patches of an answer in their order: a list, one object, or lines ``path: a.b, value: v``.

    A closing END_OF_UPDATES, thoughts and fences are removed.  An empty answer and NO alone have
    none; items of a list without a textual path or without a value are left out (a null value is
    one).  ``value`` is JSON: what is not JSON of its own is written as a string; ``kind`` tells
    its type.
    """
    ended = lambda t: F.when(F.endswith(t, F.lit("END_OF_UPDATES")), F.left(t, F.length(t) - 14)).otherwise(t)
    return let(
        let(strip_space(answer), lambda t: strip_space(ended(t))),
        lambda said: let(strip_space(strip_response(said)), lambda body: _parsed_patches(said, body)),
    )


def _parsed_patches(said: Column, body: Column) -> Column:
    listed = F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")).when(
        F.json_object_keys(body).isNotNull(), F.array(body)
    )

    def item(text: Column) -> Column:
        keys = F.json_object_keys(text)
        raw = F.from_json(text, "path string, value string")
        plain = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0].path")
        textual = F.rlike(text, F.lit(r'"path"\s*:\s*"'))
        value = F.when(raw["value"].isNull(), "null").when(
            F.rlike(text, F.lit(r'"value"\s*:\s*"')), F.to_json(F.array(raw["value"]))
        ).otherwise(raw["value"])
        value = F.when(F.rlike(text, F.lit(r'"value"\s*:\s*"')), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.when(
            F.array_contains(keys, "path") & F.array_contains(keys, "value") & textual & plain.isNotNull(),
            F.struct(raw["path"].alias("path"), value.alias("value"), literal_type(value).alias("kind")),
        )

    lines = F.regexp_extract_all(body, F.lit(r"(?m)^\s*path\s*:\s*[^,]+?\s*,\s*value\s*:\s*.+$"), F.lit(0))
    parsed = F.transform(
        lines,
        lambda line: let(
            let(F.trim(F.regexp_extract(line, r"value\s*:\s*(.+)$", 1)), literal_value),
            lambda value: F.struct(
                F.trim(F.regexp_extract(line, r"path\s*:\s*([^,]+?)\s*,", 1)).alias("path"), value.alias("value"), literal_type(value).alias("kind")
            ),
        ),
    )
    none = F.array().cast(PATCHES)
    items = F.filter(F.transform(listed, item), lambda p: p.isNotNull())
    return F.when((said == "") | (said == "NO"), none).when(listed.isNotNull(), items.cast(PATCHES)).otherwise(parsed.cast(PATCHES))


def patch_lines(text: Column) -> Column:
    """``array<struct<path, value>>`` of an answer's patches, values as text."""
    return F.transform(patches_of(text), lambda p: F.struct(p["path"].alias("path"), p["value"].alias("value")))


def literal_value(text: Column) -> Column:
    """A written value as JSON: itself if it is JSON, a word for true, false or null as that, else a string."""
    low = F.lower(text)
    number = F.rlike(text, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"))
    quoted = F.rlike(text, F.lit(r'^"(?:[^"\\]|\\.)*"$'))
    nested = (F.startswith(text, F.lit("{")) & F.json_object_keys(text).isNotNull()) | (
        F.startswith(text, F.lit("[")) & F.json_array_length(text).isNotNull()
    )
    escaped = F.to_json(F.array(text))
    return (
        F.when(low.isin("true", "false", "null"), low)
        .when(number, F.regexp_replace(text, r"^\+", ""))
        .when(quoted | nested, text)
        .otherwise(F.substr(escaped, F.lit(2), F.length(escaped) - 2))
    )


def literal_type(value: Column) -> Column:
    """What a JSON value is: boolean, null, int, float, list, dict or string."""
    return (
        F.when(value.isin("true", "false"), "boolean")
        .when(value == "null", "null")
        .when(F.rlike(value, F.lit(r"^-?\d+$")), "int")
        .when(F.rlike(value, F.lit(r"^-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")), "float")
        .when(F.startswith(value, F.lit("[")), "list")
        .when(F.startswith(value, F.lit("{")), "dict")
        .otherwise("string")
    )


def typed_answer(answer: Column, kind: Column) -> Column:
    """An answer as JSON of the type that a field asks for; null if it does not fit, which asks for another try.

    ``kind``: int, float, bool, list, list[str], dict or anything else (a string).  A list of strings that
    is no JSON is cut at commas; true, yes and 1 are true, any other word false.
    """
    return let(strip_space(strip_response(answer)), lambda said: _typed(said, kind))


def _typed(said: Column, kind: Column) -> Column:
    whole = F.when(F.rlike(said, F.lit(r"^[+-]?\d+$")), said.try_cast("bigint").cast("string"))
    number = F.when(F.rlike(said, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")), said.try_cast("double").cast("string"))
    listed = F.when(F.startswith(said, F.lit("[")) & F.json_array_length(said).isNotNull(), said)
    parts = F.filter(F.transform(F.split(said, ","), strip_space), lambda x: x != "")
    keyed = F.when(F.json_object_keys(said).isNotNull(), said)
    text = F.to_json(F.array(said))
    return (
        F.when(kind == "int", whole)
        .when(kind == "float", number)
        .when(kind == "bool", F.lower(said).isin("true", "yes", "1").cast("string"))
        .when(kind == "list[str]", F.coalesce(listed, F.to_json(parts)))
        .when(F.startswith(kind, F.lit("list")), listed)
        .when(F.startswith(kind, F.lit("dict")), keyed)
        .otherwise(F.substr(text, F.lit(2), F.length(text) - 2))
    )


def stop_hit(text: Column, stops: list[str], *, anywhere: bool) -> Column:
    """The first of ``stops``, in their order, that ``text`` begins with (white space aside) or holds; null if none."""
    low = F.regexp_replace(text, r"^\s+", "")
    test = (lambda s: F.contains(text, s)) if anywhere else (lambda s: F.startswith(low, s))
    return F.get(F.filter(F.array(*[F.lit(s) for s in stops]), test), F.lit(0))


def clock_part(stamp: Column) -> Column:
    """What follows the T of an ISO time; null without one."""
    return F.nullif(F.split_part(stamp, F.lit("T"), F.lit(2)), F.lit(""))


def template_dialect(template: Column) -> Column:
    """``jinja`` if a template opens an expression or a statement of that dialect, else ``format``."""
    return F.when(F.contains(template, F.lit("{{ ")) | F.contains(template, F.lit("{%")), "jinja").otherwise("format")


def tool_response(status: Column, output: Column, error: Column) -> Column:
    """The answer of a tool as JSON text: its output, or an object with the error."""
    failed = F.concat(F.lit('{"error": '), F.substr(F.to_json(F.array(error)), F.lit(2), F.length(F.to_json(F.array(error))) - 2), F.lit("}"))
    return F.when(status == "error", failed).otherwise(output)


def bullet_text(entries: Column, most: int = 2_000) -> Column:
    """A map as lines ``- key: value`` in the order written, cut to ``most`` characters with dots."""
    lines = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    text = F.array_join(lines, "\n")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
