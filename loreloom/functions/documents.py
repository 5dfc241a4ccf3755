"""JSON documents as people and models write them: find, clean and open one object.

All functions are column expressions.  Objects are opened one level at a time into
``map<string,string>``, which keeps the written order of the keys (a VARIANT sorts
them); nested values stay JSON text until a projection asks for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and the byte order mark, trimmed from both ends of a document.
_EDGE = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\ufeff"
_LEADING_COMMENTS = "^(?:\\s*(?:/\\*[\\s\\S]*?\\*/|//[^\\n]*\\n))+"
_OBJECT_SPAN = "(?s)^.*?(\\{\\s*(?:(?:\"|/[*/]).*\\}|\\}))[^}]*$"
_STRING_OR_COMMENT = "(\"[^\"]*\")|/\\*[\\s\\S]*?\\*/|//[^\\n]*"
#: Stand-ins for escaped backslash and quote while strings are told from comments.
_BACKSLASH, _QUOTE = "", ""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _unquoted(text: Column) -> Column:
    """The string that a JSON string literal spells (twice over if need be); other text as it is."""

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        literal = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
        opened = let(F.btrim(literal, F.lit(_EDGE)), then)
        return F.when(F.startswith(value, F.lit('"')), opened).otherwise(value)

    return let(F.btrim(text, F.lit(_EDGE)), lambda outer: once(outer, lambda inner: once(inner, lambda x: x)))


def _without_comments(text: Column) -> Column:
    held = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    held = F.regexp_replace(held, _STRING_OR_COMMENT, "$1")
    return F.replace(F.replace(held, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))


def is_object(text: Column) -> Column:
    """Whether ``text`` begins with one complete JSON object."""
    return F.json_object_keys(text).isNotNull()


def _searched(text: Column) -> Column:
    start = F.regexp_extract(F.regexp_replace(text, _LEADING_COMMENTS, ""), _OBJECT_SPAN, 1)
    return let(
        F.nullif(start, F.lit("")),
        lambda found: F.when(is_object(found), found).otherwise(
            let(_without_comments(found), lambda clean: F.when(is_object(clean), clean))
        ),
    )


def object_text(doc: Column) -> Column:
    """The JSON object that ``doc`` holds, as clean JSON text, else null.

    The object may stand in a byte order mark, prose, a fenced block, a JSON string
    literal (also twice over) or a list, and may carry comments outside its strings.
    Null, blank, cut-off and object-free docs give null; of several objects the first
    is taken.
    """
    return let(
        _unquoted(doc),
        lambda text: F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & is_object(text), text).otherwise(_searched(text)),
    )


def fields(text: Column, *names: str) -> Column:
    """The named fields of an object as text: a string's value, other values' JSON."""
    return F.from_json(text, ", ".join(f"`{n}` string" for n in names))


_MEMBERS = "array<struct<key:string,item:string>>"


def _mapped_members(keyed: Column, lone: Column) -> Column:
    name = F.try_element_at(keyed, F.lit("name"))
    named = name.isNotNull() & ~F.startswith(name, F.lit("{")) & ~F.startswith(name, F.lit("["))
    listed = F.transform(
        F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item"))
    )
    return F.when(named, lone).otherwise(F.coalesce(listed.cast(_MEMBERS), lone))


def members(text: Column) -> Column:
    """``array<struct<key, item>>`` of a collection in the order written.

    A list gives null keys, a keyed map its keys; a lone value (also an object with a
    textual ``name``) is a list of one; null gives null.
    """
    no_key = F.lit(None).cast("string").alias("key")

    def opened(value: Column) -> Column:
        lone = F.array(F.struct(no_key, value.alias("item"))).cast(_MEMBERS)
        listed = F.transform(F.from_json(value, "array<string>"), lambda x: F.struct(no_key, x.alias("item")))
        return (
            F.when(F.startswith(value, F.lit("[")), F.coalesce(listed.cast(_MEMBERS), lone))
            .when(
                F.startswith(value, F.lit("{")),
                let(F.from_json(value, "map<string,string>"), lambda keyed: _mapped_members(keyed, lone)),
            )
            .when(value.isNotNull(), lone)
        )

    return let(text, opened)


def member_name(member: Column) -> Column:
    """A member's ``name``, else the member itself if it is plain, else its key."""
    item = member["item"]
    return F.when(
        F.startswith(item, F.lit("{")), F.coalesce(fields(item, "name")["name"], member["key"])
    ).otherwise(item)
