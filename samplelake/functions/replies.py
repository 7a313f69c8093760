"""Reply columns: fenced blocks, lenient JSON, typed fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from samplelake.functions.text import let, strip

_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_COMMENT = rf"({_STRING})|//[^\n]*"


def _literal(word: str) -> str:
    """``word`` outside of strings: matches chain from token to token (``\\G``)."""
    first, rest = word[0], word[1:]
    return rf'\G((?:[^"{first}]++|{_STRING}|{first}(?!{rest}\b))*+){word}\b'


def extract_fenced(text: Column, language: str) -> Column:
    """The first fenced block of a language, trimmed; the whole text if there is none."""
    pattern = rf"(?is)```{language}\b(.*?)```"
    return strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def _where(text: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that contain ``mark``; the others are left alone unread."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def clean_json(text: Column) -> Column:
    """JSON text of a reply: fence removed, comments dropped, ``True``/``False`` lowered.

    Strings are left as they are, so an address with ``//`` in it survives.
    """
    body = extract_fenced(text, "json")
    body = _where(body, "//", lambda t: F.regexp_replace(t, _COMMENT, "$1"))
    body = _where(body, "True", lambda t: F.regexp_replace(t, _literal("True"), "$1true"))
    body = _where(body, "False", lambda t: F.regexp_replace(t, _literal("False"), "$1false"))
    return strip(body)


def parse_lenient(text: Column) -> Column:
    """Reply text to VARIANT; null where no JSON can be read."""
    return F.try_parse_json(clean_json(text))


def parse_quoted(text: Column) -> Column:
    """JSON text to VARIANT, also when single quotes are used; null where neither is readable."""
    single = F.from_json(text, "variant", {"allowSingleQuotes": "true", "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(F.try_parse_json(text), single)


def field(value: Column, name: str, kind: str = "string") -> Column:
    """A field of a VARIANT object as a typed column: absent, null or of another type is null."""
    if "'" in name and '"' in name:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        return F.try_variant_get(F.try_element_at(members, F.lit(name)), "$", kind)
    mark = '"' if "'" in name else "'"
    return F.try_variant_get(value, f"$[{mark}{name}{mark}]", kind)


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def has_fields(value: Column, kinds: Mapping[str, str]) -> Column:
    """All fields are there and read as the kind given for them."""
    checks = F.lit(True)
    for name, kind in kinds.items():
        checks = checks & field(value, name, kind).isNotNull()
    return F.coalesce(checks, F.lit(False))
