"""JSON text to VARIANT, tolerating comments and trailing commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A string literal, or a comment. Replacing with group 1 keeps strings and drops comments.
STRING_OR_COMMENT = r'("(?:[^"\\]|\\.)*+")|//[^\n]*|/\*(?s:.*?)\*/'
# A string literal, or a comma that only closing brackets follow.
STRING_OR_TRAILING_COMMA = r'("(?:[^"\\]|\\.)*+")|,(?=\s*[}\]])'


def strip_comments(text: Column) -> Column:
    """Text without // and /* */ comments; nothing inside a string is touched."""
    return F.regexp_replace(text, STRING_OR_COMMENT, "$1")


def relaxed(text: Column) -> Column:
    return F.regexp_replace(strip_comments(text), STRING_OR_TRAILING_COMMA, "$1")


def parse(text: Column) -> Column:
    """VARIANT of a JSON document; plain JSON first, then without comments and trailing commas."""
    plain = F.try_parse_json(text)
    return F.when(plain.isNotNull(), plain).otherwise(F.try_parse_json(relaxed(text)))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def object_at(v: Column, path: str) -> Column:
    """The object at a path as VARIANT; null when it is missing or not an object."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(is_object(at), at)


def truthy(v: Column) -> Column:
    """The value unless it is missing, empty, zero or false."""
    return F.when(~F.to_json(v).isin("{}", "[]", "null", '""', "0", "false"), v)


def text_at(v: Column, path: str) -> Column:
    """The string at a path; null when it is missing or not a string."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def any_text_at(v: Column, path: str) -> Column:
    """The value at a path as text, whatever its type."""
    return F.try_variant_get(v, path, "string")


def items_at(v: Column, path: str) -> Column:
    """The array at a path; empty when there is none."""
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")
    )


def members_at(v: Column, path: str) -> Column:
    """The members of the object at a path as an array of (key, value), sorted by key."""
    return F.coalesce(
        F.map_entries(F.try_variant_get(v, path, "map<string,variant>")),
        F.array().cast("array<struct<key:string,value:variant>>"),
    )
