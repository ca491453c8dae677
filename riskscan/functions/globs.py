"""Shell-style name patterns as regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """An anchored regular expression for one glob; `*`, `?` and `[...]` are understood."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_regex_col(glob: Column) -> Column:
    """The same for a column of globs (`*` and `?` only)."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(
        F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")
    )


def matches_glob(value: Column, glob: str) -> Column:
    return F.lit(True) if glob == "*" else value.rlike(glob_regex(glob))


def rule_matches(rule_id: Column, patterns: Iterable[str]) -> Column:
    """A rule id is named exactly, by a glob, or by a dash-delimited prefix, in any letter case."""
    upper = F.upper(rule_id)
    found = F.lit(False)
    for raw in patterns:
        pattern = raw.strip().upper()
        if pattern:
            found = found | upper.rlike(glob_regex(pattern)) | upper.startswith(pattern.rstrip("-") + "-")
    return found


def rule_matches_col(rule_id: Column, pattern: Column) -> Column:
    """The same test where the pattern is a column."""
    upper, wanted = F.upper(rule_id), F.upper(F.btrim(pattern))
    return (wanted != "") & (
        F.rlike(upper, glob_regex_col(wanted))
        | F.startswith(upper, F.concat(F.rtrim(wanted, F.lit("-")), F.lit("-")))
    )


def glob_regex_of(glob: Column) -> Column:
    """The regular expression of `glob_regex` for a column of globs, bracketed sets included."""
    body = lambda t: F.regexp_replace(F.substr(t, F.lit(2), F.char_length(t) - 2), r"\\", r"\\\\")
    one = lambda t: (
        F.when(t == "*", ".*").when(t == "?", ".")
        .when(F.char_length(t) > 1, F.concat(F.lit("["), F.when(F.startswith(body(t), F.lit("!")), F.concat(F.lit("^"), F.substr(body(t), F.lit(2)))).otherwise(body(t)), F.lit("]")))
        .otherwise(F.regexp_replace(t, r"([\\.\[\]{}()+^$|*?#&~\s-])", r"\\$1"))
    )
    tokens = F.regexp_extract_all(glob, F.lit(r"(?s)\[.[^\]]*\]|."), F.lit(0))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("$"))


def ignore_regex(pattern: Column) -> Column:
    """The regular expression of a line of an ignore file, for paths relative to the folder of the file.

    A pattern with a slash that is not its last sign is tied to the folder, others fit at any depth.
    A star and a question mark stop at slashes, two stars between slashes don't. The leading `!` and
    the last slash are not part of it.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"^!", ""), r"/+$", ""), r"^\\([#!])", "$1")
    tied = bare.contains("/")
    bare = F.regexp_replace(bare, "^/", "")
    # An opening bracket without a closing one stands for itself.
    open_ = F.when(bare.rlike(r"\[[^\]]+\]"), bare).otherwise(F.replace(F.replace(bare, F.lit("["), F.lit("\x03")), F.lit("]"), F.lit("\x04")))
    quoted = F.regexp_replace(open_, r"([\\.{}()+^$|])", r"\\$1")
    steps = [(r"^\*\*/|(?<=/)\*\*/", "\x01"), (r"/\*\*$", "\x02"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), (r"\[!", "[^"), ("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", r"\\["), ("\x04", r"\\]")]
    for old, new in steps:
        quoted = F.regexp_replace(quoted, old, new)
    return F.concat(F.lit("(?s)^"), F.when(tied, "").otherwise("(?:.*/)?"), quoted, F.lit("$"))
