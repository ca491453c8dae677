"""Package names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_SPEC = r"(?i)^(?:git\+|git://|github:|gitlab:|bitbucket:|https?://)"
EXACT_VERSION = r"^\d+(?:\.\d+)*(?:[-+.][0-9A-Za-z.\-]+)?$"
COMMIT_PIN = r"[@#][0-9a-f]{40}\b"


def normalized_name(name: Column, ecosystem: Column) -> Column:
    lower = F.lower(F.btrim(name))
    return F.when(ecosystem == "pypi", F.regexp_replace(lower, "[-_.]+", "-")).otherwise(lower)


def is_url_spec(spec: Column) -> Column:
    return F.btrim(F.coalesce(spec, F.lit(""))).rlike(URL_SPEC)


def is_unpinned(spec: Column, version: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(spec, F.lit("")))).isin("", "*", "latest", "x") & version.isNull()


def exact_version(spec: Column) -> Column:
    """The spec when it names one version, else null."""
    bare = F.ltrim(F.btrim(spec), F.lit("=v"))
    return F.when(bare.rlike(EXACT_VERSION), bare)


def version_numbers(text: Column) -> Column:
    """Leading numeric part as an array of integers; null when there is none."""
    digits = F.regexp_extract(F.btrim(text), r"^v?(\d+(?:\.\d+)*)", 1)
    return F.when(digits != "", F.transform(F.split(digits, r"\."), lambda p: p.cast("long")))


def _padded(numbers: Column, width: Column) -> Column:
    return F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), (width - F.size(numbers)).cast("int")))


def version_in(version: Column, rule: Column) -> Column:
    """Does a version satisfy a rule such as `1.2.3`, `>=1.0.16` or `*`?"""
    rule = F.btrim(rule)
    op = F.regexp_extract(rule, "^(>=|<=|==|>|<)", 1)
    have = version_numbers(version)
    want = version_numbers(F.regexp_replace(rule, "^(?:>=|<=|==|>|<)", ""))
    width = F.greatest(F.size(have), F.size(want))
    a, b = _padded(have, width), _padded(want, width)
    compared = (
        F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b).otherwise(a == b)
    )
    bare = lambda c: F.ltrim(F.btrim(c), F.lit("v"))
    return (
        F.when(rule == "*", F.lit(True))
        .when(op != "", F.coalesce(compared, F.lit(False)))
        .otherwise(bare(version) == bare(rule))
    )


def one_edit_apart(a: Column, b: Column) -> Column:
    """Equal, or one insertion, deletion, replacement or swap of neighbours apart."""
    close = F.levenshtein(a, b, 1) >= 0
    # Same length and same letters except two neighbours that changed places.
    n = F.char_length(a)
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (
            F.concat(
                F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)
            )
            == b
        ),
    )
    return close | ((n == F.char_length(b)) & (n >= 2) & swapped)


def deletions(name: Column) -> Column:
    """The name itself and every name made by deleting one character."""
    return F.array_distinct(
        F.concat(
            F.array(name),
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1))),
                lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)),
            ),
        )
    )


def command_basename(command: Column) -> Column:
    """Program name without folder or Windows suffix."""
    return F.regexp_replace(
        F.lower(F.regexp_extract(command, r"([^/\\]*)[/\\]*$", 1)), r"\.(?:exe|cmd|bat)$", ""
    )
