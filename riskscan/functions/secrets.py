"""Secrets in text: which kinds there are, finding them, hiding them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SecretKind:
    """One kind of secret. `anchors` are literals, one of which every match contains."""

    name: str
    regex: str
    anchors: tuple[str, ...]
    group: int = 0


# Public formats of issued keys.
ISSUED_KEYS = (
    SecretKind("cloud access key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", ("AKIA", "ASIA")),
    SecretKind("code host token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})\b", ("gh", "github_pat_")),
    SecretKind("code host token", r"\bglpat-[A-Za-z0-9_\-]{20,}", ("glpat-",)),
    SecretKind("chat token", r"\bxox[abeoprs]-[A-Za-z0-9\-]{10,}", ("xox",)),
    SecretKind("client api key", r"\bAIza[A-Za-z0-9_\-]{35}", ("AIza",)),
    SecretKind("payment key", r"\b[rs]k_live_[A-Za-z0-9]{16,}", ("k_live_",)),
    SecretKind("model provider key", r"\bsk-(?:[a-z]+-)?[A-Za-z0-9_\-]{24,}", ("sk-",)),
    SecretKind("registry token", r"\bnpm_[A-Za-z0-9]{36}\b", ("npm_",)),
    SecretKind("registry token", r"\bpypi-[A-Za-z0-9_\-]{50,}", ("pypi-",)),
    SecretKind("private key", r"-----BEGIN (?:[A-Z]+ ){0,8}PRIVATE KEY-----", ("PRIVATE KEY-----",)),
    SecretKind("signed token", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", ("eyJ",)),
)
# A quoted literal given to a name that means a secret. The value needs a digit and a letter,
# so references such as `config.token` or words such as "changeme" do not count.
ASSIGNED = SecretKind(
    "assigned credential",
    r"(?i)(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|credentials?)[\"']?\s*[:=]\s*"
    r"[\"']([A-Za-z0-9_\-+/=.~!@#%^&*]{16,})[\"']",
    ("key", "secret", "token", "passw", "pwd", "credential"),
    group=1,
)
KINDS = (*ISSUED_KEYS, ASSIGNED)
ANY_ANCHOR = "(?i)" + "|".join(sorted({re.escape(a) for k in KINDS for a in k.anchors}))
PLACEHOLDER = r"(?i)^(?:your|my|the|example|sample|dummy|test|change|replace|insert|xxx|<|\$\{|\{\{|%)|x{6,}|\*{4,}|\.\.\."


def _present(text: Column, kind: SecretKind) -> Column:
    haystack = F.lower(text) if kind.regex.startswith("(?i)") else text
    found = F.lit(False)
    for anchor in kind.anchors:
        found = found | F.contains(haystack, F.lit(anchor))
    return found


def _is_real(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def find_secrets(text: Column) -> Column:
    """Every secret in the text as an array of (kind, value)."""
    found = []
    for kind in KINDS:
        values = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(kind.group))
        if kind.group:
            # An issued key inside quotes is reported under its own kind only.
            values = F.filter(values, lambda v: _is_real(v) & ~_any_issued(v))
        found.append(
            F.when(
                _present(text, kind),
                F.transform(values, _tagged(kind.name)),
            ).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
        )
    return F.concat(*found)


def _tagged(name: str):
    return lambda value: F.struct(F.lit(name).alias("kind"), value.alias("value"))


def _any_issued(value: Column) -> Column:
    return value.rlike("|".join(f"(?:{k.regex})" for k in ISSUED_KEYS))


def has_secret(text: Column) -> Column:
    """Does the text hold any secret? Equal to a non-empty `find_secrets`, but cheaper."""
    issued = [a for k in ISSUED_KEYS for a in k.anchors]
    anchored = text.rlike("|".join(re.escape(a) for a in issued))
    assigned = F.regexp_extract_all(text, F.lit(ASSIGNED.regex), F.lit(ASSIGNED.group))
    return (anchored & _any_issued(text)) | (_present(text, ASSIGNED) & F.exists(assigned, _is_real))


def redact(text: Column) -> Column:
    """The text with every secret replaced by a marker naming its kind."""
    # One test for all kinds; the replacements are chained and only run where it holds. The values
    # that are hidden are the ones that are found, however long; names and quotes around them stay.
    values = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(ASSIGNED.regex), F.lit(ASSIGNED.group)), _is_real))
    longest_first = F.transform(F.reverse(F.array_sort(F.transform(values, lambda v: F.struct(F.char_length(v), v.alias("v"))))), lambda x: x["v"])
    hidden = F.aggregate(longest_first, text, lambda acc, v: F.replace(acc, v, F.lit(f"[REDACTED {ASSIGNED.name}]")))
    for kind in ISSUED_KEYS:
        hidden = F.regexp_replace(hidden, kind.regex, f"[REDACTED {kind.name}]")
    return F.when(text.rlike(ANY_ANCHOR), hidden).otherwise(text)


def mask(value: Column) -> Column:
    """The first four characters of a long value, then stars."""
    return F.when(F.char_length(value) >= 12, F.concat(F.left(value, F.lit(4)), F.lit("****"))).otherwise(
        F.lit("****")
    )


def name_looks_secret(name: Column) -> Column:
    """A parameter, header or variable name that usually carries a credential."""
    return F.lower(name).rlike(
        r"(?:^|[_\-.])(?:api[_\-]?key|apikey|access[_\-]?key|secret[_\-]?key|private[_\-]?key|token|secret|password|passwd|pwd"
        r"|credentials?|auth|authorization|key|sig|signature)$"
    )


def is_key_name(name: Column) -> Column:
    """An environment variable name that ends like a key."""
    return name.rlike(r"(?:^|_)(?:KEY|APIKEY|TOKEN|SECRET|PASSWORD|PASSWD|PAT|CREDENTIALS?)$")


SECRET_FLAG = r"(?i)^--?(?:api[_-]?key|apikey|key|access[_-]?token|auth[_-]?token|token|secret|client[_-]?secret|password|passwd|pwd)$"


def mask_args(args: Column) -> Column:
    """Launch arguments with the value of secret flags hidden."""
    return F.transform(
        args,
        lambda a, i: F.when(
            a.rlike(SECRET_FLAG[:-1] + "="), F.concat(F.substring_index(a, "=", 1), F.lit("=****"))
        )
        .when((i > 0) & F.get(args, i - 1).rlike(SECRET_FLAG), F.lit("****"))
        .otherwise(redact(a)),
    )


def mask_command_line(line: Column) -> Column:
    """The same for a command line held in one string."""
    hidden = F.regexp_replace(
        line,
        r"(?i)(--?(?:api[_-]?key|apikey|key|access[_-]?token|auth[_-]?token|token|secret|client[_-]?secret|password|passwd|pwd))([= ]+)\S+",
        "$1$2****",
    )
    return redact(hidden)
