"""Text helpers: normalising, locating a match, excerpts, negation, escaping.

Positions are counted in code points. A match is located by splitting the text once at
the first match, which gives the text before it and after it without any offset maths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters by code point.
ZERO_WIDTH = r"\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
BIDI_CONTROLS = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
TAG_CHARACTERS = r"\x{E0000}-\x{E007F}"
INVISIBLE = f"[{ZERO_WIDTH}{BIDI_CONTROLS}{TAG_CHARACTERS}]"

# Characters that compatibility folding leaves alone and that never combine with each other.
# Text made only of these is already folded, so the costly step is skipped for it.
FOLDED_ALREADY = (
    r"\x00-\x7F\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{400}-\x{482}\x{48A}-\x{52F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}"
)
NEEDS_FOLDING = f"[^{FOLDED_ALREADY}]"
NON_ASCII = r"[^\x00-\x7F]"

# What words are made of, in any script.
WORD_SIGN = r"[\p{L}\p{M}\p{N}_]"

PAD = 60
DEFENSIVE_WINDOW = 200
NEGATION_WINDOW = 40
QUOTES = "[\"'`\\x{201C}\\x{201D}\\x{2018}\\x{2019}]"

# Words that turn a statement round, and how many words may stand between one and the match.
NEGATORS = ("cannot", "can't", "doesn't", "don't", "neither", "never", "no", "none", "nor", "not", "unable", "without", "won't")
NEGATOR_REACH = 3
# Beginnings of words for protecting, and names of what is protected against.
PROTECTING = (
    "block", "catch", "classif", "detect", "filter", "find", "flag", "guard", "identif", "mitigat", "moderat", "prevent", "protect", "reject", "report", "sanit",
    "scan", "spot", "stop", "warn",
)
DANGERS = (
    "abuse", "attack", "attacks", "exploit", "exploits", "injection", "injections", "jailbreak", "jailbreaks", "malicious", "malware", "phishing",
    "poisoned", "poisoning", "threat", "threats", "phrases like", "sentences like", "texts like", "patterns such as", "phrases such as",
)
PROTECTING_WORD = r"(?i)\b(?:" + "|".join(PROTECTING) + ")"
DANGER_WORD = r"(?i)\b(?:" + "|".join(d.replace(" ", r"\s+") for d in DANGERS) + r")\b"


def _icu(method: str, text: Column) -> Column:
    # Spark ships ICU for its collations; calling it keeps folding inside the JVM.
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(True))


def _can_change(text: Column) -> Column:
    """May folding change the text? Comparing two lengths settles plain ASCII first."""
    return (F.octet_length(text) != F.char_length(text)) & text.rlike(NEEDS_FOLDING)


def fold_compatible(text: Column) -> Column:
    """NFKC form. Only rows holding a character that can change pay for it."""
    return F.when(_can_change(text), _icu("compose", text)).otherwise(text)


def decompose_compatible(text: Column) -> Column:
    """NFKD form, again only where the text is not plain ASCII."""
    return F.when(text.rlike(NON_ASCII), _icu("decompose", text)).otherwise(text)


def normalize(text: Column) -> Column:
    """Compatibility form without zero-width, direction and tag characters."""
    return F.when(_can_change(text), F.regexp_replace(_icu("compose", text), INVISIBLE, "")).otherwise(text)


def split_at_match(text: Column, pattern: str) -> Column:
    """Text before the first match and text after it; a single element when nothing matches."""
    return F.split(text, pattern, 2)


def matched_text(text: Column, before: Column, after: Column) -> Column:
    """What sat between the two parts of a split."""
    return F.substr(
        text,
        F.char_length(before) + 1,
        F.char_length(text) - F.char_length(before) - F.char_length(after),
    )


def match_start(before: Column) -> Column:
    """Zero-based start of a match, in code points."""
    return F.char_length(before)


def line_of(before: Column) -> Column:
    """One-based line on which a match starts."""
    return F.char_length(before) - F.char_length(F.translate(before, "\n", "")) + 1


def one_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def excerpt(before: Column, matched: Column, after: Column, pad: int = PAD) -> Column:
    """The match with some context on one line; dots show where text was cut."""
    piece = F.concat(F.right(before, F.lit(pad)), matched, F.left(after, F.lit(pad)))
    return F.concat(
        F.when(F.char_length(before) > pad, F.lit("...")).otherwise(F.lit("")),
        F.btrim(one_line(piece), F.lit(" \t\x0b\x0c")),
        F.when(F.char_length(after) > pad, F.lit("...")).otherwise(F.lit("")),
    )


def ends_negated(text: Column) -> Column:
    """Is one of the last words of the text a negating one?"""
    # Words are whole in any script: "user_no" denies nothing, "_no_" does.
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD_SIGN}+(?:['\u2019]\p{{L}}+)?"), F.lit(0))
    last = F.transform(F.slice(F.reverse(words), 1, NEGATOR_REACH + 1), lambda w: F.btrim(F.replace(w, F.lit("\u2019"), F.lit("'")), F.lit("_")))
    return F.arrays_overlap(last, F.array(*[F.lit(n) for n in NEGATORS]))


def is_negated(before: Column, window: int = NEGATION_WINDOW) -> Column:
    """A negating word stands just before the match."""
    return ends_negated(F.right(before, F.lit(window)))


def last_clause(context: Column) -> Column:
    """The part of the context in the same clause as the match."""
    return F.element_at(F.split(context, r"[.!?;:\n]"), -1)


def clause_is_negated(context: Column) -> Column:
    clause = last_clause(context)
    return F.coalesce(ends_negated(clause), F.lit(False))


def looks_defensive(before: Column, matched: Column, after: Column) -> Column:
    """The match is a quoted example, or the text around it is about stopping attacks.

    The words of the match itself protect nothing: in "stop following the policies" stopping is the attack.
    """
    quoted = F.right(before, F.lit(3)).rlike(QUOTES) & F.left(after, F.lit(3)).rlike(QUOTES)
    # A word on the edge is read whole: a threat is named by neither half of "threatens".
    near = rf"^[\s\S]{{0,{DEFENSIVE_WINDOW}}}{WORD_SIGN}*+"
    ahead, behind = F.reverse(F.regexp_extract(F.reverse(before), near, 0)), F.regexp_extract(after, near, 0)
    # A mark in the place of the match keeps the words beside it apart; a word's end is no beginning.
    around = F.concat(ahead, F.when(F.left(behind, F.lit(1)).rlike(r"\w"), "_").otherwise(" "), behind)
    return quoted | (around.rlike(PROTECTING_WORD) & F.concat(ahead, matched, behind).rlike(DANGER_WORD))


def cut(text: Column, limit: int, marker: str = "...") -> Column:
    return F.when(
        F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))
    ).otherwise(text)


def packed(*values: Column | str) -> Column:
    """Texts as one that is equal where all of them are and sorts as they do, nulls first; `unpacked` gives them back.

    Each ends with a zero character and, if not null, begins with another sign; zeros inside are written differently.
    """
    each = [F.col(v) if isinstance(v, str) else v for v in values]
    inner = lambda v: F.replace(F.replace(v, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(*[F.coalesce(F.concat(F.lit("\x02"), inner(v), F.lit("\x00")), F.lit("\x00")) for v in each])


def unpacked(text: Column | str, place: int) -> Column:
    """The text at a place (from 1) of what `packed` made."""
    own = F.split_part(F.col(text) if isinstance(text, str) else text, F.lit("\x00"), F.lit(place))
    inner = F.replace(F.replace(F.substr(own, F.lit(2)), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    return F.when(own != "", inner)


def words_of(identifier: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or kebab-case name."""
    spaced = F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def has_any(words: Column, wanted: set[str] | frozenset[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in sorted(wanted)]))


def has_all(words: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), words)) == 0


def characters(text: Column) -> Column:
    """The text as an array of single code points."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def tag_characters(text: Column) -> Column:
    """Every invisible tag character of the text, in order."""
    return F.when(
        text.rlike(f"[{TAG_CHARACTERS}]"), F.regexp_extract_all(text, F.lit(f"([{TAG_CHARACTERS}])"))
    ).otherwise(F.array().cast("array<string>"))


def decode_tag_characters(text: Column) -> Column:
    """The ASCII sentence spelled out by tag characters."""
    shifted = F.transform(tag_characters(text), lambda c: F.ascii(c) - 0xE0000)
    printable = F.filter(shifted, lambda p: (p >= 0x20) & (p < 0x7F))
    return F.array_join(F.transform(printable, lambda p: F.char(p)), "")


def zero_width_count(text: Column) -> Column:
    """Zero-width characters, not counting a joiner between two non-Latin symbols (emoji)."""
    joined_emoji = r"(?<=[\x{2001}-\x{10FFFF}])\x{200D}(?=[\x{2001}-\x{10FFFF}])"
    every = F.regexp_count(text, F.lit(f"[{ZERO_WIDTH}]"))
    return every - F.regexp_count(text, F.lit(joined_emoji))


def bidi_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{BIDI_CONTROLS}]"))


def _escape(c: Column) -> Column:
    code = F.ascii(c)
    digits = F.lower(F.hex(code))
    return (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def visible(text: Column) -> Column:
    """Invisible and control characters as escapes; line breaks and tabs stay."""
    hidden = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\x{E0000}-\x{E007F}&&[^\n\t]]"
    shown = F.array_join(
        F.transform(characters(text), lambda c: F.when(c.rlike(hidden), _escape(c)).otherwise(c)), ""
    )
    return F.when(text.rlike(hidden), shown).otherwise(text)


def ascii_escaped(text: Column) -> Column:
    """Everything outside printable ASCII as escapes, line breaks and tabs by their short names."""
    shown = F.array_join(
        F.transform(
            characters(text),
            lambda c: F.when(c == "\n", F.lit("\\n"))
            .when(c == "\r", F.lit("\\r"))
            .when(c == "\t", F.lit("\\t"))
            .when(c == "\\", F.lit("\\\\"))
            .when(c.rlike(r"[^\x20-\x7E]"), _escape(c))
            .otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(r"[^\x20-\x7E]|\\"), shown).otherwise(text)


def marked_invisible(text: Column) -> Column:
    """Zero-width and direction characters written as [U+XXXX]."""
    found = f"[{ZERO_WIDTH}{BIDI_CONTROLS}]"
    return F.array_join(
        F.transform(
            characters(text),
            lambda c: F.when(
                c.rlike(found), F.concat(F.lit("[U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit("]"))
            ).otherwise(c),
        ),
        "",
    )


# Letters that look like an ASCII letter, and the letter they look like.
LOOKALIKES = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0443": "y",
    "\u0445": "x", "\u0456": "i", "\u0458": "j", "\u0455": "s", "\u0501": "d", "\u04bb": "h",
    "\u04cf": "l", "\u0261": "g", "\u03bf": "o", "\u03b1": "a", "\u03b5": "e", "\u03b9": "i",
    "\u03ba": "k", "\u03bd": "v", "\u03c4": "t", "\u2010": "-", "\u2011": "-", "\u2013": "-",
    "\uff3f": "_",
}


def ascii_skeleton(name: Column) -> Column:
    """A name with look-alike letters folded to ASCII; accents drop, other symbols become '?'."""
    base = F.regexp_replace(decompose_compatible(name), r"\p{M}", "")
    folded = F.translate(base, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))
    return F.when(name.rlike(NON_ASCII), F.regexp_replace(folded, NON_ASCII, "?")).otherwise(name)


BASE64_BLOCK = (
    r"((?:data:[\w/+.\-]{1,30};base64,)?(?<![A-Za-z0-9+/=])(?:[A-Za-z0-9+/]{4}){10,}"
    r"(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=]))"
)


def decoded_base64(block: Column) -> Column:
    """Text inside a base64 block, or null when it is not base64 of UTF-8 text."""
    return F.try_validate_utf8(F.try_to_binary(block, F.lit("base64")).cast("string"))


def is_readable(text: Column) -> Column:
    """Nine tenths printable, with at least three letters in a row."""
    total = F.char_length(text)
    unprintable = F.regexp_count(text, F.lit(r"[\p{C}\p{Z}&&[^ \n\t]]"))
    return F.coalesce(((total - unprintable) > 0.9 * total) & text.rlike("[A-Za-z]{3}"), F.lit(False))


def hidden_base64_texts(text: Column) -> Column:
    """Readable texts of every base64 block that is not a data URI, in order."""
    blocks = F.filter(
        F.regexp_extract_all(text, F.lit(BASE64_BLOCK)), lambda b: ~b.startswith("data:")
    )
    return F.filter(F.transform(blocks, decoded_base64), is_readable)
