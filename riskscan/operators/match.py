"""Text matching: every text detector over every surface in one narrow pass.

Each surface row tests all detectors (a cheap literal test first, then the regular
expression) and only rows with a hit are exploded. Details are worked out after that,
on the few rows left, so the pass over the texts has no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan import patterns as P
from riskscan.functions import secrets as S
from riskscan.functions import text as T
from riskscan.operators.names import last_two_servers, other_server
from riskscan.rules.catalog import BY_ID
from riskscan.schemas import NAME_KINDS, evidence


@dataclass(frozen=True)
class Detector:
    """One thing to look for: a phrase pattern under a rule id, or a special test by name."""

    rule_id: str
    where: str  # "metadata", "dynamic" or "all"
    pattern: P.TextPattern | None = None
    special: str = ""


def _detectors() -> tuple[Detector, ...]:
    phrases = [Detector(p.rule_id, "metadata", p) for p in P.METADATA_PATTERNS]
    redirects = [Detector(p.rule_id, "all", p) for p in P.REDIRECT]
    runtime = [Detector("INJ-004", "dynamic", p) for p in P.RUNTIME_PATTERNS]
    return (
        *phrases,
        *redirects,
        *runtime,
        Detector("INJ-002", "metadata", special="hidden"),
        Detector("INJ-003", "metadata", special="encoded"),
        Detector("INJ-005", "metadata", special="control"),
        Detector("POISON-003", "metadata", special="sensitive"),
        Detector("POISON-007", "metadata", special="collector"),
        Detector("SECRET-001", "all", special="secret"),
    )


DETECTORS = _detectors()


def _near_verb(path: str, window: int) -> str:
    """The path pattern, only where an access verb lies within the window on either side."""
    by_length: dict[int, list[str]] = {}
    for verb in P.ACCESS_WORDS:
        by_length.setdefault(len(verb), []).append(verb.replace(" ", r"\s"))
    behind = "|".join(rf"\b(?:{'|'.join(v)})\b[\s\S]{{0,{window - n}}}" for n, v in sorted(by_length.items()))
    ahead = "|".join(rf"[\s\S]{{0,{window - n}}}?\b(?:{'|'.join(v)})\b" for n, v in sorted(by_length.items()))
    body = path.removeprefix("(?i)")
    return rf"(?i)(?=(?:{body}))(?:(?<={behind})(?:{body})|(?:{body})(?={ahead}))"


SENSITIVE_NEAR_VERB = _near_verb(P.SENSITIVE_PATH, P.SENSITIVE_WINDOW)


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def contains_any(low: str, anchors: tuple[str, ...]) -> Column:
    """Does the column named `low` hold one of the literals?"""
    return F.expr(" or ".join(f"contains({low}, {sql_text(a)})" for a in anchors))


def pattern_hits(norm: str, low: str, pattern: P.TextPattern) -> Column:
    """The literal test, then the regular expression."""
    return contains_any(low, pattern.anchors) & F.col(norm).rlike(pattern.regex)


def literals_of(detectors: tuple[Detector, ...]) -> dict[str, str]:
    """Every distinct literal of the phrase detectors, with the column that holds its test."""
    patterns = [d.pattern for d in detectors if d.pattern is not None]
    if any(d.special == "collector" for d in detectors):
        patterns += P.SEND_OUT
    return {a: f"_has{i}" for i, a in enumerate(sorted({a for p in patterns for a in p.anchors}))}


def _tested(pattern: P.TextPattern, literals: dict[str, str]) -> Column:
    """The same as `pattern_hits` where the literals were tested once per row."""
    return F.expr(" or ".join(literals[a] for a in pattern.anchors)) & F.col("norm").rlike(pattern.regex)


def _special_test(d: Detector, literals: dict[str, str]) -> Column:
    raw, norm = F.col("text"), F.col("norm")
    if d.special == "hidden":
        # Anything invisible except a joiner that only ties emoji together.
        return raw.rlike(T.INVISIBLE) & (
            raw.rlike(f"[{T.TAG_CHARACTERS}{T.BIDI_CONTROLS}]") | (T.zero_width_count(raw) > 0)
        )
    if d.special == "encoded":
        return raw.rlike("[A-Za-z0-9+/]{40}") & (F.size(T.hidden_base64_texts(raw)) > 0)
    if d.special == "control":
        return raw.rlike(P.CONTROL_CHARACTERS)
    if d.special == "sensitive":
        return contains_any("low", P.SENSITIVE_ANCHORS) & norm.rlike(SENSITIVE_NEAR_VERB)
    if d.special == "collector":
        already = F.lit(False)
        for p in P.SEND_OUT:
            already = already | (~F.col("kind").isin(*NAME_KINDS) & _tested(p, literals))
        return contains_any("low", P.COLLECTOR_ANCHORS) & norm.rlike(P.COLLECTOR_DOMAIN) & ~already
    return S.has_secret(raw)


def _test(d: Detector, literals: dict[str, str]) -> Column:
    scope = {"metadata": ~F.col("is_dynamic"), "dynamic": F.col("is_dynamic"), "all": F.lit(True)}[d.where]
    if d.pattern is not None:
        return scope & ~F.col("kind").isin(*NAME_KINDS) & _tested(d.pattern, literals)
    if d.special == "sensitive":
        scope = scope & ~F.col("kind").isin(*NAME_KINDS)
    return scope & _special_test(d, literals)


def detect(surfaces: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """One row per surface and detector that fired: the surface columns, `norm` and `det`."""
    scan = surfaces.where(F.col("text") != "").withColumn("norm", T.normalize(F.col("text")))
    scan = scan.withColumn("low", F.lower("norm"))
    literals = literals_of(detectors)
    scan = scan.withColumns({column: F.contains("low", F.lit(a)) for a, column in literals.items()}) if literals else scan
    fired = F.array_remove(F.array(*[F.when(_test(d, literals), F.lit(i)).otherwise(-1) for i, d in enumerate(detectors)]), -1)
    # The outer form keeps the optimiser from testing all detectors a second time in a filter
    # on the size of the array; rows without a hit leave right after.
    return scan.withColumn("det", F.explode_outer(fired)).where(F.col("det").isNotNull()).drop("low", *literals.values())


def _split_pattern(d: Detector) -> str | None:
    if d.pattern is not None:
        return d.pattern.regex
    return {
        "sensitive": SENSITIVE_NEAR_VERB,
        "collector": P.COLLECTOR_DOMAIN,
        "control": P.CONTROL_CHARACTERS,
    }.get(d.special)


def _fixed(detectors: tuple[Detector, ...], value) -> Column:
    """A fixed value per detector, looked up by its number; null where `value` gives None."""
    literals = [value(d) for d in detectors]
    texts = ", ".join(
        "null" if v is None else sql_text(v) if isinstance(v, str) else str(v).lower() for v in literals
    )
    return F.expr(f"element_at(array({texts}), det + 1)")


def _split(detectors: tuple[Detector, ...]) -> Column:
    """The text split at the first match of the detector's pattern."""
    branches = []
    for i, d in enumerate(detectors):
        regex = _split_pattern(d)
        if regex:
            column = "text" if d.special == "control" else "norm"
            branches.append(f"when {i} then split({column}, {sql_text(regex)}, 2)")
    return F.expr(f"case det {' '.join(branches)} end") if branches else F.lit(None).cast("array<string>")


def _hidden(text: Column) -> Column:
    return F.struct(
        F.size(T.tag_characters(text)).alias("tags"),
        T.decode_tag_characters(text).alias("message"),
        T.zero_width_count(text).alias("zero"),
        T.bidi_count(text).alias("bidi"),
    )


def _hidden_fields() -> dict[str, Column]:
    tags, message, zero, bidi = (F.col(f"hid.{n}") for n in ("tags", "message", "zero", "bidi"))
    long_message = F.char_length(F.btrim(message)) >= 8
    kinds = F.array_join(
        F.array_compact(
            F.array(
                F.when(zero > 0, F.concat(zero.cast("string"), F.lit(" of no width"))),
                F.when(bidi > 0, F.concat(bidi.cast("string"), F.lit(" that turn the direction of text"))),
            )
        ),
        " and ",
    )
    return {
        "severity": F.when(tags == 0, "medium").when(long_message, "critical").otherwise("high"),
        "confidence": F.when(tags > 0, "high").otherwise("medium"),
        "malicious": (tags > 0) & long_message,
        "what": F.when(tags > 0, F.concat(F.lit("carries "), tags.cast("string"), F.lit(" tag characters that nobody sees.")))
        .otherwise(F.concat(F.lit("carries characters that nobody sees: "), kinds, F.lit("."))),
        "shown": F.when(tags > 0, F.when(message == "", F.lit("(spells nothing)")).otherwise(message))
        .otherwise(T.marked_invisible(F.col("text"))),
        "detail": F.when(tags > 0, "what the tag characters spell").otherwise("unseen characters by their code points"),
    }


def _first_pattern(norm: str, low: str) -> Column:
    """Index in RUNTIME_PATTERNS of the first pattern found, or null."""
    return F.coalesce(*[F.when(pattern_hits(norm, low, p), F.lit(i)) for i, p in enumerate(P.RUNTIME_PATTERNS)])


def _by_pattern(index: str, attribute: str) -> Column:
    values = [getattr(p, attribute) for p in P.RUNTIME_PATTERNS]
    texts = ", ".join(sql_text(v) if isinstance(v, str) else str(v).lower() for v in values)
    return F.expr(f"element_at(array({texts}), {index} + 1)")


def surface_hits(surfaces: DataFrame, detectors: tuple[Detector, ...] = DETECTORS) -> DataFrame:
    """Candidates of every text rule, plus `ref_name` for orders about another tool.

    Extra columns of `surfaces` are dropped; `ref_name` is input for `resolve_tool_references`.
    """
    hits = detect(surfaces, detectors).withColumn("special", _fixed(detectors, lambda d: d.special))
    special = F.col("special")
    hits = hits.select(
        "server_id", "seq", "kind", "target_kind", "target_name", "location", "text", "norm", "det", "special",
        _split(detectors).alias("parts"),
        F.when(special == "hidden", _hidden(F.col("text"))).alias("hid"),
        F.when(special == "encoded", F.get(T.hidden_base64_texts(F.col("text")), F.lit(0))).alias("decoded"),
        F.when(special == "secret", S.find_secrets(F.col("text"))).alias("found"),
    )
    subject = F.when(special == "control", F.col("text")).otherwise(F.col("norm"))
    hits = hits.select(
        *[c for c in hits.columns if c not in ("norm", "parts")],
        F.get("parts", F.lit(0)).alias("before"),
        T.matched_text(subject, F.get("parts", F.lit(0)), F.get("parts", F.lit(1))).alias("matched"),
        F.get("parts", F.lit(1)).alias("after"),
        T.normalize(F.col("decoded")).alias("decoded_norm"),
    )
    before, matched, after = F.col("before"), F.col("matched"), F.col("after")
    hits = hits.select(
        "*",
        F.coalesce(T.looks_defensive(before, matched, after), F.lit(False)).alias("defensive"),
        F.lower("decoded_norm").alias("decoded_low"),
        T.excerpt(before, matched, after).alias("around"),
    )
    hits = hits.select("*", F.when(special == "encoded", _first_pattern("decoded_norm", "decoded_low")).alias("bad"))

    hidden, defensive, bad, around, loc = _hidden_fields(), F.col("defensive"), F.col("bad"), F.col("around"), F.col("location")
    escape = F.contains(F.col("text"), F.lit("\x1b"))
    the = lambda rest: F.concat(F.lit("The "), F.replace(F.col("kind"), F.lit("-"), F.lit(" ")), F.lit(" "), rest)
    is_ = lambda name: special == name

    severity = (
        F.when(is_("hidden"), hidden["severity"])
        .when(is_("encoded"), F.when(bad.isNull(), "medium").when(_by_pattern("bad", "malicious"), "critical").otherwise("high"))
        .when(is_("control"), F.when(escape, "high").otherwise("medium"))
        .otherwise(_fixed(detectors, lambda d: d.pattern.severity if d.pattern else "high"))
    )
    confidence = (
        F.when(is_("hidden"), hidden["confidence"])
        .when(is_("encoded"), F.when(bad.isNull(), "low").otherwise("high"))
        .when(is_("control") | is_("secret"), "high")
        .when(defensive, "low")
        .otherwise(_fixed(detectors, lambda d: d.pattern.confidence if d.pattern else "medium"))
    )
    # Steering or sending data is shown as a risk; only clear attacks count as malicious.
    malicious = (
        F.when(is_("hidden"), hidden["malicious"])
        .when(is_("encoded") & bad.isNull(), F.lit(False))
        .when(is_("encoded"), _by_pattern("bad", "malicious"))
        .when(defensive, F.lit(False))
        .otherwise(_fixed(detectors, lambda d: d.pattern.malicious if d.pattern else d.special == "collector"))
    )
    description = (
        F.when(is_("hidden"), the(hidden["what"]))
        .when(
            is_("encoded"),
            F.when(bad.isNull(), "A base64 block holds plain text.").otherwise(
                F.concat(F.lit("A base64 block holds text that "), _by_pattern("bad", "label"), F.lit("."))
            ),
        )
        .when(is_("control"), the(F.when(escape, "steers the terminal.").otherwise("holds control codes.")))
        .when(is_("sensitive"), the(F.concat(F.lit("turns to '"), matched, F.lit("', where credentials are kept."))))
        .when(is_("collector"), the(F.concat(F.lit("names the catcher of requests '"), matched, F.lit("'."))))
        .when(is_("secret"), the(F.concat(F.lit("gives away a secret ("), F.col("found")[0]["kind"], F.lit(")."))))
        .when(F.col("rule_id") == "INJ-004", F.concat(F.lit("A reply "), F.col("label"), F.lit(".")))
        .otherwise(the(F.concat("label", F.lit("."))))
    )
    proof = (
        F.when(is_("hidden"), F.array(evidence("hidden-text", loc, hidden["shown"], hidden["detail"])))
        .when(is_("encoded"), F.array(evidence("encoded-text", loc, F.left("decoded", F.lit(300)), "decoded base64")))
        .when(is_("control"), F.array(evidence("hidden-text", loc, T.ascii_escaped(around), "control characters shown escaped")))
        .when(is_("sensitive"), F.array(evidence("text-match", loc, around, "a place of credentials")))
        .when(is_("collector"), F.array(evidence("text-match", loc, around, "a catcher of requests")))
        .when(
            is_("secret"),
            F.transform("found", lambda s: evidence("text-match", loc, S.mask(s["value"]), s["kind"])),
        )
        .otherwise(F.array(evidence("text-match", loc, around, F.col("label"))))
    )
    keeps_context = (special == "") | special.isin("sensitive", "collector")
    orders = F.concat(matched, F.left(after, F.lit(5)))
    ref = F.coalesce(
        F.nullif(F.regexp_extract(orders, P.OTHER_TOOL_NAME, 1), F.lit("")), F.regexp_extract(orders, P.OTHER_TOOL_NAME, 2)
    )
    hits = hits.select(
        "*",
        _fixed(detectors, lambda d: d.rule_id).alias("rule_id"),
        _fixed(detectors, lambda d: d.pattern.label if d.pattern else None).alias("label"),
    )
    return hits.select(
        "server_id", "seq", "rule_id",
        _fixed(detectors, lambda d: BY_ID[d.rule_id].title).alias("title"),
        severity.alias("severity"),
        confidence.alias("confidence"),
        _fixed(detectors, lambda d: BY_ID[d.rule_id].category).alias("category"),
        description.alias("description"),
        proof.alias("evidence"),
        "target_kind", "target_name",
        F.lit(False).alias("confirmed"),
        malicious.alias("malicious"),
        F.when(keeps_context, F.right(before, F.lit(T.PAD))).alias("context_text"),
        F.when(F.col("rule_id") == "SHADOW-001", ref).alias("ref_name"),
    )


def resolve_tool_references(hits: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Judge orders about another tool by who owns that tool.

    Rows without a reference get a join key of their own, so they spread evenly instead of
    meeting on a null key.
    """
    is_ref = F.col("ref_name").isNotNull()
    hits = hits.where(~is_ref | ~F.lower("ref_name").isin(*P.SELF_REFERENCES))
    if tools is None:
        joined = hits.withColumn("own", F.lit(False)).withColumn("peer", F.lit(None).cast("string"))
    else:
        spread = F.concat(F.lit("\x00"), F.xxhash64("server_id", "rule_id", "target_name", "seq").cast("string"))
        keyed = hits.withColumn("ref_key", F.coalesce("ref_name", spread))
        own = tools.select("server_id", F.col("name").alias("ref_key"), F.lit(True).alias("own")).distinct()
        peers = last_two_servers(tools).withColumnRenamed("name", "ref_key")
        joined = (
            keyed.join(own, ["server_id", "ref_key"], "left")
            .join(peers, "ref_key", "left")
            .withColumn("own", F.coalesce("own", F.lit(False)))
            .withColumn("peer", other_server(F.col("server_id")))
        )
    name = F.when(F.col("ref_name") == "", F.lit("another tool")).otherwise(F.col("ref_name"))
    whose = (
        F.when(F.col("own"), F.lit("', its own neighbour."))
        .when(F.col("peer").isNotNull(), F.concat(F.lit("', which belongs to '"), F.col("peer"), F.lit("'.")))
        .otherwise(F.lit("', unknown here."))
    )
    note = F.concat(F.lit(" It speaks of '"), name, whose)
    known_peer = is_ref & F.col("peer").isNotNull()
    return joined.select(
        "server_id", "seq", "rule_id", "title",
        F.when(is_ref & F.col("own"), "low").otherwise(F.col("severity")).alias("severity"),
        F.when(is_ref & F.col("own"), "low").when(known_peer, "high").otherwise(F.col("confidence")).alias("confidence"),
        "category",
        F.when(is_ref, F.concat("description", note)).otherwise(F.col("description")).alias("description"),
        "evidence", "target_kind", "target_name", "confirmed",
        (F.col("malicious") & ~is_ref).alias("malicious"), "context_text",
    )


def text_candidates(surfaces: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Candidates of all text rules over all surfaces."""
    return resolve_tool_references(surface_hits(surfaces), tools)
