"""Review by an outside scorer: payloads out, verdicts in.

A verdict is a note. It never changes severity, status or points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskscan.functions.secrets import redact
from riskscan.operators.skew import split_running, written
from riskscan.sources import catalog as C
from riskscan.sources import jsontext as J

#: Entries of a server up to which they are packed in one place.
STRETCH = 10_000
VERDICTS = ("likely-real", "likely-false-positive", "unsure")


def clean(text: Column, limit: int, planted: Column | None = None) -> Column:
    """Text without secrets and planted values, cut with a note on how much is missing."""
    out = redact(text)
    if planted is not None:
        out = F.aggregate(
            F.filter(planted, lambda v: v != ""), out, lambda acc, v: F.replace(acc, v, F.lit("[REDACTED planted value]"))
        )
    rest = F.char_length(out) - limit
    return F.when(
        rest > 0, F.concat(F.left(out, F.lit(limit)), F.lit("...(cut, "), rest.cast("string"), F.lit(" more characters)"))
    ).otherwise(out)


def fenced(text: Column, token: str) -> Column:
    """Untrusted text between markers that carry a random token; copies of the token are removed."""
    safe = F.replace(text, F.lit(token), F.lit("[token]"))
    return F.concat(F.lit(f"<<<UNTRUSTED_DATA_{token}>>>\n"), safe, F.lit(f"\n<<<END_UNTRUSTED_DATA_{token}>>>"))


def parse_answer(text: Column) -> Column:
    """The JSON object inside an answer as VARIANT, or null."""
    parsed = F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    return F.when(J.is_object(parsed), parsed)


def entries(tools: DataFrame, findings: DataFrame, limit: int, instructions: DataFrame | None = None, planted: DataFrame | None = None) -> DataFrame:
    """What payloads are made of: (server_id, kind, rank, key, piece, pieces, entry), each entry valid JSON of at most `limit` characters.

    Instructions, findings (worst first) and tools, without secrets and planted values, which are
    taken out of the texts before they become JSON. An entry that would be longer comes in
    numbered pieces: each holds a part of its JSON as text, and all parts together are the whole.
    `planted(server_id, value)` is joined as one short list per server.
    """
    mask = lambda c: redact(F.coalesce(c, F.lit("")))
    params = F.transform(
        C.parameter_array(F.col("input_schema")),
        lambda p: F.struct(
            p["name"].alias("key"),
            mask(F.coalesce(J.text_at(p["schema"], "$.description"), J.any_text_at(p["schema"], "$.type"), F.lit(""))).alias("value"),
        ),
    )
    tool = F.struct(F.lit("tool").alias("kind"), mask(F.col("name")).alias("name"), "seq", mask(F.col("description")).alias("description"), F.map_from_entries(F.array_distinct(params)).alias("parameters"))
    proof = F.transform("evidence", lambda e: F.concat(mask(e["location"]), F.lit(": "), mask(e["snippet"])))
    finding = F.struct(
        F.lit("finding").alias("kind"), "id", F.col("rule_id").alias("rule"), mask(F.col("title")).alias("title"), "severity", "confidence",
        F.concat_ws(" ", "target_kind", mask(F.col("target_name"))).alias("target"), mask(F.col("description")).alias("description"), proof.alias("evidence"),
    )
    rows = findings.select("server_id", F.lit(1).alias("kind"), (-F.col("sev_rank")).cast("bigint").alias("rank"), F.concat_ws("\x01", "rule_id", "id").alias("key"), F.to_json(finding).alias("json"))
    rows = rows.unionByName(tools.select("server_id", F.lit(2).alias("kind"), F.col("seq").cast("bigint").alias("rank"), F.coalesce("name", F.lit("")).alias("key"), F.to_json(tool).alias("json")))
    if instructions is not None:
        said = F.struct(F.lit("instructions").alias("kind"), mask(F.col("instructions")).alias("text"))
        rows = rows.unionByName(instructions.select("server_id", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("rank"), F.lit("").alias("key"), F.to_json(said).alias("json")))
    if planted is not None:
        values = planted.where(F.col("value") != "").groupBy("server_id").agg(F.collect_set("value").alias("_planted"))
        rows = rows.join(values, "server_id", "left")
        # Inside JSON a value stands as JSON writes it.
        inner = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
        rows = rows.withColumn("json", F.coalesce(F.aggregate("_planted", F.col("json"), lambda acc, v: F.replace(acc, inner(v), F.lit("[REDACTED planted value]"))), F.col("json"))).drop("_planted")
    # A piece is text in JSON: a quote or backslash takes two signs.
    size = max(1, (limit - 120) // 2)
    count = F.when(F.char_length("json") <= limit, 1).otherwise(F.ceil(F.char_length("json") / size)).cast("int")
    rows = rows.withColumn("pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    part = F.to_json(F.struct(F.lit("piece").alias("kind"), "piece", "pieces", F.substr("json", (F.col("piece") - 1) * size + 1, F.lit(size)).alias("text")))
    return rows.select("server_id", "kind", "rank", "key", "piece", "pieces", F.when(F.col("pieces") == 1, F.col("json")).otherwise(part).alias("entry"))


def payloads(
    tools: DataFrame, findings: DataFrame, token: str, limit: int = 60_000, instructions: DataFrame | None = None, planted: DataFrame | None = None
) -> DataFrame:
    """Texts of bounded size for the scorer: (server_id, part, payload). Nothing is left out or cut.

    A payload is a JSON object with a list of entries, between markers. Entries are at most half of
    `limit` long and packed in order: a part is full when the running size of its server's entries
    passes the next half of `limit`. Where a server has more than STRETCH entries, running sizes are
    worked out in stretches of them with carried sums, so it is not one task; those of other servers are
    summed where they are packed, and move once. Entries are read for both, so these are written first:
    findings are merged and made JSON once.
    """
    half = (limit - 200) // 2
    rows = written(entries(tools, findings, half - 1, instructions, planted).withColumn("_size", F.char_length("entry") + 1), "zstd")
    rows = rows.where(F.col("server_id").isNotNull())
    # At most one in STRETCH of the entries.
    large = F.broadcast(rows.groupBy("server_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > STRETCH).select("server_id"))
    order = [F.col(c) for c in ("kind", "rank", "key", "piece")]
    # Stretches follow that order: findings by rank, rule and the first signs of their id, others by thousands of ranks.
    is_finding = F.col("kind") == 1
    stretch = F.struct(
        "kind", F.when(is_finding, F.col("rank")).otherwise(F.floor(F.col("rank") / 1000)).alias("r"), F.when(is_finding, F.left("key", F.instr("key", "\x01") + 4)).otherwise("").alias("k")
    )
    many = split_running(rows.join(large, "server_id", "left_semi"), "server_id", order, stretch, {"_upto": F.col("_size")})
    before = F.sum("_size").over(W.partitionBy("server_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    few = rows.join(large, "server_id", "left_anti").withColumn("_upto", before)

    def pack(some: DataFrame) -> DataFrame:
        part = F.floor((F.col("_upto") - F.col("_size")) / half).cast("int")
        return some.withColumn("part", part).groupBy("server_id", "part").agg(F.sort_array(F.collect_list(F.struct("kind", "rank", "key", "piece", "entry"))).alias("e"))

    lists = pack(few).unionByName(pack(many))
    head = F.regexp_replace(F.to_json(F.struct("server_id", "part")), r"\}$", "")
    text = F.concat(head, F.lit(',"entries":['), F.array_join(F.transform("e", lambda e: e["entry"]), ","), F.lit("]}"))
    return lists.select("server_id", "part", fenced(text, token).alias("payload"))


ANSWER_SCHEMA = (
    "server_id string, part int, answer string, input_tokens bigint, output_tokens bigint, cost_usd double, error string"
)


def ask(payload_rows: DataFrame, scorer: Callable[[str], dict], max_calls: int | None = None) -> DataFrame:
    """Call `scorer(payload)` for every row and keep failures as text in `error`: one answer per part of a server.

    The scorer returns a dict with `text` and optionally token counts and cost. `max_calls`
    is the call budget of a run: parts beyond it, by server and part, come back with an error and
    no call is made.
    """
    rows = payload_rows if "part" in payload_rows.columns else payload_rows.withColumn("part", F.lit(0))
    if max_calls is not None:
        allowed = rows.select("server_id", "part").orderBy("server_id", "part").limit(max_calls).withColumn("_allowed", F.lit(True))
        rows = rows.join(allowed, ["server_id", "part"], "left").withColumn("_allowed", F.coalesce("_allowed", F.lit(False)))
    else:
        rows = rows.withColumn("_allowed", F.lit(True))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for server, part, payload, allowed in batch.itertuples(index=False):
                if not allowed:
                    out.append((server, part, None, 0, 0, None, "call budget used up"))
                    continue
                try:
                    a = scorer(payload)
                    out.append((server, part, a["text"], a.get("input_tokens", 0), a.get("output_tokens", 0), a.get("cost_usd"), None))
                except Exception as exc:  # a scorer must never stop the job
                    out.append((server, part, None, 0, 0, None, f"{type(exc).__name__}: {exc}"[:300]))
            yield pd.DataFrame(
                out, columns=["server_id", "part", "answer", "input_tokens", "output_tokens", "cost_usd", "error"]
            ).astype({"cost_usd": "float64"})

    return rows.select("server_id", "part", "payload", "_allowed").mapInPandas(call, ANSWER_SCHEMA)


def verdicts(answers: DataFrame) -> DataFrame:
    """Verdicts on findings from answers: (server_id, finding_id, verdict, explanation). Unknown words drop."""
    items = J.items_at(parse_answer(F.col("answer")), "$.findings")
    rows = answers.select("server_id", F.explode(items).alias("i"))
    verdict = F.lower(F.coalesce(J.any_text_at(F.col("i"), "$.verdict"), F.lit("unsure")))
    return rows.select(
        "server_id", J.any_text_at(F.col("i"), "$.id").alias("finding_id"), verdict.alias("verdict"),
        F.left(F.coalesce(J.any_text_at(F.col("i"), "$.explanation"), F.lit("")), F.lit(1000)).alias("explanation"),
    ).where(F.col("verdict").isin(*VERDICTS))


def observations(answers: DataFrame) -> DataFrame:
    """Further remarks in answers."""
    items = J.items_at(parse_answer(F.col("answer")), "$.observations")
    rows = answers.select("server_id", F.explode(items).alias("i"))
    t = lambda key, n: F.left(F.coalesce(J.any_text_at(F.col("i"), f"$.{key}"), F.lit("")), F.lit(n))
    severity = F.lower(t("suggested_severity", 20))
    return rows.select(
        "server_id", F.coalesce(F.nullif(t("target", 200), F.lit("")), F.lit("server")).alias("target"), t("title", 200).alias("title"),
        t("description", 1000).alias("description"),
        F.when(severity.isin("info", "low", "medium", "high", "critical"), severity).otherwise("low").alias("suggested_severity"),
    ).where(F.col("title") != "")


def attach(findings: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """Findings with the verdict given to their id; nothing else about them changes."""
    one = verdict_rows.where(F.col("verdict").isin(*VERDICTS)).groupBy("server_id", F.col("finding_id").alias("id")).agg(
        F.max(F.struct("verdict", "explanation")).alias("review")
    )
    return findings.join(one, ["server_id", "id"], "left")
