"""How rules emit candidates.

A rule over one table is a Column: an array of candidate bodies, empty where the rule does
not fire. All rules of a table are concatenated and exploded in one pass over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.rules.catalog import BY_ID
from riskscan.schemas import CANDIDATE_SCHEMA, conform

BODY_TYPE = (
    "array<struct<rule_id:string,severity:string,confidence:string,description:string,"
    "evidence:array<struct<kind:string,location:string,snippet:string,detail:string>>,target_kind:string,"
    "target_name:string,confirmed:boolean,malicious:boolean,context_text:string>>"
)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text(*parts) -> Column:
    """Concatenation of strings and columns; a null part counts as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def body(
    rule_id: str,
    target_kind,
    target_name: Column,
    description,
    evidence: Column,
    severity=None,
    confidence="medium",
    confirmed=False,
    malicious=False,
    context=None,
) -> Column:
    """One candidate body. The severity defaults to that of the rule."""
    fields = {
        "rule_id": rule_id,
        "severity": BY_ID[rule_id].severity if severity is None else severity,
        "confidence": confidence,
        "description": description,
        "evidence": evidence,
        "target_kind": target_kind,
        "target_name": target_name,
        "confirmed": confirmed,
        "malicious": malicious,
        "context_text": context,
    }
    pairs = [x for name, value in fields.items() for x in (F.lit(name), as_column(value))]
    return F.named_struct(*pairs)


def fires(condition: Column, candidate: Column) -> Column:
    """An array with the candidate where the condition holds."""
    return F.when(condition, F.array(candidate).cast(BODY_TYPE))


def emit(df: DataFrame, rules: Sequence[Column], seq: str = "seq") -> DataFrame:
    """Candidates of all the rules for every row of `df`."""
    none = F.array().cast(BODY_TYPE)
    every = F.concat(*[F.coalesce(r.cast(BODY_TYPE), none) for r in rules])
    rows = df.select("server_id", F.col(seq).cast("long").alias("seq"), F.explode(every).alias("b"))
    return finish(rows.select("server_id", "seq", "b.*"))


def finish(rows: DataFrame) -> DataFrame:
    """Adds title and category from the catalog and puts the columns in order."""
    pick = lambda attr: F.element_at(
        F.create_map(*[F.lit(x) for r in BY_ID.values() for x in (r.rule_id, getattr(r, attr))]), F.col("rule_id")
    )
    return conform(rows.withColumn("title", pick("title")).withColumn("category", pick("category")), CANDIDATE_SCHEMA)

