"""Column layouts shared by the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE_DDL = "array<struct<kind:string,location:string,snippet:string,detail:string>>"
SNIPPET_LIMIT = 400
MAX_EVIDENCE = 5

# The kinds of text a client reads from a server.
SURFACE_KINDS = (
    "instructions", "tool-name", "tool-title", "tool-description", "tool-annotation", "param-name",
    "param-description", "param-value", "prompt-description", "prompt-argument", "prompt-text",
    "resource-description", "resource-text", "tool-output",
)
NAME_KINDS = ("tool-name", "param-name")

# Categories of findings.
CATEGORIES = (
    "prompt-injection", "tool-poisoning", "tool-shadowing", "command-execution", "code-execution",
    "filesystem", "network", "data-exfiltration", "injection", "secrets", "privilege",
    "excessive-permissions", "supply-chain", "configuration", "authentication", "runtime-behavior",
    "protocol", "quality",
)

STRING, LONG, INT, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
EVIDENCE_TYPE = T.ArrayType(
    T.StructType([T.StructField(n, STRING) for n in ("kind", "location", "snippet", "detail")])
)


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SURFACE_SCHEMA = table(
    server_id=STRING, seq=LONG, kind=STRING, target_kind=STRING, target_name=STRING, location=STRING, text=STRING,
    is_dynamic=BOOL,
)
CANDIDATE_SCHEMA = table(
    server_id=STRING, seq=LONG, rule_id=STRING, title=STRING, severity=STRING, confidence=STRING, category=STRING,
    description=STRING, evidence=EVIDENCE_TYPE, target_kind=STRING, target_name=STRING, confirmed=BOOL,
    malicious=BOOL, context_text=STRING,
)
CANDIDATE_COLUMNS = tuple(f.name for f in CANDIDATE_SCHEMA.fields)
DEPENDENCY_SCHEMA = table(
    server_id=STRING, name=STRING, ecosystem=STRING, source=STRING, spec=STRING, version=STRING, direct=BOOL, line=INT
)
STRING_MAP = T.MapType(STRING, STRING)
SERVER_SCHEMA = table(
    server_id=STRING, seq=LONG, name=STRING, transport=STRING, command=STRING, args=T.ArrayType(STRING), env=STRING_MAP, headers=STRING_MAP,
    url=STRING, origin=STRING, origin_kind=STRING, instructions=STRING, connected=BOOL, protocol_version=STRING, repo_url=STRING,
)
INSTALL_SCRIPT_SCHEMA = table(server_id=STRING, file=STRING, hook=STRING, command=STRING)
CODE_HIT_SCHEMA = table(
    server_id=STRING, seq=LONG, category=STRING, file=STRING, line=INT, snippet=STRING, language=STRING,
    function=STRING, tool=STRING, tainted=BOOL, tainted_params=T.ArrayType(STRING), detail=STRING, sanitized=BOOL,
    note=STRING,
)


def snippet(text: Column) -> Column:
    """Evidence text, cut with a marker when it is long."""
    return F.when(
        F.char_length(text) > SNIPPET_LIMIT, F.concat(F.left(text, F.lit(SNIPPET_LIMIT)), F.lit("..."))
    ).otherwise(F.coalesce(text, F.lit("")))


def evidence(kind: str | Column, location: Column, text: Column, detail: str | Column = "") -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        as_col(kind).alias("kind"),
        location.alias("location"),
        snippet(text).alias("snippet"),
        as_col(detail).alias("detail"),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of a schema in order; missing ones become null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
