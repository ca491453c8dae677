"""Small builders for the inline fixtures."""

from __future__ import annotations

from riskscan.schemas import CANDIDATE_SCHEMA, SURFACE_SCHEMA


def surfaces(spark, *rows):
    """Each row: text, or (text, overrides)."""
    out = []
    for i, row in enumerate(rows):
        text, extra = row if isinstance(row, tuple) else (row, {})
        base = dict(
            server_id="s", seq=i, kind="tool-description", target_kind="tool", target_name=f"t{i}",
            location=f"tool t{i} > description", text=text, is_dynamic=False,
        )
        base.update(extra)
        out.append(tuple(base[f.name] for f in SURFACE_SCHEMA.fields))
    return spark.createDataFrame(out, SURFACE_SCHEMA)


def candidate(rule="TEST-001", severity="high", confidence="high", kind="text-match", location="tool t > description", **extra):
    base = dict(
        server_id="s", seq=0, rule_id=rule, title="Test", severity=severity, confidence=confidence,
        category="quality", description="Something was found.", evidence=[(kind, location, "snippet", "")],
        target_kind="tool", target_name="t", confirmed=False, malicious=False, context_text=None,
    )
    base.update(extra)
    return tuple(base[f.name] for f in CANDIDATE_SCHEMA.fields)


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), CANDIDATE_SCHEMA)
