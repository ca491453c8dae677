"""Stable ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finding_id(server: Column, rule: Column, kind: Column, target: Column, location: Column) -> Column:
    """Ten hex digits that stay the same from scan to scan."""
    text = F.concat_ws("|", server, rule, kind, target, F.coalesce(location, F.lit("")))
    return F.concat(F.lit("F-"), F.left(F.sha2(text, 256), F.lit(10)))


def definition_hash(*parts: Column) -> Column:
    """Hash of a definition. Each part is text, or JSON text whose keys are already sorted."""
    body = F.to_json(F.struct(*[F.coalesce(p, F.lit("")).alias(f"p{i}") for i, p in enumerate(parts)]))
    return F.concat(F.lit("sha256:"), F.left(F.sha2(body, 256), F.lit(32)))


def canonical_json(variant: Column) -> Column:
    """JSON text of a VARIANT; its object keys come out sorted."""
    return F.when(variant.isNotNull(), F.to_json(variant))
