"""Surfaces: one row for every text an agent reads from a server."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.schemas import SURFACE_SCHEMA, conform
from riskscan.sources import catalog as C
from riskscan.sources import jsontext as J

# Down to this depth every text is given its exact place; below it, texts carry the place of the node they lie under.
PLACED_DEPTH = 6
# Words of the schema language, which are no texts when they are keys.
SCHEMA_WORDS = (
    "$defs", "$id", "$ref", "$schema", "additionalProperties", "allOf", "anyOf", "const", "default", "definitions", "description", "enum", "examples",
    "exclusiveMaximum", "exclusiveMinimum", "format", "items", "maxItems", "maxLength", "maximum", "minItems", "minLength", "minimum", "not", "oneOf",
    "pattern", "prefixItems", "properties", "required", "title", "type", "uniqueItems",
)
CHILD_KEYS = ("items", "additionalProperties", "not")
LIST_KEYS = ("anyOf", "oneOf", "allOf", "prefixItems")
DEFINITION_KEYS = ("$defs", "definitions")
VALUE_KEYS = ("default", "const", "examples", "enum")

NO_NODES = "array<struct<path:string,schema:variant>>"
NO_TEXTS = "array<struct<kind:string,place:string,text:string>>"


def _node(path: Column, schema: Column) -> Column:
    return F.struct(path.alias("path"), schema.alias("schema"))


def _text(kind: str, place: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), place.alias("place"), text.alias("text"))


def _children(node: Column) -> Column:
    """Sub-schemas of one schema node."""
    schema, path = node["schema"], node["path"]
    found = [F.transform(J.members_at(schema, "$.properties"), lambda m: _node(F.concat(F.lit("param "), m["key"]), m["value"]))]
    found.append(
        F.array(
            *[
                _node(F.concat(path, F.lit(f" > {key}")), F.try_variant_get(schema, f"$.{key}", "variant"))
                for key in CHILD_KEYS
            ]
        )
    )
    for key in LIST_KEYS:
        found.append(_listed(schema, path, key))
    for key in DEFINITION_KEYS:
        found.append(_defined(schema, key))
    return F.filter(F.concat(*found), lambda n: J.is_object(n["schema"]))


def _listed(schema: Column, path: Column, key: str) -> Column:
    return F.transform(
        J.items_at(schema, f"$.{key}"),
        lambda s, i: _node(F.concat(path, F.lit(f" > {key}["), i.cast("string"), F.lit("]")), s),
    )


def _defined(schema: Column, key: str) -> Column:
    return F.transform(
        J.members_at(schema, f"$['{key}']"), lambda m: _node(F.concat(F.lit(f"{key} "), m["key"]), m["value"])
    )


def _values(schema: Column, key: str) -> Column:
    """The string under a key, or the strings among the values of a list."""
    single = J.text_at(schema, f"$.{key}")
    many = F.transform(J.items_at(schema, f"$.{key}"), lambda v: J.text_at(v, "$"))
    texts = F.when(single.isNotNull(), F.array(single)).otherwise(many)
    return F.filter(texts, lambda t: F.coalesce(t != "", F.lit(False)))


def _node_texts(node: Column) -> Column:
    """Texts that one schema node holds itself."""
    schema, path = node["schema"], node["path"]
    own = [
        _text("param-description", F.concat(path, F.lit(f" > {key}")), F.when(path != "input", J.text_at(schema, f"$.{key}")))
        for key in ("description", "title")
    ]
    names = F.transform(
        J.members_at(schema, "$.properties"),
        lambda m: _text("param-name", F.concat(F.lit("param "), m["key"], F.lit(" > name")), m["key"]),
    )
    values = [_value_texts(schema, path, key) for key in VALUE_KEYS]
    return F.concat(F.array(*own), *values, names)


def _value_texts(schema: Column, path: Column, key: str) -> Column:
    return F.transform(
        _values(schema, key), lambda t: _text("param-value", F.concat(path, F.lit(f" > {key}")), t)
    )


def schema_nodes(tools: DataFrame) -> DataFrame:
    """Adds `nodes`, every schema object of the input schema down to PLACED_DEPTH, and `deeper`, the objects right below.

    Each level is worked out from the level above inside the row, so the tree costs one pass and
    no shuffle.
    """
    root = F.when(F.col("input_schema").isNotNull(), F.array(_node(F.lit("input"), F.col("input_schema")))).otherwise(
        F.array().cast(NO_NODES)
    )
    levels = tools.withColumn("_level0", root)
    for depth in range(1, PLACED_DEPTH + 2):
        above = F.col(f"_level{depth - 1}")
        # Most schemas are flat; an empty level ends the work for all deeper ones.
        below = F.when(F.size(above) > 0, F.flatten(F.transform(above, _children))).otherwise(F.array().cast(NO_NODES))
        levels = levels.withColumn(f"_level{depth}", below)
    names = [f"_level{d}" for d in range(PLACED_DEPTH + 1)]
    return levels.withColumn("nodes", F.concat(*names)).withColumnRenamed(f"_level{PLACED_DEPTH + 1}", "deeper").drop(*names)


def _deeper_texts(node: Column) -> Column:
    """Every string below the placed depth, however deep: values, and keys that are no words of the schema language."""
    raw = F.to_json(node["schema"])
    string = F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?')
    found, colons = F.regexp_extract_all(raw, string, F.lit(1)), F.regexp_extract_all(raw, string, F.lit(2))
    place = F.concat(node["path"], F.lit(" > (deeper)"))

    def named(s: Column, i: Column) -> Column:
        is_key = F.get(colons, i) != ""
        plain = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), s, F.lit('"'))), "$", "string")
        kind = F.when(is_key, "param-name").otherwise("param-value")
        return F.struct(kind.alias("kind"), place.alias("place"), F.when(~(is_key & s.isin(*SCHEMA_WORDS)), plain).alias("text"))

    return F.filter(F.array_distinct(F.transform(found, named)), lambda t: t["text"].isNotNull())


def tool_surfaces(tools: DataFrame) -> DataFrame:
    """Name, title, description, annotations and all schema texts of every tool."""
    notes = F.filter(
        F.transform(
            J.members_at(F.col("annotations"), "$"),
            lambda m: _text("tool-annotation", F.concat(F.lit("annotation "), m["key"]), J.text_at(m["value"], "$")),
        ),
        lambda t: t["text"].isNotNull(),
    )
    texts = F.concat(
        F.array(
            _text("tool-name", F.lit("name"), F.col("name")),
            _text("tool-title", F.lit("title"), F.col("title")),
            _text("tool-description", F.lit("description"), F.col("description")),
        ),
        notes,
        F.flatten(F.transform("nodes", _node_texts)),
        F.flatten(F.transform("deeper", _deeper_texts)),
    )
    rows = schema_nodes(tools).select("server_id", "seq", "name", F.explode(texts).alias("t")).where(
        F.col("t.text") != ""
    )
    return rows.select(
        "server_id", "seq", F.col("t.kind").alias("kind"), F.lit("tool").alias("target_kind"),
        F.col("name").alias("target_name"),
        F.concat(F.lit("tool "), F.col("name"), F.lit(" > "), F.col("t.place")).alias("location"),
        F.col("t.text").alias("text"), F.lit(False).alias("is_dynamic"),
    )


def _rows(df: DataFrame, kind: str, target_kind: str, name: Column, place: Column, text: Column, dynamic: bool) -> DataFrame:
    return df.where(text.isNotNull() & (text != "")).select(
        "server_id", F.col("seq").cast("long").alias("seq"), F.lit(kind).alias("kind"),
        F.lit(target_kind).alias("target_kind"), name.alias("target_name"), place.alias("location"),
        text.alias("text"), F.lit(dynamic).alias("is_dynamic"),
    )


def instruction_surfaces(servers: DataFrame) -> DataFrame:
    return _rows(
        servers.withColumn("seq", F.lit(-1)), "instructions", "server", F.lit("instructions"),
        F.lit("server instructions"), F.col("instructions"), False,
    )


def prompt_surfaces(prompts: DataFrame) -> DataFrame:
    """Description, arguments and rendered text. Rendered text only exists at run time."""
    where = F.concat(F.lit("prompt "), F.col("name"))
    name = F.col("name")
    arguments = prompts.select("server_id", "seq", "name", F.explode("arguments").alias("a"))
    return (
        _rows(prompts, "prompt-description", "prompt", name, F.concat(where, F.lit(" > description")), F.col("description"), False)
        .unionByName(
            _rows(arguments, "prompt-argument", "prompt", name, F.concat(where, F.lit(" > argument "), F.col("a.name")), F.col("a.description"), False)
        )
        .unionByName(
            _rows(prompts, "prompt-text", "prompt", name, F.concat(where, F.lit(" > rendered text")), F.col("rendered_text"), True)
        )
    )


def resource_surfaces(resources: DataFrame) -> DataFrame:
    label = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("uri"))
    where = F.concat(F.lit("resource "), label)
    return _rows(
        resources, "resource-description", "resource", label, F.concat(where, F.lit(" > description")), F.col("description"), False
    ).unionByName(
        _rows(resources, "resource-text", "resource", label, F.concat(where, F.lit(" > content")), F.col("text"), True)
    )


def template_surfaces(templates: DataFrame) -> DataFrame:
    label = F.when(F.col("name") != "", F.col("name")).otherwise(F.col("uri_template"))
    return _rows(
        templates, "resource-description", "resource", label,
        F.concat(F.lit("resource template "), label, F.lit(" > description")), F.col("description"), False,
    )


def output_surfaces(tool_calls: DataFrame) -> DataFrame:
    """Text that came back from tool calls."""
    return _rows(
        tool_calls, "tool-output", "tool", F.col("tool"), F.concat(F.lit("tool "), F.col("tool"), F.lit(" > call result")),
        F.col("output_text"), True,
    )


def changed_surfaces(changed: DataFrame) -> DataFrame:
    """Texts of definitions that changed while a session ran; `changed(server_id, seq, definition)`."""
    parsed = changed.withColumn("v", J.parse(F.col("definition")))
    rows = parsed.select("server_id", F.col("seq").cast("long").alias("seq"), *C.tool_columns(F.col("v")))
    after = F.regexp_replace("location", "^tool (.*?) > ", "tool $1 (after change) > ")
    return tool_surfaces(rows).withColumn("location", after)


def union(*parts: DataFrame | None) -> DataFrame:
    """All surfaces of a scan in one table."""
    given = [conform(p, SURFACE_SCHEMA) for p in parts if p is not None]
    return reduce(DataFrame.unionByName, given)


def inventory_surfaces(inventory: DataFrame) -> DataFrame:
    """Every text the catalogs list."""
    return union(
        instruction_surfaces(inventory),
        tool_surfaces(C.tools(inventory)),
        prompt_surfaces(C.prompts(inventory)),
        resource_surfaces(C.resources(inventory)),
        template_surfaces(C.resource_templates(inventory)),
    )


def metadata(surfaces: DataFrame) -> DataFrame:
    return surfaces.where(~F.col("is_dynamic"))


def dynamic(surfaces: DataFrame) -> DataFrame:
    return surfaces.where(F.col("is_dynamic"))


def content_text(result: Column, limit: int | None = None) -> Column:
    """All text of a tool, prompt or resource answer (VARIANT), one piece per line; cut only if a limit is given."""

    def item_texts(item: Column) -> Column:
        plain = J.text_at(item, "$")
        return F.when(plain.isNotNull(), F.array(plain)).otherwise(
            F.array_compact(F.array(J.text_at(item, "$.text"), J.text_at(item, "$.resource.text")))
        )

    def message_texts(message: Column) -> Column:
        content = F.try_variant_get(message, "$.content", "variant")
        many = F.when(J.is_array(content), J.items_at(content, "$")).when(content.isNotNull(), F.array(content)).otherwise(
            F.array().cast("array<variant>")
        )
        return F.flatten(F.transform(many, item_texts))

    structured = F.to_json(F.try_variant_get(result, "$.structuredContent", "variant"))
    pieces = F.concat(
        F.flatten(F.transform(J.items_at(result, "$.content"), item_texts)),
        F.flatten(F.transform(J.items_at(result, "$.messages"), message_texts)),
        F.array_compact(F.transform(J.items_at(result, "$.contents"), lambda i: J.text_at(i, "$.text"))),
        F.array_compact(F.array(F.when(structured != "null", structured))),
    )
    text = F.array_join(pieces, "\n")
    return text if limit is None else F.left(text, F.lit(limit))
