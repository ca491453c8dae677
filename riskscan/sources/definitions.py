"""Tool definitions read from source code by pattern: JavaScript, Go and Rust.

`files(server_id, path, text)`; one row per definition found, with its place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.sources.catalog import SKIPPED_DIRS

JS_STRING = r"(?:\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\$])*+`)"
GO_STRING = r"(?:\"(?:[^\"\\\n]|\\.)*+\"|`[^`]*+`)"


def _unquoted(text: Column) -> Column:
    """The value of a string literal."""
    inner = F.substr(text, F.lit(2), F.char_length(text) - 2)
    plain = F.replace(inner, F.lit("\\n"), F.lit("\n"))
    for quote in ('"', "'", "`"):
        plain = F.replace(plain, F.lit("\\" + quote), F.lit(quote))
    return F.coalesce(plain, F.lit(""))


def _pairs(text: Column, pattern: str, name_group: int, text_group: int, form: int) -> Column:
    """(form, position, name, description) of every match of a pattern with two string groups."""
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(name_group))
    texts = F.regexp_extract_all(text, F.lit(pattern), F.lit(text_group)) if text_group else None
    return F.transform(
        names,
        lambda n, i: F.struct(
            F.lit(form).alias("form"), i.alias("pos"), _unquoted(n).alias("name"),
            (_unquoted(F.get(texts, i)) if texts is not None else F.lit("")).alias("description"),
        ),
    )


def _with_inner(text: Column, head: str, inner: str, form: int) -> Column:
    """Names after `head`, each with the first `inner` string up to the next `head`."""
    names = F.regexp_extract_all(text, F.lit(rf"{head}({JS_STRING if form < 10 else GO_STRING})"), F.lit(1))
    after = F.slice(F.split(text, head + (JS_STRING if form < 10 else GO_STRING), -1), F.lit(2), F.size(names) + 1)
    return F.transform(
        names,
        lambda n, i: F.struct(
            F.lit(form).alias("form"), i.alias("pos"), _unquoted(n).alias("name"),
            _unquoted(F.regexp_extract(F.get(after, i), inner, 1)).alias("description"),
        ),
    )


def _rows(files: DataFrame, found: Column) -> DataFrame:
    rows = files.select("server_id", "path", F.explode(found).alias("d"))
    return rows.select("server_id", "path", "d.form", "d.pos", "d.name", "d.description").where(F.col("name") != "")


def javascript_tools(files: DataFrame) -> DataFrame:
    """registerTool/addTool calls, .tool(name, text) calls, and objects with name and description."""
    text = F.col("text")
    described = rf"\bdescription\s*:\s*({JS_STRING})"
    pair = rf"\.tool\s*\(\s*({JS_STRING})\s*,\s*({JS_STRING})"
    obj = rf"\bname\s*:\s*({JS_STRING})\s*,\s*(?:title\s*:\s*{JS_STRING}\s*,\s*)?description\s*:\s*({JS_STRING})"
    found = F.concat(
        _with_inner(text, r"(?:registerTool|addTool)\s*\(\s*", described, 1),
        _pairs(text, pair, 1, 2, 2),
        _pairs(text, obj, 1, 2, 3),
    )
    return _rows(files, found)


def javascript_prompts(files: DataFrame) -> DataFrame:
    return _rows(files, _pairs(F.col("text"), rf"(?:registerPrompt|\.prompt)\s*\(\s*({JS_STRING})", 1, 0, 1))


def javascript_server(files: DataFrame) -> DataFrame:
    """Instructions and server name given in code."""
    text = F.col("text")
    first = lambda p: F.nullif(_unquoted(F.nullif(F.regexp_extract(text, p, 1), F.lit(""))), F.lit(""))
    return files.select(
        "server_id", "path",
        first(rf"\binstructions\s*:\s*({JS_STRING})").alias("instructions"),
        first(rf"new\s+(?:McpServer|Server)\s*\(\s*\{{\s*name\s*:\s*({JS_STRING})").alias("server_name"),
    )


def go_tools(files: DataFrame) -> DataFrame:
    """NewTool calls and Tool structs. A struct ends at its closing brace on a line of its own."""
    text = F.col("text")
    # A description may be wrapped in a call; the text is then the last string of the call.
    value = rf"(?:[\w.]+\(\s*(?:{GO_STRING}\s*,\s*)?)?({GO_STRING})"
    calls = _with_inner(text, r"mcp\.NewTool\(\s*", rf"mcp\.WithDescription\(\s*{value}", 10)
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)\bmcp\.Tool\s*\{(.*?)\n\s*\}"), F.lit(1))
    short = F.regexp_extract_all(text, F.lit(rf"\bmcp\.Tool\s*\{{((?:[^{{}}\"`\n]|{GO_STRING})*+)\}}"), F.lit(1))
    struct = F.transform(
        F.concat(bodies, short),
        lambda b, i: F.struct(
            F.lit(11).alias("form"), i.alias("pos"), _unquoted(F.regexp_extract(b, rf"\bName:\s*({GO_STRING})", 1)).alias("name"),
            _unquoted(F.regexp_extract(b, rf"\bDescription:\s*{value}", 1)).alias("description"),
        ),
    )
    return _rows(files.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go")), F.concat(calls, struct))


def rust_tools(files: DataFrame) -> DataFrame:
    """#[tool(...)] attributes followed by a function."""
    text = F.col("text")
    head = r"(?s)#\[tool\(([^\]]*)\)\]\s*(?:#\[[^\]]*\]\s*)*+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"
    attrs = F.regexp_extract_all(text, F.lit(head), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(head), F.lit(2))
    attr = lambda a, key: _unquoted(F.nullif(F.regexp_extract(a, rf"\b{key}\s*=\s*(\"(?:[^\"\\]|\\.)*+\")", 1), F.lit("")))
    found = F.transform(
        attrs,
        lambda a, i: F.struct(
            F.lit(12).alias("form"), i.alias("pos"),
            F.when(attr(a, "name") != "", attr(a, "name")).otherwise(F.get(names, i)).alias("name"),
            attr(a, "description").alias("description"),
        ),
    )
    return _rows(files.where(F.col("path").endswith(".rs")), found)


def other_language_tools(files: DataFrame) -> DataFrame:
    """Go and Rust tools outside dependency, build and test folders."""
    own = files.where(~F.col("path").rlike(SKIPPED_DIRS) & ~F.col("path").rlike(r"(?:^|/)(?:vendor|target)/"))
    return first_definitions(go_tools(own).unionByName(rust_tools(own)))


def first_definitions(found: DataFrame) -> DataFrame:
    """One definition per server and name: the first by file, form and place in the file."""
    first = found.groupBy("server_id", "name").agg(
        F.min(F.struct("path", "form", "pos", "description")).alias("f")
    )
    return first.select("server_id", "name", "f.path", "f.form", "f.pos", "f.description")


def as_tools(found: DataFrame) -> DataFrame:
    """Definitions in the layout of the tools table, with an empty object schema."""
    schema = F.parse_json(F.lit('{"type":"object","properties":{}}'))
    raw = F.parse_json(F.to_json(F.struct("name", "description")))
    return found.select(
        "server_id", (F.col("form") * 100_000 + F.col("pos")).cast("long").alias("seq"), "name",
        F.lit(None).cast("string").alias("title"), "description", schema.alias("input_schema"),
        F.lit(None).cast("variant").alias("output_schema"), F.lit(None).cast("variant").alias("annotations"),
        raw.alias("raw"),
    )
