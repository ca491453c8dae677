"""Made cases mixed into the rows of the given tables.

A row's key picks a case; places in the case's texts are filled from the row, so whole given texts
reach the code beside what was written by hand. What each case must yield is written down with the
same places, which the SQL twins fill on their own. A null text fills a place like an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloads import lit_sql, table


@dataclass(frozen=True)
class Case:
    """given: column values of a row, with places in texts. yields: rule, severity, confidence, target, description, or one answer each."""

    given: dict
    yields: tuple = ()


@dataclass(frozen=True)
class Source:
    """A given table, a number that names its rows (alike in Spark and SQL), and its text."""

    table: str
    key: str
    text: str


DOCUMENTS = Source("documents", "doc_id", "text")
PAGES = Source("pages", "page_id", "url")
TURNS = Source("conversations", "conv_id * 1000 + turn", "text")


def _one_line(t: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(t, "\"'`\\", ""), r"[ \t\n\r\f]+", " "))


def in_json(t: Column) -> Column:
    whole = F.to_json(F.struct(t.alias("t")))
    return F.substr(whole, F.lit(7), F.char_length(whole) - 8)


def _commented(sign: str) -> Callable[[Column], Column]:
    return lambda t: F.concat(F.lit(sign), F.regexp_replace(t, "\n", f"\n{sign}"))


#: A place and what fills it: the number of the row, a word of its text, the host of an address, an
#: address without its scheme, its host with two folders, the text in one line without quotes, as it
#: is, inside JSON, as comments.
PLACES: dict[str, Callable[[Column], Column] | None] = {
    "{k}": None,
    "{w}": lambda t: F.coalesce(F.nullif(F.regexp_extract(F.lower(t), "[a-z]{4,}", 0), F.lit("")), F.lit("word")),
    "{h}": lambda t: F.regexp_extract(t, "://([^/:?#]+)", 1),
    "{u}": lambda t: F.regexp_replace(t, "^[a-z]+://", ""),
    "{p}": lambda t: F.regexp_extract(F.lower(t), "://(?:www[.])?([^/:?#]+/[^/?#]+/[^/?#]+)", 1),
    "{l}": _one_line,
    "{t}": lambda t: t,
    "{j}": in_json,
    "{c}": _commented("# "),
    "{s}": _commented("// "),
}
IN_SQL = {
    "{w}": "coalesce(nullif(regexp_extract(lower(body), '[a-z]{4,}'), ''), 'word')",
    "{h}": "regexp_extract(body, '://([^/:?#]+)', 1)",
    "{u}": "regexp_replace(body, '^[a-z]+://', '')",
    "{p}": "regexp_extract(lower(body), '://(?:www[.])?([^/:?#]+/[^/?#]+/[^/?#]+)', 1)",
    "{l}": "trim(regexp_replace(replace(translate(body, '\"''`', ''), chr(92), ''), '[ \\t\\n\\r\\f]+', ' ', 'g'))",
    "{t}": "body",
}


def _places(values: Iterable) -> list[str]:
    said = repr(list(values))
    return [p for p in PLACES if p in said]


def rows_sql(source: Source, cases: tuple[Case, ...], columns: tuple[str, ...]) -> str:
    """The rows all cases must yield: server_id and the columns, places filled."""
    answers = [(i, *((y,) if isinstance(y, str) else y)) for i, c in enumerate(cases) for y in c.yields]
    used = [p for p in _places(answers) if p in IN_SQL]
    filled = ""
    for name in columns:
        one = f"replace(v.{name}, '{{k}}', k)"
        for p in used:
            one = f"replace({one}, '{p}', place_{p[1]})"
        filled += f", {one} as {name}"
    values = ", ".join(f"({i}, {', '.join(map(lit_sql, y))})" for i, *y in answers)
    return f"""
    select 's' || k as server_id{filled}
    from (select k, nr{"".join(f", {IN_SQL[p]} as place_{p[1]}" for p in used)}
          from (select cast({source.key} as varchar) as k, ({source.key}) % {len(cases)} as nr, coalesce({source.text}, '') as body from {source.table})) t
    join (values {values}) v(nr, {", ".join(columns)}) on t.nr = v.nr
    """


def mixed(spark, sf_dir: str, source: Source, cases: tuple[Case, ...], schema: str) -> DataFrame:
    """Each row of a table as the case its key picks: server_id, seq and the case's columns, places filled."""
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    made = spark.createDataFrame([(i, *[c.given.get(n) for n in names]) for i, c in enumerate(cases)], f"_nr int, {schema}")
    used = _places(c.given for c in cases)
    key, body = F.expr(source.key), F.coalesce(F.col(source.text), F.lit(""))
    places = [F.col("_k") if PLACES[p] is None else F.col(f"_{p[1]}") for p in used]
    rows = table(spark, sf_dir, source.table).select(
        key.cast("string").alias("_k"), (key % len(cases)).cast("int").alias("_nr"), key.cast("bigint").alias("seq"),
        *[PLACES[p](body).alias(f"_{p[1]}") for p in used if PLACES[p] is not None],
    )

    def filled(c: Column) -> Column:
        for p, value in zip(used, places):
            c = F.when(F.contains(c, F.lit(p)), F.replace(c, F.lit(p), value)).otherwise(c)
        return c

    # One row per case, a fixed number.
    joined = rows.join(F.broadcast(made), "_nr")
    done = {}
    for n, kind in joined.dtypes:
        if n in names and kind == "string":
            done[n] = filled(F.col(n))
        elif n in names and kind == "array<string>":
            done[n] = F.transform(n, filled)
        elif n in names and kind == "array<struct<path:string,text:string>>":
            done[n] = F.transform(n, lambda f: F.struct(filled(f["path"]).alias("path"), filled(f["text"]).alias("text")))
    return joined.withColumns(done).withColumn("server_id", F.concat(F.lit("s"), F.col("_k"))).select("server_id", "seq", *names)
