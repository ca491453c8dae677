"""Secret scans: wide candidates, false positives removed by a random forest.

Candidates are runs of letters, digits and a few signs that are long enough for a key, and whole
values, with all their signs and from six characters on: what stands in quotes, is assigned to a
key name, is the password of a URL, or has the format of an issued key. Their features are the length, the transitions between characters (changes of character class, and how
common their letter pairs are in the corpus), how much of them the corpus' own words cover, what
the path looks like, and the neighbouring words. The forest is trained on labelled findings, a
bounded sample of them, and scores every candidate.

Corpus statistics cover all documents. Features that depend on the value only are worked out once
per distinct value, so copies cost little; the joins that bring them back can be split by adaptive
execution. All steps are DataFrame operations; the forest is Spark ML's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskscan.functions.secrets import ISSUED_KEYS
from riskscan.llm.tables import forget, is_empty, saved, whole

#: Shortest candidate.
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/=_\\-]{{{LEAST},}}"
#: Labelled findings of each label in the training sample, trees, depth.
SAMPLE_ROWS, TREES, DEPTH, SEED = 4000, 24, 7, 11
#: Documents that make a word part of the dictionary.
DICTIONARY_DOCS = 3
#: Characters of a neighbour that are looked at.
NEAR = 60
#: Names whose assigned values the weak labels call secrets.
KEY_NAMES = "(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: A key name and the sign that assigns to it.
GIVEN = f"{KEY_NAMES}[A-Za-z0-9_-]{{0,64}}[\"'`]?\\s*(?:=>|:=|=|:)\\s*"
#: An unquoted value: it ends at white space, quotes, brackets, commas and semicolons, and before closing dots and colons.
BARE = "([^\\s\"'`,;<>(){}\\[\\]]{5,}[^\\s\"'`,;<>(){}\\[\\].:])"
#: Whole values inside a word, with the group that holds the value.
VALUES = (
    ("[\"'`]([^\\s\"'`]{6,})[\"'`]", 1),
    ("\"([^\\s\"]{6,})\"", 1),
    (GIVEN + BARE, 3),
    ("://[^\\s/:@\"'`]{0,256}:([^\\s/\"'`]{6,})@", 1),
    *((kind.regex, 0) for kind in ISSUED_KEYS if " " not in kind.regex),
)
#: A value that the words before assign.
LATER, VALUE_LATER = f"{GIVEN}$", f"^{BARE}"
NAME_LAST, SIGN_FIRST = f"{KEY_NAMES}[A-Za-z0-9_-]{{0,64}}[\"'`]?\\s*$", f"^(?:=>|:=|=|:){BARE}"
#: What a word with a whole value matches, given the words before.
VALUED = "|".join(f"(?:{regex})" for regex, _ in VALUES)
VALUE_FEATURES = ("length", "turns", "digits", "uppers", "signs", "distinct", "pairs", "covered")
PLACE_FEATURES = ("quoted", "assigned", "before_known", "after_known", "before_length", "in_path", "source_path", "test_path")


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """One row per candidate: _row, doc_id, path, word_no, part_no, value, near, before, after; saved.

    Words are what stands between white space; a word may hold several candidates, its runs first
    and then whole values that are no run themselves. near is what stands directly before the
    candidate, within its word and in the two words before; before and after are the neighbouring
    words. Values hold no white space. Null and empty texts have none; a path that is null counts
    as empty.
    """
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col in df.columns else F.lit("")
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), path.alias("path"), whole(text_col).alias("_text"))
    # Most texts hold none: they are not cut into words.
    some = F.col("_text").rlike(CANDIDATE) | F.col("_text").rlike(VALUED)
    rows = rows.filter(some).select("_row", "doc_id", "path", F.split("_text", "\\s+").alias("_words"))

    def word(place: Column) -> Column:
        return F.when((place < 1) | (place > F.size("_words")), "").otherwise(F.get("_words", place - 1))

    def two(place: Column) -> Column:
        return F.right(F.concat(word(place - 2), F.lit(" "), word(place - 1)), F.lit(NEAR))

    def later(before: Column, own: Column) -> Column:
        return (own.rlike(VALUE_LATER) & before.rlike(LATER)) | (own.rlike(SIGN_FIRST) & before.rlike(NAME_LAST))

    def hit(i: Column) -> Column:
        own = F.element_at("_words", i.cast("int"))
        # Only words of six characters or more can hold a value.
        return (F.length(own) >= 6) & (own.rlike(CANDIDATE) | own.rlike(VALUED) | later(two(i.cast("int")), own))

    at = rows.withColumn("word_no", F.explode(F.filter(F.sequence(F.lit(1), F.size("_words")), hit)))
    no = F.col("word_no")
    own = at.select("_row", "doc_id", "path", "word_no", word(no).alias("_word"), two(no).alias("_two"), F.right(word(no - 1), F.lit(NEAR)).alias("before"), F.left(word(no + 1), F.lit(NEAR)).alias("after"))
    cut = own.withColumns({"_values": F.regexp_extract_all("_word", F.lit(CANDIDATE), F.lit(0)), "_between": F.split("_word", CANDIDATE, -1)})
    inside = [F.regexp_extract_all("_word", F.lit(regex), F.lit(group)) for regex, group in VALUES]
    assigned = F.when(F.col("_two").rlike(LATER), F.regexp_extract("_word", VALUE_LATER, 1)).when(F.col("_two").rlike(NAME_LAST), F.regexp_extract("_word", SIGN_FIRST, 1))
    more = F.array_except(F.concat(*inside, F.array(F.coalesce(assigned, F.lit("")))), F.array_append("_values", F.lit("")))
    left = lambda i: F.right(F.get("_between", i), F.lit(NEAR))
    runs = F.transform(
        "_values", lambda v, i: F.struct(v.alias("value"), F.when(i == 0, F.concat(F.col("_two"), F.lit(" "), left(i))).otherwise(left(i)).alias("near"))
    )
    front = lambda v: F.concat(F.col("_two"), F.lit(" "), F.substr("_word", F.lit(1), F.instr(F.col("_word"), v) - 1))
    wholes = F.transform(more, lambda v: F.struct(v.alias("value"), F.right(front(v), F.lit(NEAR)).alias("near")))
    each = cut.select("*", F.posexplode(F.concat(runs, wholes)).alias("part_no", "_found"))
    return saved(each.select("_row", "doc_id", "path", "word_no", "part_no", "_found.value", "_found.near", "before", "after"), "candidates")


def dictionary(df: DataFrame, text_col: str = "text", least: int = DICTIONARY_DOCS) -> DataFrame:
    """word, docs: lower-case words of three letters or more that at least `least` documents hold; saved."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole(text_col)), F.lit("\\p{L}{3,}"), F.lit(0))))
    counts = df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return saved(counts.filter(F.col("docs") >= least), "dictionary")


def _pairs(text: Column) -> Column:
    """Adjacent characters of a text of two or more."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2))))


def pair_scores(words: DataFrame) -> DataFrame:
    """pair, commonness: log-share of adjacent letters a-z in the dictionary's words, weighted by documents.

    At most 26 * 26 rows.
    """
    each = words.select("docs", _pairs(F.col("word")).alias("pair")).filter(F.col("pair").rlike("^[a-z]{2}$"))
    counts = each.groupBy("pair").agg(F.sum("docs").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select("pair", F.log((F.col("n") + 1) / F.lit(total + 676.0)).alias("commonness"))


def value_features(values: DataFrame, words: DataFrame) -> DataFrame:
    """value and its VALUE_FEATURES; values: distinct values."""
    size = F.length("value")

    def share(kind: str) -> Column:
        return F.length(F.regexp_replace("value", f"[{kind[1:] if kind[0] == '^' else '^' + kind}]", "")) / size

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "d"), "[^lud]+", "s")
    plain = values.withColumns(
        {
            "length": size.cast("double"), "turns": (F.length(kinds) - 1) / size, "digits": share("0-9"), "uppers": share("A-Z"), "signs": share("^A-Za-z0-9"),
            "distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
        }
    )
    rare = F.lit(-12.0)
    scores = F.broadcast(pair_scores(words))
    pairs = values.select("value", _pairs(F.lower("value")).alias("pair")).join(scores, "pair", "left")
    pairs = pairs.groupBy("value").agg(F.avg(F.coalesce("commonness", rare)).alias("pairs"))
    parts = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = parts.join(words.select("word"), "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("_letters"))
    joined = plain.join(pairs, "value").join(covered, "value", "left")
    return joined.withColumn("covered", F.coalesce(F.col("_letters"), F.lit(0)) / F.col("length")).select("value", *VALUE_FEATURES)


def _flag(test: Column) -> Column:
    return test.cast("double")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with all features; saved."""
    values = saved(value_features(found.select("value").distinct(), words), "values")
    bare = {side: F.lower(F.regexp_extract(side, "\\p{L}{3,}", 0)) for side in ("before", "after")}
    rows = found.withColumns({"_before": bare["before"], "_after": bare["after"]})
    for side in ("before", "after"):
        known = words.select(F.col("word").alias(f"_{side}"), F.lit(1.0).alias(f"{side}_known"))
        rows = rows.join(known, f"_{side}", "left").withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(0.0)))
    rows = rows.withColumns(
        {
            "quoted": _flag(F.col("near").rlike("[\"'`]$")), "assigned": _flag(F.col("near").rlike("[=:]>?\\s*[\"'`(\\[]*\\s*$")),
            "before_length": F.length("before").cast("double"), "in_path": _flag(F.col("near").rlike("[/\\\\@.]$") | F.col("value").rlike("/.*/")),
            "source_path": _flag(F.lower("path").rlike("\\.(env|ya?ml|json|toml|cfg|ini|conf|properties|py|js|ts|go|java|rb|sh)$")),
            "test_path": _flag(F.lower("path").rlike("(^|[/_.-])(tests?|specs?|fixtures?|examples?|mocks?|docs?)([/_.-]|$)")),
        }
    )
    out = saved(rows.drop("_before", "_after").join(values, "value"), "featured")
    forget(values)
    return out


def by_assignment(found: DataFrame) -> DataFrame:
    """Weakly labelled findings: _row, word_no, part_no, label; 1 for a value assigned to a name such as token or password."""
    named = F.col("near").rlike(f"{KEY_NAMES}[A-Za-z0-9_-]*[\"']?\\s*(=|:|=>)\\s*[\"'`]?$")
    return found.select("_row", "word_no", "part_no", named.cast("int").alias("label"))


def trained(rows: DataFrame) -> RandomForestClassificationModel | float:
    """A forest from labelled rows (features and label), or the only label there is (0.5 without any).

    At most SAMPLE_ROWS rows of each label are used, picked by a hash of the value and the place.
    """
    order = [F.xxhash64("value", "near"), "_row", "word_no", "part_no"]
    picked = [rows.filter(f"label = {y}").orderBy(*order).limit(SAMPLE_ROWS).select("label", *VALUE_FEATURES, *PLACE_FEATURES) for y in (0, 1)]
    sample = saved(reduce(DataFrame.unionByName, picked), "sample")
    there = [y for y in (0, 1) if not is_empty(sample.filter(f"label = {y}"))]
    if len(there) < 2:
        return float(there[0]) if there else 0.5
    grown = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_label"
    ).fit(_assembled(sample).withColumn("label", F.col("label").cast("double")))
    forget(sample)
    return grown


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*VALUE_FEATURES, *PLACE_FEATURES], outputCol="_features").transform(rows)


def scan(df: DataFrame, found: DataFrame, labelled: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word_no, part_no, path, value_length, value_sha256, score, kept.

    df: the documents the dictionary is made of; found: `candidates`; labelled: findings with a
    label 0 or 1 by `_row`, `word_no`, `part_no`. score is the forest's share for a secret, and a
    candidate is kept at 0.5 or more. Values are given as hashes, never in the clear.
    """
    words = dictionary(df, text_col)
    rows = featured(found, words)
    model = trained(rows.join(labelled.filter("label in (0, 1)"), ["_row", "word_no", "part_no"]))
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        scored = model.transform(_assembled(rows)).withColumn("score", F.element_at(vector_to_array("_probability"), 2))
    return scored.select(
        "doc_id", "word_no", "part_no", "path", F.length("value").alias("value_length"), F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("kept")
    )
