"""Detection quality: labelled cases against findings.

`cases(case_name, malicious, must_find, must_not_find, min_grade, max_grade, allow)`;
`findings(case_name, server_id, rule_id, target_name, sev_rank, conf_rank, status)`;
`grades(case_name, server_id, grade, score, status)`. All cases are judged in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.functions import levels as L
from riskscan.functions.globs import rule_matches_col

# What a confidence is worth in the average.
CONFIDENCE_VALUE = {"low": "0.3", "medium": "0.6", "high": "1.0"}


def read_cases(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Cases from JSON lines, optionally only some by name."""
    cases = spark.read.schema(
        "case_name string, malicious boolean, must_find array<string>, must_not_find array<string>, min_grade string, "
        "max_grade string, allow array<string>"
    ).json(path)
    return cases.where(F.col("case_name").isin(*only)) if only else cases


def _value(conf_rank: Column) -> Column:
    values = F.array(*[F.lit(CONFIDENCE_VALUE[c]).cast("decimal(3,1)") for c in L.CONFIDENCES])
    return F.element_at(values, conf_rank + 1)


def worst_server(grades: DataFrame) -> DataFrame:
    """Per case the worst grade, then the highest score; an unknown grade ranks below A."""
    rank = F.coalesce(L.grade_rank(F.col("grade")), F.lit(-1))
    worst = grades.groupBy("case_name").agg(
        F.max_by(F.struct("grade", "score"), F.struct(rank, F.col("score"), F.col("server_id"))).alias("w")
    )
    return worst.select("case_name", "w.grade", "w.score")


def found_by_rule(findings: DataFrame) -> DataFrame:
    """Active findings per case, rule and target: what judging needs, and no more."""
    active = findings.where(L.counts_for_risk(F.col("status")))
    return active.groupBy("case_name", "rule_id", "target_name").agg(
        F.max("conf_rank").alias("conf_rank"),
        F.max(F.when(F.col("conf_rank") > 0, F.col("sev_rank"))).alias("sure_sev"),
    )


def judge(cases: DataFrame, findings: DataFrame, grades: DataFrame, shown: int = 100) -> DataFrame:
    """One row per case: hits, misses, false alarms, grade problems, flagged, passed.

    `false_positives` shows the first `shown` alarms next to `false_positive_count`; the whole
    list is a table of its own, `false_alarms`.

    Expectations are short lists in a case; they are joined with the distinct rules a case
    found, never with its findings.
    """
    found = found_by_rule(findings)
    rules = found.groupBy("case_name", "rule_id").agg(F.max("conf_rank").alias("conf_rank"))
    wanted = cases.select("case_name", F.explode("must_find").alias("wanted"))
    named = (wanted["case_name"] == rules["case_name"]) & rule_matches_col(F.col("rule_id"), F.col("wanted"))
    hits = wanted.join(rules, named, "left").groupBy(wanted["case_name"], "wanted").agg(F.max("conf_rank").alias("best"))
    expected = hits.groupBy("case_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("best").isNotNull(), F.col("wanted")))).alias("true_positives"),
        F.array_sort(F.collect_list(F.when(F.col("best").isNull(), F.col("wanted")))).alias("false_negatives"),
        F.sum(_value(F.col("best"))).alias("confidence_sum"),
    )
    alarms = false_alarms(cases, found)
    counted = alarms.groupBy("case_name").agg(F.count(F.lit(1)).alias("false_positive_count"))
    from riskscan.operators.skew import top_k

    some = top_k(alarms, ["case_name"], [F.col("label")], shown, ["label"]).groupBy("case_name").agg(
        F.array_sort(F.collect_list("label")).alias("false_positives")
    )
    strong = found.groupBy("case_name").agg(
        F.max(F.coalesce(F.col("sure_sev") >= 3, F.lit(False))).alias("strong"), F.count(F.lit(1)).alias("active")
    )
    none = F.array().cast("array<string>")
    joined = (
        cases.join(worst_server(grades), "case_name", "left").join(expected, "case_name", "left").join(counted, "case_name", "left")
        .join(some, "case_name", "left").join(strong, "case_name", "left")
    )
    rank = L.grade_rank(F.col("grade"))
    outside = lambda bound, better: F.col(bound).isNotNull() & (
        rank.isNull() | (rank < L.grade_rank(F.col(bound)) if better else rank > L.grade_rank(F.col(bound)))
    )
    problem = lambda bound, better, word: F.when(
        outside(bound, better),
        F.concat(F.lit("grade "), F.coalesce("grade", F.lit("?")), F.lit(f" is {word} than the expected {'minimum' if better else 'maximum'} "), F.col(bound)),
    )
    shaped = joined.select(
        "case_name", "malicious",
        F.coalesce("grade", F.lit("?")).alias("grade"), "score",
        F.coalesce("true_positives", none).alias("true_positives"),
        F.coalesce("false_negatives", none).alias("false_negatives"),
        F.coalesce("false_positives", none).alias("false_positives"),
        F.coalesce("false_positive_count", F.lit(0)).alias("false_positive_count"),
        F.array_compact(F.array(problem("min_grade", True, "better"), problem("max_grade", False, "worse"))).alias("problems"),
        (F.coalesce("strong", F.lit(False)) | F.coalesce(F.col("grade").isin("D", "F"), F.lit(False))).alias("flagged"),
        F.coalesce("confidence_sum", F.lit(0).cast("decimal(10,1)")).alias("confidence_sum"),
    )
    passed = (F.size("false_negatives") == 0) & (F.col("false_positive_count") == 0) & (F.size("problems") == 0)
    return shaped.withColumn("passed", passed)


def false_alarms(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Unwanted findings: named in must_not_find, or serious on a benign case and not allowed."""
    label = F.concat("rule_id", F.lit(" on "), "target_name")
    unwanted = cases.select("case_name", F.explode("must_not_find").alias("unwanted"))
    rows = found.select("case_name", "rule_id", "target_name", "sure_sev")
    named = (rows["case_name"] == unwanted["case_name"]) & rule_matches_col(F.col("rule_id"), F.col("unwanted"))
    listed = rows.join(unwanted, named, "left_semi").select("case_name", label.alias("label"))
    benign = cases.where(~F.col("malicious"))
    serious = rows.where(F.coalesce(F.col("sure_sev") >= 2, F.lit(False))).join(benign.select("case_name"), "case_name", "left_semi")
    fine = benign.select(
        F.col("case_name").alias("_case"),
        F.explode(F.concat(F.coalesce("allow", F.array().cast("array<string>")), F.coalesce("must_find", F.array().cast("array<string>")))).alias("_allowed"),
    )
    excused = (F.col("case_name") == F.col("_case")) & rule_matches_col(F.col("rule_id"), F.col("_allowed"))
    alarms = serious.join(fine, excused, "left_anti").select("case_name", label.alias("label"))
    return listed.unionByName(alarms).distinct()


def summarize(results: DataFrame) -> DataFrame:
    """One row of quality numbers over all cases; ratios with nothing below them are null."""
    bad, good = F.col("malicious"), ~F.col("malicious")
    tp = F.size("true_positives")
    agg = results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if(bad).alias("malicious_cases"),
        F.count_if(good).alias("benign_cases"), F.coalesce(F.sum(tp), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum("false_positive_count"), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum(F.size("false_negatives")), F.lit(0)).alias("false_negatives"),
        F.count_if(bad & F.col("flagged")).alias("_caught"), F.count_if(good & F.col("flagged")).alias("_false"),
        F.sum("confidence_sum").alias("_confidence"),
    )
    # Ratios in doubles with a half-up rounding rule, four digits.
    ratio = lambda top, bottom: F.round(F.try_divide(F.col(top).cast("double"), bottom.cast("double")), 4)
    detection = ratio("_caught", F.col("malicious_cases"))
    return agg.select(
        "cases", "passed", "malicious_cases", "benign_cases", "true_positives", "false_positives", "false_negatives",
        detection.alias("detection_rate"),
        ratio("true_positives", F.col("true_positives") + F.col("false_positives")).alias("precision"),
        ratio("true_positives", F.col("true_positives") + F.col("false_negatives")).alias("recall"),
        ratio("_false", F.col("benign_cases")).alias("false_positive_rate"),
        F.round(1 - detection, 4).alias("false_negative_rate"),
        F.round(F.try_divide(F.col("_confidence").cast("double"), F.col("true_positives").cast("double")), 3).alias("average_confidence"),
    )
