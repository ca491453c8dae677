"""Merging, validating and scoring, with line items in the role of candidates.

A line item becomes one candidate: rule from flag, status and line number; target from the
part; server from the supplier; severity and confidence from quantity and discount.
"""

from __future__ import annotations

from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.operators import evals as E
from riskscan.operators import findings as V
from riskscan.operators import score as SC
from riskscan.operators import summary as SU
from riskscan.operators.skew import written
from riskscan.rules import user_rules as U
from riskscan.schemas import CANDIDATE_SCHEMA, conform
from riskscan.sinks import reports as K
from workloads import query, table

RULE = "concat(l_returnflag, l_linestatus, '-', cast(l_linenumber as string))"
SEVERITY = (
    "case when l_quantity >= 48 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 20 then 'medium' "
    "when l_quantity >= 8 then 'low' else 'info' end"
)
CONFIDENCE = "case when l_discount >= 0.07 then 'high' when l_discount >= 0.03 then 'medium' else 'low' end"
CATEGORY = "case l_linenumber % 4 when 0 then 'network' when 1 then 'command-execution' when 2 then 'code-execution' else 'data-exfiltration' end"
# A finding's evidence is mostly of one kind; now and then, often far behind the first five pieces, there is other.
KIND = "case when l_orderkey % 37 = 5 then 'source-code' when l_linenumber % 3 = 0 then 'source-code' when l_linenumber % 3 = 1 then 'text-match' else 'schema' end"
CONTEXT = "case when l_orderkey % 9 = 0 then 'it does not ' when l_orderkey % 9 = 1 then 'it will not. Then ' else 'it may ' end"
TARGET = "concat('p', cast(l_partkey % 400 as string))"

CANDIDATES_SQL = f"""
    c as (select 's' || cast(l_suppkey as varchar) as server_id, l_orderkey as seq,
                 l_returnflag || l_linestatus || '-' || cast(l_linenumber as varchar) as rule_id,
                 'p' || cast(l_partkey % 400 as varchar) as target,
                 {SEVERITY} as severity, {CONFIDENCE} as confidence, {CATEGORY} as category, {KIND} as kind, {CONTEXT} as context,
                 'order ' || cast(l_orderkey % 1000 as varchar) as location, 'q' || cast(cast(l_quantity as integer) as varchar) as snippet,
                 l_orderkey % 17 = 0 as confirmed, l_orderkey % 5 = 0 as malicious
          from lineitem),
    r as (select *, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end as sev,
                 case confidence when 'high' then 2 when 'medium' then 1 else 0 end as conf from c)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    evidence = F.array(
        F.struct(
            F.expr(KIND).alias("kind"), F.concat(F.lit("order "), (F.col("l_orderkey") % 1000).cast("string")).alias("location"),
            F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("snippet"), F.lit("").alias("detail"),
        )
    )
    rows = li.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("server_id"), F.col("l_orderkey").alias("seq"),
        F.expr(RULE).alias("rule_id"), F.lit("Line").alias("title"), F.expr(SEVERITY).alias("severity"),
        F.expr(CONFIDENCE).alias("confidence"), F.expr(CATEGORY).alias("category"), F.lit("A line item.").alias("description"),
        evidence.alias("evidence"), F.lit("tool").alias("target_kind"), F.expr(TARGET).alias("target_name"),
        (F.col("l_orderkey") % 17 == 0).alias("confirmed"), (F.col("l_orderkey") % 5 == 0).alias("malicious"),
        F.expr(CONTEXT).alias("context_text"),
    )
    return conform(rows, CANDIDATE_SCHEMA)


MERGED_SQL = f"""
    with {CANDIDATES_SQL},
    m as (select server_id, rule_id, target, max(sev) as sev, max(conf) as conf, bool_or(confirmed) as confirmed, bool_or(malicious) as malicious,
                 min((seq, location, category, context)) as head, count(*) as n
          from r group by all)
"""


@query(
    "finding_merge",
    MERGED_SQL
    + """
    select server_id, rule_id, target as target_name, sev as sev_rank, conf as conf_rank, confirmed, malicious,
           'F-' || left(sha256(server_id || '|' || rule_id || '|tool|' || target || '|' || head[2]), 10) as id
    from m
    """,
)
def finding_merge(spark, sf_dir):
    """AGG-01, SCL-10: candidates merged, with stable ids."""
    return V.to_findings(candidates(spark, sf_dir), evidence=False).select(
        "server_id", "rule_id", "target_name", "sev_rank", "conf_rank", "confirmed", "malicious", "id"
    )


@query(
    "top_evidence",
    f"""
    with {CANDIDATES_SQL},
    d as (select server_id, rule_id, target, location, snippet, min(seq) as seq from r group by all),
    k as (select *, row_number() over (partition by server_id, rule_id, target order by seq, location, snippet) as rn from d)
    select server_id, rule_id, target as target_name, rn as place, location, snippet from k where rn <= 5
    """,
)
def top_evidence(spark, sf_dir):
    """SRT-03: the first five distinct pieces of evidence."""
    merged = V.merge(candidates(spark, sf_dir))
    rows = merged.select("server_id", "rule_id", "target_name", F.posexplode("evidence").alias("pos", "e"))
    return rows.select(
        "server_id", "rule_id", "target_name", (F.col("pos") + 1).cast("bigint").alias("place"), "e.location", "e.snippet"
    )


STATUS_SQL = (
    MERGED_SQL
    + """,
    k as (select server_id, rule_id, target, bool_or(kind in ('text-match', 'schema')) as meta, bool_or(kind = 'source-code') as code from r group by all),
    f as (select m.*, m.head[3] as category, k.meta, k.code,
                 not m.confirmed and regexp_matches(list_extract(string_split_regex(m.head[4], '[.!?;:\\n]'), -1), '(?i)\\b(?:not)\\b(?:\\W+\\w+){0,3}\\W*$') as negated
          from m join k using (server_id, rule_id, target)),
    b as (select f.server_id, f.rule_id, f.target, min(o.rule_id) as backer
          from f join f o on f.server_id = o.server_id and f.target = o.target and f.rule_id <> o.rule_id
            and not f.negated and not o.negated
            and (f.category = o.category or (f.category in ('command-execution', 'code-execution') and o.category in ('command-execution', 'code-execution'))
                 or (f.category in ('network', 'data-exfiltration') and o.category in ('network', 'data-exfiltration')))
            and ((f.meta and o.code) or (f.code and o.meta))
          group by all),
    g as (select f.*, b.backer, least(f.conf + case when b.backer is null then 0 else 1 end, 2) as conf2 from f left join b using (server_id, rule_id, target)),
    st as (select *, case when negated then 'likely-false-positive' when confirmed then 'confirmed' when conf2 = 2 then 'validated' else 'unverified' end as status from g)
"""
)


@query(
    "corroborated_status",
    STATUS_SQL
    + """
    select server_id, rule_id, target as target_name, conf2 as conf_rank, status, malicious and not negated as malicious,
           coalesce(case when backer is not null then 'Seen from another side too: ' || backer || '.' end, '') as backed
    from st
    """,
)
def corroborated_status(spark, sf_dir):
    """JOIN-08, FLT-09 and the status, without forming pairs of findings."""
    found = V.validate(candidates(spark, sf_dir), evidence=False)
    backed = F.coalesce(F.get(F.filter("notes", lambda n: n.startswith("Seen from another side too")), F.lit(0)), F.lit(""))
    return found.select("server_id", "rule_id", "target_name", "conf_rank", "status", "malicious", backed.alias("backed"))


SUPPRESSIONS = (
    V.Suppression("AF-1", "old exception", expires=date(2020, 1, 1)),
    V.Suppression("AF", "returned lines", server="s1*"),
    V.Suppression("*-2", "second lines", target="p1?"),
    V.Suppression("RF-1", "known"),
)


@query(
    "suppressed",
    """
    with m as (select distinct 's' || cast(l_suppkey as varchar) as server_id, l_returnflag || l_linestatus || '-' || cast(l_linenumber as varchar) as rule_id,
                      'p' || cast(l_partkey % 400 as varchar) as target from lineitem)
    select server_id, rule_id, target as target_name,
           case when rule_id like 'AF-%' and server_id like 's1%' then 'returned lines'
                when rule_id like '%-2' and target like 'p1_' then 'second lines'
                when rule_id = 'RF-1' then 'known' end as reason,
           rule_id = 'AF-1' as had_expired
    from m
    """,
)
def suppressed(spark, sf_dir):
    """JOIN-07, SCL-18/27: globs in order, expired ones leave a note."""
    found = V.suppress(V.to_findings(candidates(spark, sf_dir), evidence=False), SUPPRESSIONS, date(2026, 1, 1))
    reason = F.regexp_extract(F.element_at("notes", -1), "^Suppressed: (.*)$", 1)
    return found.select(
        "server_id", "rule_id", "target_name", F.when(F.col("status") == "suppressed", reason).alias("reason"),
        F.exists("notes", lambda n: n.contains("expired")).alias("had_expired"),
    )


POINTS_SQL = (
    STATUS_SQL
    + """,
    a as (select *, status = 'confirmed' as proven from st where status <> 'likely-false-positive'),
    p as (select *, cast(case sev when 4 then 40 when 3 then 20 when 2 then 8 when 1 then 3 else 0 end
                         * case when proven then 1 when conf2 = 2 then 1 when conf2 = 1 then 0.6 else 0 end as decimal(18,4)) as full_points from a),
    o as (select *, row_number() over w as rn, first_value(full_points) over w as first_points from p
          window w as (partition by server_id, rule_id order by sev desc, conf2 desc, target)),
    q as (select *, case when rn = 1 then full_points else round(full_points * 0.25, 2) end as raw from o),
    u as (select *, least(sum(raw) over (partition by server_id, rule_id order by sev desc, conf2 desc, target rows unbounded preceding), first_points * 1.5) as upto from q)
"""
)


@query(
    "rule_points",
    POINTS_SQL
    + """
    select server_id, rule_id, cast(max(upto) as double) as points, count(*) as findings from u group by all
    """,
)
def rule_points(spark, sf_dir):
    """WIN-01/02, AGG-10: the capped total of every rule, from a handful of cells."""
    found = V.validate(candidates(spark, sf_dir), evidence=False)
    return SC.rule_points(found).select("server_id", "rule_id", F.col("points").cast("double").alias("points"), "findings")


@query(
    "finding_points_total",
    POINTS_SQL
    + """
    select server_id, rule_id, sev as sev_rank, conf2 as conf_rank, status, cast(count(*) as bigint) as findings,
           cast(sum(upto - coalesce(prev, 0)) as double) as points
    from (select *, lag(upto) over (partition by server_id, rule_id order by sev desc, conf2 desc, target) as prev from u) group by all
    having true
    """,
)
def finding_points_total(spark, sf_dir):
    """Points of single findings, summed per severity, confidence and status."""
    found = V.validate(candidates(spark, sf_dir), keep=written, evidence=False)
    points = SC.finding_points(found).where("status <> 'likely-false-positive'")
    return points.groupBy("server_id", "rule_id", "sev_rank", "conf_rank", "status").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("risk_points").cast("double").alias("points")
    )


@query(
    "server_score",
    POINTS_SQL
    + """,
    t as (select server_id, sum(points) as total from (select server_id, rule_id, max(upto) as points from u group by all) group by all),
    z as (select st.server_id, bool_or(status in ('confirmed', 'validated') and sev >= 3) as strong,
                 bool_or(malicious and not negated and status = 'confirmed') as bad,
                 cast(count(*) filter (status <> 'likely-false-positive' and conf2 = 0) as bigint) as possible from st group by all),
    x as (select z.*, least(round(coalesce(total, 0), 1), 100) as raw from z left join t using (server_id)),
    y as (select *, case when bad then 100 when raw >= 60 and not strong then 59 else raw end as score from x)
    select server_id, cast(score as double) as score,
           case when bad then 'F' when score < 0.001 then 'A' when score < 15 then 'B' when score < 35 then 'C' when score < 60 then 'D' else 'F' end as grade,
           possible
    from y
    """,
)
def server_score(spark, sf_dir):
    """AGG-08/09: score and grade per server."""
    found = V.validate(candidates(spark, sf_dir), keep=written, evidence=False)
    scores = SC.server_scores(found)
    facts = SC.server_facts(found).select("server_id", "possible")
    return scores.join(facts, "server_id").select("server_id", F.col("score").cast("double").alias("score"), "grade", "possible")


COUNTS = ", ".join(
    f"cast(count(*) filter (status <> 'likely-false-positive' and sev = {r}) as bigint) as {n}"
    for r, n in ((4, "critical"), (3, "high"), (2, "medium"), (1, "low"), (0, "info"))
)


@query(
    "severity_rollup",
    STATUS_SQL + f"select coalesce(server_id, 'all') as server_id, {COUNTS} from st group by rollup(server_id)",
)
def severity_rollup(spark, sf_dir):
    """AGG-02/03: counts per server and for all."""
    found = V.validate(candidates(spark, sf_dir), evidence=False)
    return SU.severity_counts(found).select(
        F.coalesce("server_id", F.lit("all")).alias("server_id"), "critical", "high", "medium", "low", "info"
    )


@query(
    "gate_code",
    STATUS_SQL
    + """
    , top as (select max(sev) filter (status <> 'likely-false-positive') as sev from st),
    run as (select *, case sev when 4 then 'critical' when 3 then 'high' when 2 then 'medium' when 1 then 'low' else 'info' end as worst from top)
    select 'from high' as run, cast(case when sev >= 3 then 1 else 0 end as integer) as code, worst from run
    union all select 'never', 0, worst from run
    union all select 'partial', 2, worst from run
    union all select 'partial, from critical', case when sev >= 4 then 1 else 2 end, worst from run
    union all select 'failed', 2, worst from run
    """,
)
def gate_code(spark, sf_dir):
    """SNK-08, AGG-03/04: the exit code for several thresholds and outcomes of a run."""
    found = V.validate(candidates(spark, sf_dir), keep=written, evidence=False)
    servers = found.select("server_id").distinct()
    got, lost = servers.withColumn("got_inventory", F.lit(True)), servers.withColumn("got_inventory", F.lit(False))
    none = spark.createDataFrame([], "server_id string, stage string")
    hard = servers.limit(1).withColumn("stage", F.lit("connect"))
    done, partial, failed = (SC.report_status(SC.scan_status(s, e)) for s, e in ((got, none), (got, hard), (lost, none)))
    runs = (("from high", done, "high"), ("never", done, None), ("partial", partial, None), ("partial, from critical", partial, "critical"), ("failed", failed, "low"))
    rows = [SU.gate(found, status, fail_on).select(F.lit(name).alias("run"), "code", F.col("worst_severity").alias("worst")) for name, status, fail_on in runs]
    return reduce(DataFrame.unionByName, rows)


@query(
    "rule_select",
    """
    select l_returnflag || l_linestatus || '-' || cast(l_linenumber as varchar) as rule_id, cast(count(*) as bigint) as candidates
    from lineitem
    where (l_returnflag || l_linestatus = 'AF' or l_linenumber = 3 or (l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber = 1))
      and not (l_returnflag || l_linestatus = 'RF')
    group by all
    """,
)
def rule_select(spark, sf_dir):
    """FLT-03: exact id, glob and prefix, any letter case."""
    rows = candidates(spark, sf_dir).select("rule_id")
    chosen = U.select_rules(rows, ["af", "*-3", "NO-1"], ["RF-*"])
    return chosen.groupBy("rule_id").agg(F.count(F.lit(1)).alias("candidates"))


# ---- evaluation: labelled documents ----------------------------------------------------------------


def eval_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id")
    name = F.col("doc_id").cast("string")
    cases = labels.select(
        name.alias("case_name"), (F.col("toxic") == 1).alias("malicious"),
        F.when(F.col("toxic") == 1, F.array(F.lit("LEN"), F.lit("LINE-001"))).otherwise(F.array().cast("array<string>")).alias("must_find"),
        F.when(F.col("quality") == 0, F.array(F.lit("MAIL-*"))).otherwise(F.array().cast("array<string>")).alias("must_not_find"),
        F.lit(None).cast("string").alias("min_grade"), F.when(F.col("toxic") == 0, "C").alias("max_grade"),
        F.array(F.lit("LINE")).alias("allow"),
    )
    bodies = [
        (F.col("n_chars") > 2000, "LEN-001", 3, 2), (F.col("text").contains("\n"), "LINE-001", 2, 1), (F.col("text").contains("@"), "MAIL-001", 2, 2),
    ]
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("sev_rank"), F.lit(k).alias("conf_rank"))) for c, r, s, k in bodies])
    )
    findings = docs.select(name.alias("case_name"), F.explode(found).alias("f")).select(
        "case_name", F.lit("d").alias("server_id"), "f.rule_id", F.lit("text").alias("target_name"), "f.sev_rank", "f.conf_rank",
        F.lit("validated").alias("status"),
    )
    grade = F.when(F.col("n_chars") > 6000, "F").when(F.col("n_chars") > 2000, "C").otherwise("B")
    grades = docs.select(name.alias("case_name"), F.lit("d").alias("server_id"), grade.alias("grade"), F.col("n_chars").cast("decimal(18,1)").alias("score"))
    return cases, findings, grades


EVAL_SQL = """
    with d as (select l.*, n_chars, n_chars > 2000 as len, contains(text, chr(10)) as line, contains(text, '@') as mail,
                      case when n_chars > 6000 then 'F' when n_chars > 2000 then 'C' else 'B' end as grade
               from labels l join documents using (doc_id)),
    j as (select doc_id, toxic = 1 as malicious, grade, n_chars,
                 case when toxic = 1 then len::int + line::int else 0 end as tp,
                 case when toxic = 1 then (not len)::int + (not line)::int else 0 end as fn,
                 (mail and (quality = 0 or toxic = 0))::int + (len and toxic = 0)::int as fp,
                 case when toxic = 1 then len::int * 1.0 + line::int * 0.6 else 0 end as conf,
                 (toxic = 0 and grade = 'F') as problem, len or grade in ('D', 'F') as flagged from d)
"""


@query(
    "eval_case_verdicts",
    EVAL_SQL
    + """
    select cast(doc_id as varchar) as case_name, malicious, grade, cast(n_chars as double) as score, cast(tp as integer) as tp, cast(fn as integer) as fn,
           cast(fp as bigint) as fp, problem, flagged, fn = 0 and fp = 0 and not problem as passed from j
    """,
)
def eval_case_verdicts(spark, sf_dir):
    """JOIN-20, AGG-12/13: every labelled document as a case."""
    return E.judge(*eval_tables(spark, sf_dir)).select(
        "case_name", "malicious", "grade", F.col("score").cast("double").alias("score"), F.size("true_positives").alias("tp"),
        F.size("false_negatives").alias("fn"), F.col("false_positive_count").alias("fp"), (F.size("problems") > 0).alias("problem"),
        "flagged", "passed",
    )


@query(
    "eval_summary",
    EVAL_SQL
    + """
    select count(*) as cases, count(*) filter (fn = 0 and fp = 0 and not problem) as passed, count(*) filter (malicious) as malicious_cases,
           count(*) filter (not malicious) as benign_cases, cast(sum(tp) as bigint) as true_positives, cast(sum(fp) as bigint) as false_positives,
           cast(sum(fn) as bigint) as false_negatives,
           round(count(*) filter (malicious and flagged)::double / nullif(count(*) filter (malicious), 0), 4) as detection_rate,
           round(sum(tp)::double / nullif(sum(tp) + sum(fp), 0), 4) as "precision", round(sum(tp)::double / nullif(sum(tp) + sum(fn), 0), 4) as recall,
           round(count(*) filter (not malicious and flagged)::double / nullif(count(*) filter (not malicious), 0), 4) as false_positive_rate,
           round(1 - round(count(*) filter (malicious and flagged)::double / nullif(count(*) filter (malicious), 0), 4), 4) as false_negative_rate,
           round(sum(conf)::double / nullif(sum(tp), 0)::double, 3) as average_confidence
    from j
    """,
)
def eval_summary(spark, sf_dir):
    """AGG-11."""
    return E.summarize(E.judge(*eval_tables(spark, sf_dir)))


# ---- report rows ---------------------------------------------------------------------------------


@query(
    "sarif_rows",
    STATUS_SQL
    + """
    select server_id, rule_id, target as target_name,
           case sev when 4 then 'error' when 3 then 'error' when 2 then 'warning' else 'note' end as level,
           '[' || server_id || '] A line item.' as message, status = 'likely-false-positive' as is_suppressed from st
    """,
)
def sarif_rows(spark, sf_dir):
    """SNK-02: one result object per finding."""
    found = V.validate(candidates(spark, sf_dir))
    rows = K.sarif_results(found).select("server_id", "rule_id", F.parse_json("value").alias("v"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    return rows.select(
        "server_id", "rule_id", F.substring_index(at("$.properties.target"), " ", -1).alias("target_name"), at("$.level").alias("level"),
        at("$.message.text").alias("message"), at("$.suppressions", "variant").isNotNull().alias("is_suppressed"),
    )


@query(
    "severity_overview",
    STATUS_SQL
    + f"select server_id, {COUNTS} from st where status <> 'likely-false-positive' group by all",
)
def severity_overview(spark, sf_dir):
    """SNK-04: the grid of servers by severity."""
    return K.overview(V.validate(candidates(spark, sf_dir), evidence=False))


@query(
    "markdown_lines",
    POINTS_SQL
    + """,
    paid as (select server_id, rule_id, target, upto - coalesce(lag(upto) over (partition by server_id, rule_id order by sev desc, conf2 desc, target), 0) as points from u),
    n as (select server_id, count(*) filter (status <> 'likely-false-positive') as active, count(*) filter (status = 'likely-false-positive') as other from st group by all),
    w as (select server_id, count(*) as n from paid where points > 0 group by all)
    select 0 as section, '' as server_id, -1 as part, 1 as lines
    union all select 0, server_id, 0, 1 from n
    union all select 1, server_id, 0, 1 from n
    union all select 1, server_id, 1, 1 from n
    union all select 1, server_id, 2, active from n where active > 0
    union all select 1, server_id, 3, 1 from n where other > 0
    union all select 1, server_id, 4, other from n where other > 0
    union all select 1, server_id, 5, 1 from w
    union all select 1, server_id, 6, n from w
    """,
)
def markdown_lines(spark, sf_dir):
    """SNK-03: the lines of the Markdown report by section and server, the head of its table among them."""
    small = partial(written, compression="zstd")
    found = small(SC.finding_points(V.validate(candidates(spark, sf_dir), keep=small)))
    scores = SC.server_scores(found)
    rows = K.markdown_rows(found, SU.server_summary(found, scores.select("server_id", "status")), scores)
    return rows.groupBy("section", "server_id", "part").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "sarif_logs",
    STATUS_SQL
    + f"""
    , sizes as (select server_id, count(*) as n from st group by all),
    chunks as (select server_id, n, unnest(range(cast(ceil(n / {K.RESULTS_PER_RUN}) as bigint))) as chunk from sizes)
    select server_id, cast(chunk as integer) as chunk, cast(least({K.RESULTS_PER_RUN}, n - chunk * {K.RESULTS_PER_RUN}) as integer) as results from chunks
    """,
)
def sarif_logs(spark, sf_dir):
    """SNK-02: whole logs; each is full but the last of a server, none is over the bound."""
    found = V.validate(candidates(spark, sf_dir), keep=written)
    logs = K.sarif_documents(found, "riskscan").select("server_id", "chunk", F.parse_json("value").alias("v"))
    results = F.try_variant_get("v", "$.runs[0].results", "array<variant>")
    return logs.select("server_id", "chunk", F.size(results).alias("results"))
