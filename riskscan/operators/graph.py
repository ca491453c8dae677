"""Reachability over edge tables: how far values and imports spread."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.operators.skew import broadcast_if_small, top_k, written

CHECKPOINT_EVERY = 3


def reach(
    edges: DataFrame, seeds: DataFrame, keep: Sequence[str] = ("origin",), max_rounds: int | None = None, every: int = CHECKPOINT_EVERY
) -> DataFrame:
    """Every (node, *keep, depth) reachable from the seeds, with the smallest depth.

    `edges(src, dst)`, `seeds(node, *keep)`. Each round joins only what the last round found
    for the first time. Rounds end when nothing new appears; `max_rounds` is for callers who
    want only what is near. Every few rounds the state is written to the shared folder, so
    lineage stays short and a lost executor repeats at most a few rounds.
    """
    e = edges.select("src", "dst").distinct()
    key = ["node", *keep]
    seen = written(seeds.select(*key).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if max_rounds is None else range(1, max_rounds + 1):
        step = (
            frontier.join(e, frontier["node"] == e["src"])
            .select(F.col("dst").alias("node"), *keep)
            .distinct()
            .join(seen.select(*key), key, "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = written(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % every == 0:
            seen = written(seen)
    return seen


def _doubled(steps: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """node, up, dist, low: how far the beginning of each node's chain is, by doubling the steps taken.

    `steps(node, up)` gives each node at most one node before it. `low` is the smallest node passed.
    The second value says whether nothing goes round: what does never ends, and its `low` is then
    the smallest node of its circle.
    """
    table = written(steps.select("node", "up", F.lit(1).cast("bigint").alias("dist"), F.least("node", "up").alias("low")))
    reached = 1
    while True:
        far = table.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("low").alias("_low"))
        both = table.join(far, table["up"] == far["_node"], "left")
        moved = F.col("_node").isNotNull()
        table = written(
            both.select(
                "node", F.coalesce("_up", "up").alias("up"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
                F.least("low", "_low").alias("low"), moved.alias("moved"),
            )
        )
        if table.where("moved").isEmpty():
            return table, True
        reached *= 2
        if reached > 2 * most:
            return table, False
        table = table.drop("moved")


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Chains of nodes that only lead on: (node, head, rank), and the edges between chains (head, at, dst, steps).

    `edges(src, dst)`, distinct, without loops. A step belongs to a chain if it is the only one out
    of its source and the only one into its target; a circle of such steps is cut before its smallest
    node. Every other edge leaves the last node of a chain, `at`, and enters the first of one. None
    if there is no chain. Rounds are as many as the logarithm of the longest chain.
    """
    single = lambda a: edges.groupBy(a).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(a)
    inner = written(edges.join(single("src"), "src").join(single("dst"), "dst").select("src", "dst"))
    size = inner.count()
    if size == 0:
        return None
    steps = inner.select(F.col("dst").alias("node"), F.col("src").alias("up"))
    found, ended = _doubled(steps, size)
    if not ended:
        cut = found.where("moved and node = low").select("node")
        steps = written(steps.join(cut, "node", "left_anti"))
        inner = steps.select(F.col("up").alias("src"), F.col("node").alias("dst"))
        found, _ = _doubled(steps, size)
    members = found.select("node", F.col("up").alias("head"), F.col("dist").alias("rank"))
    heads = members.select(F.col("head").alias("node")).distinct().select("node", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("rank"))
    members = written(members.unionByName(heads))
    between = edges.join(inner, ["src", "dst"], "left_anti")
    placed = between.join(members.withColumnRenamed("node", "src"), "src", "left")
    at = F.coalesce("rank", F.lit(0))
    return members, written(placed.select(F.coalesce("head", "src").alias("head"), at.alias("at"), "dst", (at + 1).alias("steps")))


def reach_by_chains(edges: DataFrame, seeds: DataFrame, keep: Sequence[str] = ("origin",)) -> DataFrame:
    """The same as `reach`, in as many rounds as there are branches on the way instead of steps.

    Chains are found first and passed at once; the rounds run over their first nodes only, and what
    was found is spread over the members of each chain at the end.
    """
    # Nodes and origins are numbers on the way: rounds move two numbers and a depth, names come back at the end.
    e = edges.select("src", "dst").where("src <> dst").distinct()
    begin = seeds.select("node", *keep).distinct()
    unnamed = begin.where("node is null")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).union(begin.select("node")).where("node is not null").distinct()
    nodes = written(nodes.withColumn("_id", F.monotonically_increasing_id()))
    origins = written(begin.select(*keep).distinct().withColumn("_origin", F.monotonically_increasing_id()))
    numbered = lambda c: broadcast_if_small(nodes.select(F.col("node").alias(c), F.col("_id").alias(f"_{c}")))
    e = e.join(numbered("src"), "src").join(numbered("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    same = F.lit(True)
    for c in keep:
        same = same & begin[c].eqNullSafe(origins[c])
    begin = begin.join(broadcast_if_small(origins), same).join(numbered("node"), "node").select(F.col("_node").alias("node"), "_origin")
    reached = _reach_numbers(written(e), written(begin))
    named = reached.withColumnRenamed("node", "_node").join(numbered("node"), "_node").join(broadcast_if_small(origins), "_origin")
    # A seed without a name leads nowhere; it has reached itself.
    return named.select("node", *keep, "depth").unionByName(unnamed.withColumn("depth", F.lit(0)))


def _reach_numbers(edges: DataFrame, seeds: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """`reach_by_chains` over numbers: `edges(src, dst)`, distinct, without loops, `seeds(node, _origin)`."""
    found = chains(edges)
    if found is None:
        return reach(edges, seeds, ["_origin"])
    members, links = found
    key = ["head", "_origin"]
    start = seeds.join(members, "node", "left")
    start = written(start.select(F.coalesce("head", "node").alias("head"), "_origin", F.coalesce("rank", F.lit(0)).cast("bigint").alias("at"), "node"))
    step = start.where("at > 0").select(*key, F.col("at").alias("_from")).join(links, "head")
    inside = step.select(F.col("dst").alias("head"), "_origin", (F.col("steps") - F.col("_from")).alias("depth"))
    first = start.where("at = 0").select(*key, F.lit(0).cast("bigint").alias("depth")).unionByName(inside)
    seen = frontier = written(first.groupBy(*key).agg(F.min("depth").alias("depth")))
    for turn in count(1):
        new = frontier.join(links, "head").select(F.col("dst").alias("head"), "_origin", (F.col("depth") + F.col("steps")).alias("depth"))
        new = new.groupBy(*key).agg(F.min("depth").alias("depth"))
        # What was reached before in as few steps is known; a nearer way is one more row, and the nearest counts at the end.
        old = seen.select(*[F.col(c).alias(f"_old_{c}") for c in key], F.col("depth").alias("_depth"))
        known = (new["head"] == old["_old_head"]) & (new["_origin"] == old["_old__origin"]) & (old["_depth"] <= new["depth"])
        frontier = written(new.join(old, known, "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if turn % every == 0:
            seen = written(seen)
    spread = seen.join(members, "head", "left").select(F.coalesce("node", "head").alias("node"), "_origin", (F.col("depth") + F.coalesce("rank", F.lit(0))).alias("depth"))
    late = start.where("at > 0").select(*key, "at").join(members, "head").where("rank >= at").select("node", "_origin", (F.col("rank") - F.col("at")).alias("depth"))
    return spread.unionByName(late).groupBy("node", "_origin").agg(F.min("depth").cast("int").alias("depth"))


def value_spread(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Which inputs reach which variables: sanitised assignments pass nothing on.

    `edges(src, dst, sanitized)`; `seeds(node, origin)`.
    """
    return reach(edges.where(~F.col("sanitized")), seeds, max_rounds=max_rounds)


def import_closure(edges: DataFrame, entries: DataFrame, limit: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """Files reached from entry files over local imports, nearest first.

    `edges(src, dst)`, `entries(node, origin)`. The whole closure, unless `limit` asks for the
    first files per entry by depth and name.
    """
    found = reach_by_chains(edges, entries) if max_rounds is None else reach(edges, entries, max_rounds=max_rounds)
    if limit is None:
        return found
    return top_k(found, ["origin"], [F.col("depth"), F.col("node")], limit, ["node"], rank="place").drop("place")


JS_IMPORT = r"(?:from\s+|require\(\s*|import\s*\(\s*|import\s+)['\"](\.{1,2}/[^'\"]+)['\"]"
PY_IMPORT = r"(?m)^\s*import\s+([\w.]+)"
PY_FROM = r"(?m)^\s*from\s+(\.*[\w.]*)\s+import\s+\(?([\w ,]+)"
JS_ENDINGS = ("", ".js", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", ".jsx", "/index.js", "/index.ts")


def _joined(folder, rest):
    """A relative path from a folder, with every "." and ".." resolved."""
    steps = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), rest), "/")
    none = F.array().cast("array<string>")

    def walk(done, step):
        up = (step == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        kept = F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(step)))
        return F.when(step.isin("", "."), done).otherwise(kept)

    return F.array_join(F.aggregate(steps, none, walk), "/")


def import_edges(files: DataFrame) -> DataFrame:
    """Local import edges between the files of a project: (server_id, src, dst).

    `files(server_id, path, language, text)`. Candidate targets are joined with the file
    table, so only files that exist become edges; the first ending that exists wins.
    """
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    js = files.where(F.col("language") == "javascript").select(
        "server_id", F.col("path").alias("src"),
        F.explode(F.regexp_extract_all("text", F.lit(JS_IMPORT))).alias("spec"), folder.alias("folder"),
    )
    js = js.select(
        "server_id", "src", F.col("spec"),
        F.posexplode(F.array(*[F.concat(_joined(F.col("folder"), F.col("spec")), F.lit(x)) for x in JS_ENDINGS])).alias("place", "dst"),
    )
    # TypeScript code names the built ".js" file for a ".ts" source.
    alt = js.where(F.col("dst").endswith(".js") & (F.col("place") == 0)).select(
        "server_id", "src", "spec", F.lit(50).alias("place"), F.regexp_replace("dst", r"\.js$", ".ts").alias("dst")
    )
    py_files = files.where(F.col("language") == "python").withColumn("folder", folder)
    froms = F.transform(
        F.regexp_extract_all("text", F.lit(PY_FROM), F.lit(1)),
        lambda m, i: F.concat(
            F.array(m),
            F.transform(
                F.split(F.get(F.regexp_extract_all(F.col("text"), F.lit(PY_FROM), F.lit(2)), i), ","),
                lambda n: F.concat_ws(".", F.nullif(m, F.lit("")), F.regexp_extract(n, r"\w+", 0)),
            ),
        ),
    )
    modules = F.concat(F.regexp_extract_all("text", F.lit(PY_IMPORT)), F.flatten(froms))
    py = py_files.select("server_id", F.col("path").alias("src"), "folder", F.explode(F.array_distinct(modules)).alias("spec"))
    rel = F.replace(F.ltrim(F.col("spec"), F.lit(".")), F.lit("."), F.lit("/"))
    near, root = F.concat_ws("/", F.nullif("folder", F.lit("")), rel), rel
    py = py.where(rel != "").select(
        "server_id", "src", "spec",
        F.posexplode(F.array(*[F.concat(b, F.lit(x)) for b in (near, root) for x in (".py", "/__init__.py")])).alias("place", "dst"),
    )
    every = js.unionByName(alt).unionByName(py)
    known = files.select("server_id", F.col("path").alias("dst"))
    hit = every.join(known, ["server_id", "dst"])
    first = hit.groupBy("server_id", "src", "spec").agg(F.min_by("dst", "place").alias("dst"))
    return first.where(F.col("src") != F.col("dst")).select("server_id", "src", "dst").distinct()
