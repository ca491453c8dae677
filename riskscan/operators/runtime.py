"""Facts seen while a server ran: planted values, files, processes, connections, limits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskscan.functions import secrets as S
from riskscan.functions import urls as U
from riskscan.functions.packages import command_basename
from riskscan.operators.skew import split_lag, split_running

# Program names.
SHELLS = ("sh", "bash", "zsh", "dash", "fish", "cmd", "powershell", "pwsh")
NETWORK_PROGRAMS = (
    "curl", "wget", "nc", "ncat", "netcat", "socat", "ssh", "scp", "certutil", "bitsadmin", "mshta", "rundll32", "regsvr32",
    "wscript", "cscript", "nslookup", "dig", "telnet", "ftp", "tftp",
)
PACKAGE_LAUNCHERS = ("npx", "bunx", "pnpx", "npm", "pnpm", "yarn", "uvx", "uv", "pipx", "docker", "podman")
# Fixed values, the earlier ones and the line feed: signs with which a shell line starts more than one program, sends output elsewhere or fills in other text.
SHELL_SIGNS = ("\n", "$", "&", ";", "<", ">", "`", "|")
#: Programs that bring in or unpack what could be run next.
FETCH_WORDS = ("aria2c", "base64", "certutil", "curl", "fetch", "invoke-restmethod", "invoke-webrequest", "irm", "iwr", "powershell", "pwsh", "wget", "xxd")
SHELL_OPTIONS = ("-c", "/c", "/d", "/s")
# Places below the home folder that hold credentials or start programs.
SENSITIVE_WRITES = (
    "home/.ssh/", "home/.bashrc", "home/.zshrc", "home/.profile", "home/.bash_profile", "home/.zprofile", "home/.aws/",
    "home/.config/autostart", "home/.config/systemd", "home/library/launchagents",
    "home/appdata/roaming/microsoft/windows/start menu/programs/startup", "home/.gitconfig", "home/.npmrc", "home/.pypirc",
    "home/.docker/config.json", "home/.kube/", "home/.cursor/", "home/.claude", "home/.env", "home/.config/gh/",
)
STARTUP_WRITES = (
    "authorized_keys", ".bashrc", ".zshrc", ".profile", ".bash_profile", "autostart", "launchagents", "startup", "systemd",
)
# Where package managers and compilers keep what they fetched or built. The earlier list and two places more.
CACHE_PREFIXES = (
    "home/.cache/", "home/Library/Caches/", "home/AppData/Local/npm-cache/", "home/AppData/Local/pip/cache/", "home/AppData/Local/uv/",
    "home/.bun/install/", "home/.npm/", "home/.yarn/", "home/.local/share/pnpm/", "home/.local/share/uv/", "deps/", "tmp/node-compile-cache/",
)
OFFLINE = (
    r"(?i)fetch failed|ENOTFOUND|EAI_AGAIN|getaddrinfo|Name or service not known|Temporary failure in name resolution"
    r"|Network is unreachable|Failed to establish a new connection|ConnectError|Could not resolve host"
)


#: Characters of a planted value that texts are searched for first, and how many different ones that may be.
HEAD, MAX_HEADS = 4, 64


def planted_locations(places: DataFrame, planted: DataFrame) -> DataFrame:
    """Places where a planted value came back: one row per (server_id, location).

    `places(server_id, location, text)`, `planted(server_id, value)`. Texts are not shuffled: first
    they are tested, in their rows, for anything that begins like a planted value; only what begins
    so, with its place, meets the values of its server. Values are distinct per server.
    """
    values = planted.where(F.col("value") != "").select("server_id", "value").distinct()
    heads = values.select(F.left("value", F.lit(HEAD)).alias("head"), F.char_length("value").alias("size")).distinct()
    # Planted values are made from a few forms, so heads are few; a table of many stays a join on the server.
    few = [(r["head"], r["size"]) for r in heads.limit(MAX_HEADS + 1).collect()]
    if not few or len(few) > MAX_HEADS:
        hit = places.join(values, "server_id").where(F.contains("text", F.col("value")))
        return hit.select("server_id", "location").distinct()
    found = []
    for head, size in few:
        pieces = F.split("text", re.escape(head), -1)
        tails = F.slice(pieces, F.lit(2), F.size(pieces) + 1)
        # What follows a head may go on in the next piece if the head occurs twice in a row.
        whole = F.transform(tails, lambda t, i: F.left(F.concat(F.lit(head), F.array_join(F.slice(tails, i + 1, F.lit(size)), head)), F.lit(size)))  # noqa: B023
        found.append(F.when(F.contains("text", F.lit(head)), whole).otherwise(F.array().cast("array<string>")))
    seen = places.select("server_id", "location", F.explode(F.array_distinct(F.concat(*found))).alias("value"))
    return seen.join(values, ["server_id", "value"], "left_semi").select("server_id", "location").distinct()


def places_of(surfaces: DataFrame, tool_calls: DataFrame | None = None, tools: DataFrame | None = None) -> DataFrame:
    """Every place a planted value may come back in: texts, call errors, whole definitions."""
    found = surfaces.select("server_id", "location", "text")
    if tool_calls is not None:
        where = F.concat(F.lit("tool "), F.col("tool"), F.lit(" > call error"))
        found = found.unionByName(
            tool_calls.where(F.col("error").isNotNull()).select("server_id", where.alias("location"), F.col("error").alias("text"))
        )
    if tools is not None:
        where = F.concat(F.lit("tool "), F.col("name"), F.lit(" > definition"))
        found = found.unionByName(tools.select("server_id", where.alias("location"), F.to_json("raw").alias("text")))
    return found


def scrub(text: Column, planted: Column) -> Column:
    """Text without planted values (an array) and without secrets."""
    no_planted = F.aggregate(
        F.filter(planted, lambda v: v != ""), text, lambda acc, v: F.replace(acc, v, F.lit("[planted secret]"))
    )
    return S.redact(F.coalesce(no_planted, text))


def scrubbed_calls(tool_calls: DataFrame, planted: DataFrame) -> DataFrame:
    """Tool calls as they may be reported. The few planted values of a server travel as an array."""
    values = planted.groupBy("server_id").agg(F.collect_set("value").alias("_values"))
    rows = tool_calls.join(values, "server_id", "left").withColumn(
        "_values", F.coalesce("_values", F.array().cast("array<string>"))
    )
    return (
        rows.withColumn("output_text", scrub(F.col("output_text"), F.col("_values")))
        .withColumn("error", scrub(F.col("error"), F.col("_values")))
        .drop("_values")
    )


def changed_files(listing: DataFrame, ignore: Sequence[str] = CACHE_PREFIXES) -> DataFrame:
    """Files that are new or differ after a run: `listing(server_id, phase, path, mtime, size)`."""
    side = lambda phase: listing.where(F.col("phase") == phase).select("server_id", "path", "mtime", "size")
    changed = side("after").exceptAll(side("before"))
    cached = F.lit(False)
    for prefix in ignore:
        cached = cached | F.col("path").startswith(prefix)
    return changed.where(~cached)


def sensitive_writes(changed: DataFrame) -> DataFrame:
    lower = F.lower("path")
    hit, startup = F.lit(False), F.lit(False)
    for prefix in SENSITIVE_WRITES:
        hit = hit | lower.startswith(prefix)
    for word in STARTUP_WRITES:
        startup = startup | lower.contains(word)
    return changed.where(hit).withColumn("persistence", startup)


def is_launcher_shim(cmdline: Column) -> Column:
    """A shell that package runners put before one program: shell, its options, a program, plain options."""
    words = F.filter(F.split(F.translate(cmdline, "\"'", "  "), r"\s+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    shell = command_basename(F.get(words, F.lit(0))).isin("cmd", "sh")
    # The words after the shell's own options.
    rest = F.filter(F.slice(low, F.lit(2), F.size(low) + 1), lambda w: ~w.isin(*SHELL_OPTIONS))
    said = F.size(F.array_intersect(low, F.array(F.lit("-c"), F.lit("/c")))) > 0
    plain = F.forall(F.slice(rest, F.lit(2), F.size(rest) + 1), lambda w: w.startswith("-"))
    tricky = F.lit(False)
    for sign in SHELL_SIGNS:
        tricky = tricky | cmdline.contains(sign)
    fetches = F.exists(low, lambda w: command_basename(w).isin(*FETCH_WORDS) | w.contains("://"))
    return F.coalesce(shell & said & (F.size(rest) > 0) & plain & ~tricky & ~fetches, F.lit(False))


def suspicious_processes(events: DataFrame) -> DataFrame:
    """Shells and network programs a server started: `events(server_id, ts, pid, name, cmdline, phase)`."""
    program = command_basename(F.col("name"))
    network = program.isin(*NETWORK_PROGRAMS)
    late_shell = program.isin(*SHELLS) & (F.col("phase") != "startup") & ~is_launcher_shim(F.col("cmdline"))
    return events.withColumn("program", program).withColumn("is_network", network).where(network | late_shell)


def first_per_program(suspicious: DataFrame) -> DataFrame:
    """The first start of each program per server."""
    rest = F.struct("ts", "pid", "cmdline", "phase", "is_network")
    first = suspicious.groupBy("server_id", "program").agg(F.min_by(rest, F.struct("ts", "pid")).alias("f"))
    return first.select("server_id", "program", "f.*")


def outside_connections(events: DataFrame, servers: DataFrame | None = None) -> DataFrame:
    """Connections that leave the machine: `events(server_id, ts, remote_address, phase)`.

    What package launchers fetch at startup is expected and left out.
    """
    host = F.btrim(F.regexp_replace("remote_address", r":[^:]*$", ""), F.lit("[]"))
    away = events.where(F.col("remote_address").isNotNull() & ~U.is_own_machine(host))
    if servers is None:
        return away
    launchers = servers.select(
        "server_id", F.coalesce(command_basename(F.col("command")).isin(*PACKAGE_LAUNCHERS), F.lit(False)).alias("_fetches")
    )
    joined = away.join(launchers, "server_id", "left")
    return joined.where(~((F.col("phase") == "startup") & F.coalesce("_fetches", F.lit(False)))).drop("_fetches")


def address_summary(outside: DataFrame, shown: int = 5) -> DataFrame:
    """Per server the number of distinct outside addresses and the first few with their phase."""
    from riskscan.operators.skew import top_k

    first = outside.groupBy("server_id", "remote_address").agg(F.min_by("phase", "ts").alias("phase"), F.min("ts").alias("ts"))
    counts = first.groupBy("server_id").agg(F.count(F.lit(1)).alias("addresses"))
    few = top_k(first, ["server_id"], [F.col("ts"), F.col("remote_address")], shown, ["remote_address"])
    entry = F.concat("remote_address", F.lit(" ("), "phase", F.lit(")"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("t")))), lambda x: x["t"]), ", ")
    return counts.join(few.groupBy("server_id").agg(text.alias("shown")), "server_id")


def resource_ticks(events: DataFrame, tick: str = "30 seconds") -> DataFrame:
    """Memory, processes and CPU per server and tick: `events(server_id, ts, pid, memory_mb, cpu_seconds)`.

    Each process counts with its largest sample of the tick.
    """
    per_process = events.groupBy("server_id", F.window("ts", tick).alias("tick"), "pid").agg(
        F.max("memory_mb").alias("memory_mb"), F.max("cpu_seconds").alias("cpu_seconds")
    )
    return per_process.groupBy("server_id", "tick").agg(
        F.sum("memory_mb").alias("memory_mb"), F.count(F.lit(1)).alias("processes"), F.sum("cpu_seconds").alias("cpu_seconds")
    )


def limit_reason(memory_mb: float, processes: int, cpu_seconds: float) -> Column:
    """Why a tick breaks a limit, or null."""
    n = lambda c: F.format_string("%.0f", F.col(c).cast("double"))
    return (
        F.when(F.col("memory_mb") > memory_mb, F.concat(F.lit("memory limit reached ("), n("memory_mb"), F.lit(f" MB > {memory_mb:g} MB)")))
        .when(F.col("processes") > processes, F.concat(F.lit("process limit reached ("), F.col("processes").cast("string"), F.lit(f" > {processes})")))
        .when(F.col("cpu_seconds") > cpu_seconds, F.concat(F.lit("CPU time limit reached ("), n("cpu_seconds"), F.lit(f"s > {cpu_seconds:g}s)")))
    )


def limit_breaks(ticks: DataFrame, memory_mb: float, processes: int, cpu_seconds: float) -> DataFrame:
    """The first broken limit per server."""
    broken = ticks.withColumn("reason", limit_reason(memory_mb, processes, cpu_seconds)).where(F.col("reason").isNotNull())
    return broken.groupBy("server_id").agg(F.min_by("reason", F.col("tick.start")).alias("reason"), F.min("tick.start").alias("ts"))


def since_reset(
    rows: DataFrame, key: str, ts: str, order: Sequence[str], amount: Column, reset: Column, name: str, bucket: str = "day"
) -> DataFrame:
    """Adds `name`: the sum of `amount` per key since the last row that is a reset, that row included.

    The sum so far, minus the sum before the last reset. Both are running values per key, computed
    per time bucket with carried totals, so a busy key is not one task. Amounts are not negative.
    """
    at = F.date_trunc(bucket, F.col(ts))
    running = split_running(
        rows.withColumn("_amount", amount.cast("bigint")).withColumn("_is_reset", reset), key, [F.col(c) for c in order], at,
        {"_so_far": F.col("_amount")},
    )
    # The sum before a reset never falls, so its running maximum is the value at the last reset.
    before = F.when(F.col("_is_reset"), F.col("_so_far") - F.col("_amount"))
    marked = running.withColumn("_reset", before).withColumn("_bucket", at)
    inside = W.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    tops = marked.groupBy(key, "_bucket").agg(F.max("_reset").alias("_top"))
    carried = tops.select(key, "_bucket", F.coalesce(F.max("_top").over(earlier), F.lit(0)).alias("_before"))
    joined = marked.withColumn("_in", F.max("_reset").over(inside)).join(carried, [key, "_bucket"])
    last = F.greatest(F.coalesce("_in", F.lit(0)), F.col("_before"))
    return joined.withColumn(name, F.col("_so_far") - last).drop("_amount", "_is_reset", "_so_far", "_reset", "_bucket", "_in", "_before")


def timeout_runs(calls: DataFrame, key: str, ts: str, order: Sequence[str], timed_out: Column, bucket: str = "day") -> DataFrame:
    """Adds `in_a_row`: how many time-outs in a row end at each call (0 for other calls).

    `timed_out` may be a number: a row of n stands for n time-outs in a row.
    """
    rows = calls.withColumn("_hit", timed_out.cast("int"))
    found = since_reset(rows, key, ts, order, F.col("_hit"), F.col("_hit") == 0, "_run", bucket)
    return found.withColumn("in_a_row", F.when(F.col("_hit") > 0, F.col("_run")).otherwise(F.lit(0))).drop("_hit", "_run")


def session_places(
    events: DataFrame, key: str, ts: str, order: Sequence[str], quiet: str = "30 minutes", amount: Column | None = None, bucket: str = "day"
) -> DataFrame:
    """Adds `place`: the number of an event in the session of its key; a session ends after a quiet time.

    A row with an `amount` of n stands for the last of n events. A busy key is cut into time buckets.
    """
    rows = events.withColumn("_weight", F.lit(1) if amount is None else amount)
    lagged = split_lag(rows, [key], order, F.date_trunc(bucket, F.col(ts)), {"_previous": ts})
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_previous").cast("timestamp"))
    fresh = F.coalesce(apart > seconds(quiet) * 1_000_000, F.lit(True))
    return since_reset(lagged, key, ts, order, F.col("_weight"), fresh, "place", bucket).drop("_weight", "_previous")


def seconds(span: str) -> int:
    """Seconds of a span such as "30 minutes"."""
    amount, unit = span.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def connection_programs(processes: DataFrame, connections: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Connections with the program that made them: the last one seen under the process id at most `within` before.

    `processes(server_id, pid, ts, name)`, `connections(server_id, pid, ts, remote_address)`; adds
    `program` and `started`, null if no program is known. Of programs seen at one time the last by
    name counts. Both are cut into time spans and looked up in the span of the connection and the
    one before, so a process id that is sampled all the time forms no pairs and no large group.
    """
    size = seconds(within) * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.floor(micros / size)
    seen = processes.groupBy("server_id", "pid", "ts").agg(F.max("name").alias("name"))
    seen = seen.select("server_id", "pid", F.explode(F.array(span, span + 1)).alias("_span"), "ts", F.struct("ts", "name").alias("_seen"), F.lit(0).alias("_kind"))
    asked = connections.select(*connections.columns, span.alias("_span"), F.lit(1).alias("_kind"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    upto = W.partitionBy("server_id", "pid", "_span").orderBy("ts", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_last", F.last("_seen", ignorenulls=True).over(upto)).where(F.col("_kind") == 1)
    near = F.when(micros - F.unix_micros(F.col("_last.ts").cast("timestamp")) <= size, F.col("_last"))
    return found.withColumn("_last", near).select(*connections.columns, F.col("_last.name").alias("program"), F.col("_last.ts").alias("started"))


def offline_failures(tool_calls: DataFrame) -> DataFrame:
    """Calls that failed only because there was no network: `tool_calls(server_id, tool, output_text, error)`."""
    said = F.concat_ws(" ", "output_text", "error")
    return tool_calls.where(said.rlike(OFFLINE))
