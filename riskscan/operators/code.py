"""Code facts: risky calls and constants in source lines.

There is no syntax tree. Lines and patterns approximate one, so what rests on them is
reported with lower confidence and never as confirmed. Input is
`files(server_id, path, language, text)`; the output follows CODE_HIT_SCHEMA.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskscan import patterns as P
from riskscan.functions import secrets as S
from riskscan.functions import urls as U
from riskscan.operators import flow as FL
from riskscan.operators.graph import reach_by_chains
from riskscan.operators.skew import written
from riskscan.schemas import CODE_HIT_SCHEMA, conform
from riskscan.sources.source_tree import LONG_LINE, is_minified, split_lines

FILE_KEY = ("server_id", "path")
FUNCTION_KEY = ("server_id", "path", "function")

# ---- JavaScript --------------------------------------------------------------------------

IDENTIFIER = r"[A-Za-z_$][\w$]*"
CHILD_PROCESS = r"\b(?:require|import)?\s*\(?\s*['\"](?:node:)?child_process['\"]"


def js_call(names: tuple[str, ...], owners: tuple[str, ...] = ()) -> str:
    """A call of one of the names: as a member of an owner, or as a plain function."""
    called = "(?:" + "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in names) + r")\s*\("
    if owners:
        return r"\b(?:" + "|".join(map(re.escape, owners)) + r")\s*\??\.\s*" + called
    return r"(?:^|[^.\w$])" + called


# An argument that is more than one literal.
VARIABLE = r"\s*(?!(?:'[^']*'|\"[^\"]*\"|`[^`$]*`)\s*[,)])[^\s)]"
SPAWNERS = ("child_process", "childProcess", "cp")
JS_SHELL = "|".join((js_call(("exec", "execSync")), js_call(("exec", "execSync"), SPAWNERS)))
JS_SPAWN = "|".join((js_call(("execFile", "execFileSync", "fork", "spawn", "spawnSync")), js_call(("execFile", "execFileSync", "fork", "spawn", "spawnSync"), SPAWNERS)))
# A value that is put together on the line: a template with a hole, or a sum.
JS_DYNAMIC = rf"\$\{{|\+\s*{IDENTIFIER}|{IDENTIFIER}\s*\+"
FILE_OWNERS = ("fs", "fs.promises", "fsp", "fsPromises")


def _sync(*names: str) -> tuple[str, ...]:
    return tuple(n + end for n in names for end in ("", "Sync"))


# Calls by what they do: category, owners, names, what their arguments begin with, detail, and
# whether a value put together on the line counts as tainted.
JS_CALLS = (
    ("obfuscated-exec", (), ("eval", "Function", "new Function"), r"\s*" + js_call(("atob", "decodeURIComponent", "unescape", "Buffer.from")).replace(r"(?:^|[^.\w$])", ""),
     "decodes text and runs it", False),
    ("code-eval", (), ("eval",), VARIABLE, "evaluates a value", False),
    ("code-eval", (), ("new Function",), "", "makes a function from text", False),
    ("code-eval", ("vm",), ("compileFunction", "runInContext", "runInNewContext", "runInThisContext"), "", "runs text in a vm", False),
    ("file-write", FILE_OWNERS, _sync("appendFile", "rename", "rm", "rmdir", "unlink", "writeFile"), VARIABLE, "writes or removes a file it was told", True),
    ("file-read", FILE_OWNERS, (*_sync("readFile", "readdir"), "createReadStream"), VARIABLE, "reads a file it was told", True),
    ("network", (), ("fetch", "axios"), VARIABLE, "requests an address it was told", True),
    ("network", ("axios",), ("delete", "get", "patch", "post", "put", "request"), VARIABLE, "requests an address it was told", True),
    ("env-dump", ("JSON",), ("stringify",), r"\s*process\.env\s*[,)]", "takes the environment as a whole", False),
    ("env-dump", ("Object",), ("entries", "keys", "values"), r"\s*process\.env\s*\)", "takes the environment as a whole", False),
)
JS_LINES = tuple((category, js_call(names, owners) + begin, detail, follows) for category, owners, names, begin, detail, follows in JS_CALLS)
LITERAL = r"['\"`]([^'\"`]{4,})['\"`]"
# Files of browsers and systems that hold secrets, and places that run at start.
SECRET_STORES = (".bash_history", ".zsh_history", ".git-credentials", "Cookies.sqlite", "key4.db", "logins.json", "Library/Keychains", "Local State")
START_PLACES = (
    ".bashrc", ".bash_profile", ".profile", ".zshrc", "authorized_keys", "crontab", "/etc/cron", "LaunchAgents", "LaunchDaemons", "systemd/system",
    "Start Menu/Programs/Startup", "CurrentVersion/Run",
)


def _any_place(places: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(re.escape(p).replace("/", r"[/\\]{1,2}") for p in places)


SENSITIVE_CODE = _any_place(SECRET_STORES)
STARTUP_PLACE = _any_place(START_PLACES)
NUMERIC_HOST = r"https?://(\d{1,3}(?:\.\d{1,3}){3})"


def _names_outside_address(v: Column) -> Column:
    """An address with a numeric host that is neither this machine nor a private network."""
    host = F.regexp_extract(v, NUMERIC_HOST, 1)
    return (host != "") & ~U.is_local_host(host)


def _hit(category: str, detail: Column, tainted: Column | bool = False) -> Column:
    return F.struct(
        F.lit(category).alias("category"), detail.alias("detail"),
        (tainted if isinstance(tainted, Column) else F.lit(tainted)).alias("tainted"),
    )


def _literal_hits(literals: Column, python: bool) -> Column:
    """Sensitive paths, collector places and (Python) startup places among string literals."""
    cut = lambda v: F.left(v, F.lit(80))
    mentions = lambda v: F.concat(F.lit("names '"), cut(v), F.lit("'"))
    sends = lambda v: F.concat(F.lit("fixed address '"), cut(v), F.lit("'"))

    def found(v: Column) -> Column:
        sensitive, outside = v.rlike(P.SENSITIVE_PATH), v.rlike(P.COLLECTOR_DOMAIN)
        kinds = [
            F.when(sensitive | v.rlike(SENSITIVE_CODE) if python else sensitive, _hit("sensitive-path", mentions(v))),
            F.when(outside | _names_outside_address(v) if python else outside, _hit("exfil-endpoint", sends(v))),
        ]
        if python:
            kinds.append(F.when(v.rlike(STARTUP_PLACE), _hit("persistence", mentions(v))))
        return F.array_compact(F.array(*kinds))

    return F.flatten(F.transform(literals, found))


def javascript_hits(files: DataFrame) -> DataFrame:
    """Hits in JavaScript and TypeScript, comments left out.

    Very wide lines, as bundles have them, are read statement by statement, so that what is put
    together in one statement doesn't taint its neighbours.
    """
    js = files.where(F.col("language") == "javascript")
    lines = js.select(
        *FILE_KEY, F.col("text").rlike(CHILD_PROCESS).alias("spawns"), F.posexplode(split_lines(F.col("text"))).alias("pos", "whole")
    )
    wide = F.char_length("whole") > LONG_LINE
    lines = lines.select(*FILE_KEY, "spawns", "pos", F.posexplode(F.when(wide, F.split("whole", ";")).otherwise(F.array("whole"))).alias("part", "raw"))
    line = F.btrim("raw", F.lit(" \t"))
    lines = lines.withColumn("line_text", line).where((line != "") & ~line.rlike(r"^(?://|\*|/\*)"))
    text = F.col("line_text")
    dynamic = text.rlike(JS_DYNAMIC)
    shell_option = F.replace(text, F.lit(" "), F.lit("")).contains("shell:true")
    decoded = text.rlike(JS_LINES[0][1])
    found = [
        F.when(F.col("spawns") & text.rlike(JS_SHELL), _hit("command", F.lit("starts a shell command"), dynamic)).when(
            F.col("spawns") & text.rlike(JS_SPAWN),
            _hit(
                "command",
                F.when(shell_option, F.lit("starts a shell command")).otherwise(F.lit("starts a program")),
                dynamic & shell_option,
            ),
        )
    ]
    for i, (category, pattern, detail, follows) in enumerate(JS_LINES):
        # Decoded code that runs is the stronger finding; the other patterns of the line are left out.
        test = text.rlike(pattern) if i == 0 else text.rlike(pattern) & ~decoded
        found.append(F.when(test, _hit(category, F.lit(detail), dynamic if follows else False)))
    literals = F.when(text.rlike("['\"`]"), F.regexp_extract_all(text, F.lit(LITERAL)))
    every = F.concat(
        F.array_compact(F.array(*found)),
        F.coalesce(_literal_hits(literals, python=False), F.array().cast("array<struct<category:string,detail:string,tainted:boolean>>")),
    )
    hits = lines.select(*FILE_KEY, "pos", "line_text", (F.col("part") * 100).alias("part"), F.posexplode(every).alias("nr", "h"))
    return _shape(hits.withColumn("nr", F.col("part") + F.col("nr")), "javascript")


def _shape(hits: DataFrame, lang: str) -> DataFrame:
    rows = hits.select(
        "server_id", (F.col("pos").cast("long") * 1000 + F.col("nr")).alias("seq"), "h.category", F.col("path").alias("file"),
        (F.col("pos") + 1).alias("line"), F.col("line_text").alias("snippet"), F.lit(lang).alias("language"),
        "h.tainted", F.array().cast("array<string>").alias("tainted_params"), "h.detail", F.lit(False).alias("sanitized"),
    )
    return conform(rows, CODE_HIT_SCHEMA)


# ---- Python --------------------------------------------------------------------------------

_HTTP_VERBS = "get post put patch delete head options request stream".split()
# Calls by what they do.
SINKS = {
    "command": (
        "subprocess.run subprocess.call subprocess.Popen subprocess.check_output subprocess.check_call "
        "subprocess.getoutput subprocess.getstatusoutput os.system os.popen os.execv os.execve os.execvp os.execvpe "
        "os.execl os.execlp os.spawnl os.spawnv os.spawnvp os.posix_spawn asyncio.create_subprocess_shell "
        "asyncio.create_subprocess_exec pty.spawn commands.getoutput"
    ).split(),
    "code-eval": "eval exec builtins.eval builtins.exec runpy.run_path runpy.run_module".split(),
    "deserialization": (
        "pickle.load pickle.loads cPickle.load cPickle.loads dill.load dill.loads marshal.load marshal.loads shelve.open "
        "jsonpickle.decode yaml.unsafe_load pandas.read_pickle joblib.load"
    ).split(),
    "file-write": (
        "os.remove os.unlink os.rmdir os.removedirs shutil.rmtree shutil.move shutil.copy shutil.copyfile shutil.copy2 "
        "shutil.copytree os.rename os.replace os.chmod os.chown"
    ).split(),
    "file-read": "os.listdir os.scandir os.walk glob.glob glob.iglob".split(),
    "network": [f"{lib}.{verb}" for lib in ("requests", "httpx") for verb in _HTTP_VERBS]
    + "urllib.request.urlopen urllib.request.Request http.client.HTTPConnection http.client.HTTPSConnection "
    "socket.create_connection aiohttp.request".split(),
    "template": (
        "jinja2.Template Template mako.template.Template flask.render_template_string render_template_string "
        "jinja2.Environment.from_string"
    ).split(),
}
ALWAYS_SHELL = (
    "os.system os.popen subprocess.getoutput subprocess.getstatusoutput asyncio.create_subprocess_shell commands.getoutput"
).split()
OPENERS = "open io.open os.open codecs.open".split()
IMPORTERS = "__import__ importlib.import_module".split()
PATH_WRITERS = "write_text write_bytes unlink rmdir rename replace touch mkdir chmod symlink_to".split()
PATH_READERS = "read_text read_bytes iterdir glob rglob".split()
SQL_METHODS = "execute executemany executescript raw mogrify".split()
SQL_OWNERS = r"cursor|conn|db|session|engine|cur"
HTTP_OWNERS = r"(?:session|client|http)[^.]*$"
DECODERS = (
    r"(?:base64\.(?:b64decode|b32decode|b16decode|decodebytes)|codecs\.decode|(?:zlib|gzip|lzma|bz2)\.decompress"
    r"|bytes\.fromhex|marshal\.loads)\s*\("
)
# A value that went through one of these cannot steer a path or a command.
SANITISER_CALL = (
    r"\b(?:shlex\.quote|pipes\.quote|int|float|bool|len|os\.path\.basename|re\.escape|html\.escape|markupsafe\.escape"
    r"|(?:urllib\.parse\.)?quote|hash|hashlib\.\w+|uuid\.\w+|secrets\.token_\w+)\((?:[^()]|\([^()]*\))*+\)"
)
SKIPPED_PARAMS = ("self", "cls", "ctx", "context")
ENTRY_DECORATOR = r"^@[\w.]*\.?(tool|call_tool|prompt|get_prompt|resource|read_resource)\b"
CALL = r"([A-Za-z_][\w.]*)\s*\("
NAMES = r"[A-Za-z_]\w*"


def import_aliases(text: Column) -> Column:
    """Names a file gives to imported things, as an array of (head, canonical)."""
    as_pattern = r"(?m)^\s*import\s+([\w.]+)\s+as\s+(\w+)"
    renamed = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(as_pattern), F.lit(2)).alias("head"),
        F.regexp_extract_all(text, F.lit(as_pattern), F.lit(1)).alias("canonical"),
    )
    from_pattern = r"(?m)^\s*from\s+([\w.]+)\s+import\s+\(?([^()\n#]+)"
    modules = F.regexp_extract_all(text, F.lit(from_pattern), F.lit(1))
    lists = F.regexp_extract_all(text, F.lit(from_pattern), F.lit(2))
    taken = F.flatten(
        F.transform(
            modules,
            lambda m, i: F.transform(
                F.split(F.get(lists, i), ","),
                lambda n: F.named_struct(
                    F.lit("head"), F.regexp_extract(n, r"(\w+)\s*$", 1),
                    F.lit("canonical"), F.concat(m, F.lit("."), F.regexp_extract(n, r"\w+", 0)),
                ),
            ),
        )
    )
    return F.concat(renamed, taken)


def canonical_call(name: Column, aliases: Column) -> Column:
    """A call name with its import alias undone."""
    head = F.substring_index(name, ".", 1)
    target = F.get(F.filter(aliases, lambda a: a["head"] == head), F.lit(0))["canonical"]
    return F.when(target.isNotNull(), F.concat(target, F.substr(name, F.char_length(head) + 1))).otherwise(name)


def call_category(name: Column, args: Column) -> Column:
    """What a call does, as (category, detail); null for harmless calls."""
    method = F.substring_index(name, ".", -1)
    owner = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", ""))
    value = lambda cat, detail: F.struct(F.lit(cat).alias("category"), detail.alias("detail"))
    called = F.concat(name, F.lit("()"))
    as_method = F.concat(F.lit("."), method, F.lit("()"))
    shell = name.isin(*ALWAYS_SHELL) | args.rlike(r"\bshell\s*=\s*True\b")
    mode = F.regexp_extract(args, r"(?:^[^,]*,\s*|\bmode\s*=\s*)['\"]([rwaxbt+]+)['\"]", 1)
    unsafe_yaml = (name == "yaml.load") & ~args.rlike("Safe")
    unsafe_torch = (name == "torch.load") & ~args.rlike(r"weights_only\s*=\s*True")
    text_replace = method.isin("replace", "rename") & args.rlike(r"^[^()]*,|=")
    return (
        F.when(
            name.isin(*SINKS["command"]),
            value("command", F.when(shell, "starts a shell command").otherwise("starts a program")),
        )
        .when(name.isin(*SINKS["code-eval"]), value("code-eval", called))
        .when(name.isin(*SINKS["deserialization"]) | unsafe_yaml | unsafe_torch, value("deserialization", called))
        .when(
            name.isin(*OPENERS) & mode.rlike("[wax+]"),
            value("file-write", F.concat(F.lit("open(mode='"), mode, F.lit("')"))),
        )
        .when(name.isin(*OPENERS), value("file-read", F.lit("open()")))
        .when(name.isin(*SINKS["file-write"]), value("file-write", called))
        .when(name.isin(*SINKS["file-read"]), value("file-read", called))
        .when(name.isin(*SINKS["network"]), value("network", called))
        .when(name.isin(*SINKS["template"]) | name.endswith(".from_string"), value("template", called))
        .when(owner.isNull() | text_replace, F.lit(None))
        .when(method.isin(*PATH_WRITERS), value("file-write", as_method))
        .when(method.isin(*PATH_READERS), value("file-read", as_method))
        .when(method.isin(*SQL_METHODS) & F.lower(owner).rlike(SQL_OWNERS), value("sql", as_method))
        .when(
            method.isin("get", "post", "put", "patch", "delete", "request", "stream") & F.lower(owner).rlike(HTTP_OWNERS),
            value("network", as_method),
        )
    )


def _joined_lines(lines: DataFrame) -> DataFrame:
    """Lines inside an open bracket, joined to the line where it was opened.

    Brackets are counted outside strings and comments, anew from each definition or import at the
    left edge, so that a line read wrongly spoils nothing beyond the next one of these.
    """
    bare = F.regexp_replace("line_text", r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|#.*$", "")
    depth = F.regexp_count(bare, F.lit(r"[(\[{]")) - F.regexp_count(bare, F.lit(r"[)\]}]"))
    fresh = (F.col("indent") == 0) & F.col("line_text").rlike(r"^(?:@|async\s+def\b|class\b|def\b|from\b|import\b)")
    file = W.partitionBy(*FILE_KEY).orderBy("pos")
    marked = lines.withColumn("_depth", depth).withColumn("_piece", F.sum(F.when(fresh, 1).otherwise(0)).over(file))
    piece = W.partitionBy(*FILE_KEY, "_piece").orderBy("pos")
    before = F.coalesce(F.sum("_depth").over(piece.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("_starts", before <= 0)
    marked = marked.withColumn("_line", F.sum(F.when(F.col("_starts"), 1).otherwise(0)).over(piece))
    whole = W.partitionBy(*FILE_KEY, "_piece", "_line").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    joined = marked.withColumn("line_text", F.array_join(F.collect_list("line_text").over(whole), " "))
    return joined.where("_starts").drop("_depth", "_piece", "_starts", "_line")


def python_lines(files: DataFrame) -> DataFrame:
    """Python lines with the function they are in, its tool name, and whether they are code.

    The windows run over the lines of one file. Lines inside an open bracket are joined to the one
    where it was opened, so that a call is seen with all its arguments.
    """
    py = files.where(F.col("language") == "python")
    # Docstrings are tool descriptions and belong to the text rules; blank them, keep the lines.
    doc = r"(?s)(?:\"\"\".*?\"\"\"|'''.*?''')"
    pieces = F.split(F.col("text"), doc, -1)
    docs = F.regexp_extract_all(F.col("text"), F.lit(f"({doc})"))
    blanked = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.concat(
                p, F.coalesce(F.concat(F.lit("''"), F.regexp_replace(F.get(docs, i), r"[^\n]+", "")), F.lit(""))
            ),
        ),
        "",
    )
    lines = py.select(
        *FILE_KEY, import_aliases(F.col("text")).alias("aliases"), F.posexplode(split_lines(blanked)).alias("pos", "raw")
    )
    line = F.btrim("raw", F.lit(" \t"))
    indent = F.char_length("raw") - F.char_length(F.ltrim("raw", F.lit(" \t")))
    lines = _joined_lines(lines.withColumn("line_text", line).withColumn("indent", indent))
    name = F.nullif(F.regexp_extract("line_text", r"^(?:async\s+)?def\s+(\w+)", 1), F.lit(""))
    entry = F.nullif(F.regexp_extract("line_text", ENTRY_DECORATOR, 1), F.lit(""))
    explicit = F.regexp_extract("line_text", r"^@[\w.]+\(\s*(?:name\s*=\s*)?['\"]([^'\"]+)['\"]|\bname\s*=\s*['\"]([^'\"]+)['\"]", 1)
    explicit2 = F.regexp_extract("line_text", r"\bname\s*=\s*['\"]([^'\"]+)['\"]", 1)
    is_tool = entry.isin("tool", "call_tool")
    marked = lines.select(
        "*",
        F.when(name.isNotNull(), F.struct(F.col("pos"), name.alias("name"), F.col("indent").alias("indent"))).alias("def_"),
        F.when(
            entry.isNotNull(),
            F.struct(
                F.col("pos"), entry.alias("entry"),
                F.coalesce(F.nullif(explicit2, F.lit("")), F.when(is_tool, F.nullif(explicit, F.lit("")))).alias("public"),
            ),
        ).alias("deco"),
        # Code at the left edge that is neither a definition nor a decorator ends a function.
        F.when((F.col("indent") == 0) & (F.col("line_text") != "") & name.isNull() & ~F.col("line_text").rlike(r"^[)@#\]}'\"]"), F.col("pos")).alias("edge"),
    )
    upto = W.partitionBy(*FILE_KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*FILE_KEY).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lined = marked.select(
        "*",
        F.last("def_", ignorenulls=True).over(upto).alias("in_def"),
        F.last("edge", ignorenulls=True).over(upto).alias("last_edge"),
        F.last("deco", ignorenulls=True).over(upto).alias("last_deco"),
        F.last(F.col("def_.pos"), ignorenulls=True).over(before).alias("previous_def"),
    )
    # The decorator belongs to the definition when no other definition stands between them.
    owns = F.when(
        F.col("def_").isNotNull()
        & F.col("last_deco").isNotNull()
        & (F.col("last_deco.pos") > F.coalesce("previous_def", F.lit(-1))),
        F.struct(F.col("pos"), F.coalesce("last_deco.public", "def_.name").alias("tool")),
    )
    lined = lined.withColumn("owner", F.when(F.col("def_").isNotNull(), F.coalesce(owns, F.struct(F.col("pos"), F.lit(None).cast("string").alias("tool")))))
    lined = lined.withColumn("in_owner", F.last("owner", ignorenulls=True).over(upto))
    inside = F.col("in_def").isNotNull() & (F.coalesce("last_edge", F.lit(-1)) < F.col("in_def.pos"))
    return lined.select(
        *FILE_KEY, "aliases", "pos", "line_text", "indent",
        F.when(inside, F.col("in_def.name")).alias("function"),
        F.when(inside, F.col("in_owner.tool")).alias("tool"),
        F.col("def_").isNotNull().alias("is_def"),
        (F.col("line_text").startswith("#") | F.col("line_text").startswith("@")).alias("is_note"),
    )


def _params(files: DataFrame) -> DataFrame:
    """Parameters of every function: (server_id, path, function, place, param)."""
    # Default values may hold brackets of their own.
    head = r"(?s)\bdef\s+(\w+)\s*\(((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+)\)"
    names = F.regexp_extract_all("text", F.lit(head), F.lit(1))
    lists = F.regexp_extract_all("text", F.lit(head), F.lit(2))
    rows = files.where(F.col("language") == "python").select(
        *FILE_KEY, F.posexplode(F.arrays_zip(names.alias("function"), lists.alias("params"))).alias("nr", "f")
    )
    first = rows.groupBy(*FILE_KEY, F.col("f.function").alias("function")).agg(F.min_by("f.params", "nr").alias("params"))
    given = F.filter(
        F.transform(
            F.split(F.regexp_replace(F.regexp_replace("params", r"\((?:[^()]|\([^()]*\))*+\)", ""), r"\[[^\]]*\]", ""), ","), lambda p: F.regexp_extract(p, r"^[\s*]*(\w+)", 1)
        ),
        lambda p: (p != "") & ~p.isin(*SKIPPED_PARAMS),
    )
    return first.select(*FUNCTION_KEY, F.posexplode(given).alias("place", "param"))


ASSIGN = r"^([A-Za-z_][\w, ]*?)\s*(?::[^=]+)?((?:[-+*/|&^%]|//|\*\*)?)=(?!=)\s*(.+)$"
FOR = r"^(?:async\s+)?for\s+([\w, ()]+?)\s+in\s+(.+?):?$"
WITH = r"^(?:async\s+)?with\s+(.+?)\s+as\s+(\w+)\s*:?$"


def definitions(lines: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions of variables (*FUNCTION_KEY, name, pos, level), and which names each takes its value from (*FUNCTION_KEY, to, pos, frm).

    Plain, annotated and augmented assignments, loops and `with`, which hold inside their block, and
    parameters. A name that only goes through a function that cleans it gives nothing on.
    """
    text = F.col("line_text")
    part = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    opens = part(FOR, 1).isNotNull() | part(WITH, 2).isNotNull()
    value = F.coalesce(part(FOR, 2), part(WITH, 1), F.when(~opens & part(ASSIGN, 2).isNotNull(), F.concat_ws(" + ", part(ASSIGN, 1), part(ASSIGN, 3))), part(ASSIGN, 3))
    code = lines.where(F.col("function").isNotNull() & ~F.col("is_def") & ~F.col("is_note"))
    set_ = code.select(
        *FUNCTION_KEY, "pos", (F.col("indent") + F.when(opens, 1).otherwise(0)).alias("level"), F.coalesce(part(FOR, 1), part(WITH, 2), part(ASSIGN, 1)).alias("target"), value.alias("value")
    ).where(F.col("target").isNotNull())
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({NAMES})")))
    to = set_.select(*FUNCTION_KEY, "pos", "level", F.explode(names(F.col("target"))).alias("name"), names(F.regexp_replace("value", SANITISER_CALL, "")).alias("from_"))
    begin = lines.where("is_def").groupBy(*FUNCTION_KEY).agg(F.min("pos").alias("pos"))
    given = params.join(begin, list(FUNCTION_KEY)).select(*FUNCTION_KEY, F.col("param").alias("name"), "pos", F.lit(0).alias("level"))
    return (
        to.select(*FUNCTION_KEY, "name", "pos", "level").unionByName(given),
        to.select(*FUNCTION_KEY, F.col("name").alias("to"), "pos", F.explode("from_").alias("frm")),
    )


def handed_over(lines: DataFrame, params: DataFrame) -> DataFrame:
    """Names handed to functions of the same file: (*FUNCTION_KEY, pos, frm, callee, param), by place or keyword."""
    code = lines.where(F.col("function").isNotNull() & ~F.col("is_def") & ~F.col("is_note"))
    calls = code.select(*FUNCTION_KEY, "pos", "line_text", F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(CALL)))).alias("name"))
    calls = calls.select(
        *FILE_KEY, "function", "pos", F.substring_index("name", ".", -1).alias("callee"),
        F.posexplode(F.split(F.regexp_replace(_arguments(F.col("line_text"), F.col("name")), SANITISER_CALL, ""), ",")).alias("place", "arg"),
    )
    params = params.withColumnRenamed("function", "callee")
    keyword = F.regexp_extract("arg", r"^\s*(\w+)\s*=(?!=)", 1)
    into = calls.join(params, [*FILE_KEY, "callee"]).where(
        (F.col("callee") != F.col("function")) & F.when(keyword != "", keyword == F.col("param")).otherwise(calls["place"] == params["place"])
    )
    return into.select(*FUNCTION_KEY, "pos", "callee", "param", F.explode(F.regexp_extract_all("arg", F.lit(f"({NAMES})"))).alias("frm"))


def _arguments(line: Column, name: Column) -> Column:
    """What stands after the opening bracket of a call on its line."""
    at = F.position(F.concat(name, F.lit("(")), line)
    return F.when(at > 0, F.regexp_replace(F.substr(line, at + F.char_length(name) + 1), r"\)[^()]*$", "")).otherwise(F.lit(""))


def input_reach(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Uses of variables that tool input reaches: (server_id, path, function, pos, variable, tool, param).

    Values go from definition to definition: each use takes what the definitions that reach it
    have, so a variable that was assigned anew or cleaned before the use has its new value there.
    """
    key = list(FUNCTION_KEY)
    own = written(_params(files))
    defs, taken = definitions(lines, own)
    defs, given = written(defs), handed_over(lines, own)
    inner = lines.where(F.col("function").isNotNull())
    code = inner.where(~F.col("is_note") & ~F.col("is_def") & (F.col("line_text") != ""))
    known = defs.select(*key, "name").distinct()
    uses = code.select(*key, "pos", F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(f"({NAMES})")))).alias("name")).join(known, [*key, "name"])
    shape = inner.select(*key, "pos", "indent", F.col("line_text").rlike(r"^(?:async\s+)?(?:for|while)\b").alias("is_loop"))
    at, edges = FL.reaching(shape, defs, uses, key)
    at = written(at)
    placed = FL.numbered(defs, key)
    ends = placed.select(*key, F.col("name").alias("to"), "pos", F.col("node").alias("dst"))
    frm = at.select(*key, F.col("name").alias("frm"), "pos", F.col("node").alias("src"))
    assigned = taken.join(ends, [*key, "to", "pos"]).join(frm, [*key, "frm", "pos"]).select("src", "dst")
    first = placed.groupBy(*key, "name").agg(F.min_by("node", "pos").alias("node"))
    params = first.select(*FILE_KEY, F.col("function").alias("callee"), F.col("name").alias("param"), F.col("node").alias("dst"))
    across = given.join(frm, [*key, "frm", "pos"]).join(params, [*FILE_KEY, "callee", "param"]).select("src", "dst")
    every = edges.unionByName(assigned).unionByName(across)
    tools = lines.where(F.col("is_def") & F.col("tool").isNotNull()).select(*key, "tool").distinct()
    seeds = own.join(tools, key).join(first.withColumnRenamed("name", "param"), [*key, "param"]).select(
        "node", F.concat_ws("\x01", "tool", "param").alias("origin")
    )
    spread = reach_by_chains(every, seeds)
    part = lambda c, i: F.get(F.split(c, "\x01"), F.lit(i))
    reached = spread.select("node", part("origin", 0).alias("tool"), part("origin", 1).alias("param"))
    return at.join(reached, "node").select(*key, "pos", F.col("name").alias("variable"), "tool", "param").distinct()


def python_hits(files: DataFrame) -> DataFrame:
    """Hits in Python lines, with the tool input that reaches them."""
    lines = written(python_lines(files))
    reached = input_reach(files, lines)
    # Variables of one line: a few.
    per_line = reached.groupBy(*FUNCTION_KEY, "pos").agg(F.collect_set(F.struct("variable", "tool", "param")).alias("inputs"))
    code = lines.where(~F.col("is_note") & ~F.col("is_def") & (F.col("line_text") != ""))
    code = code.join(per_line, [*FUNCTION_KEY, "pos"], "left")
    calls = code.select(
        *FUNCTION_KEY, "tool", "pos", "line_text", "aliases", "inputs",
        F.posexplode(F.regexp_extract_all("line_text", F.lit(CALL))).alias("nr", "name"),
    )
    calls = calls.withColumn("name", canonical_call(F.col("name"), F.col("aliases"))).withColumn(
        "args", _arguments(F.col("line_text"), F.regexp_extract(F.col("line_text"), CALL, 1))
    )
    given = F.col("line_text")
    passed = F.regexp_extract_all(F.regexp_replace(given, SANITISER_CALL, ""), F.lit(f"({NAMES})"))
    inputs = F.filter("inputs", lambda i: F.array_contains(F.col("passed"), i["variable"]))
    own_args = _arguments(F.col("line_text"), F.element_at(F.regexp_extract_all("line_text", F.lit(CALL)), F.col("nr") + 1))
    calls = calls.withColumn("args", own_args).withColumn("passed", passed)
    calls = calls.withColumn("from_input", F.coalesce(inputs, F.array().cast("array<struct<variable:string,tool:string,param:string>>")))
    tainted = F.size("from_input") > 0
    # One literal, or a list of nothing but literals.
    one = r"[rb]?(?:'[^']*'|\"[^\"]*\")"
    literal = F.col("args").rlike(rf"^\s*(?:{one}\s*(?:,|$)|[\[(]\s*{one}(?:\s*,\s*{one})*+\s*,?\s*[\])]\s*(?:,|$)|\d)")
    imported = F.col("name").isin(*IMPORTERS) & tainted
    found = F.when(imported, F.struct(F.lit("code-eval").alias("category"), F.concat("name", F.lit("() with tool input")).alias("detail"))).otherwise(
        call_category(F.col("name"), F.col("args"))
    )
    calls = calls.withColumn("found", found).where(F.col("found").isNotNull())
    category = F.col("found.category")
    decoded = (category == "code-eval") & F.col("args").rlike(DECODERS)
    worth = (
        tainted
        | decoded
        | (category.isin("code-eval", "command") & ~literal)
        | category.isin("deserialization", "network", "file-write")
    )
    from_calls = calls.where(worth).select(
        *FUNCTION_KEY, F.coalesce("tool", F.get("from_input", F.lit(0))["tool"]).alias("tool"), "pos", "nr", "line_text",
        F.when(decoded, "obfuscated-exec").otherwise(category).alias("category"),
        F.when(decoded, "decodes text and runs it").otherwise(F.col("found.detail")).alias("detail"),
        tainted.alias("tainted"),
        F.array_sort(F.array_distinct(F.transform("from_input", lambda i: i["param"]))).alias("tainted_params"),
    )
    none = F.array().cast("array<string>")
    constants = code.select(
        *FUNCTION_KEY, "tool", "pos", "line_text",
        F.posexplode(_literal_hits(F.regexp_extract_all("line_text", F.lit(r"['\"]([^'\"]{4,})['\"]")), python=True)).alias("nr", "h"),
    ).select(
        *FUNCTION_KEY, "tool", "pos", (F.col("nr") + 500).alias("nr"), "line_text", "h.category", "h.detail",
        F.lit(False).alias("tainted"), none.alias("tainted_params"),
    )
    whole = r"(?:\b(?:dict|str|repr|json\.dumps)\(\s*os\.environ\s*\)|\bos\.environ\.(?:copy|items)\()"
    dumps = code.where(F.col("line_text").rlike(whole) & ~F.col("line_text").rlike(r"\benv\s*=")).select(
        *FUNCTION_KEY, "tool", "pos", F.lit(900).alias("nr"), "line_text", F.lit("env-dump").alias("category"),
        F.lit("takes the environment as a whole").alias("detail"), F.lit(False).alias("tainted"), none.alias("tainted_params"),
    )
    shells = (
        code.where(F.col("function").isNotNull())
        .groupBy(*FUNCTION_KEY)
        .agg(
            F.first("tool", ignorenulls=True).alias("tool"), F.min("pos").alias("pos"), F.min_by("line_text", "pos").alias("line_text"),
            F.bool_or(F.col("line_text").rlike(r"\bos\.dup2\s*\(|\bdup2\s*\(")).alias("dups"),
            F.bool_or(F.col("line_text").rlike(r"\bsocket\.\w+\s*\(")).alias("sockets"),
        )
        .where("dups and sockets")
        .select(
            *FUNCTION_KEY, "tool", "pos", F.lit(901).alias("nr"), "line_text", F.lit("reverse-shell").alias("category"),
            F.lit("puts a socket in the place of standard input (dup2)").alias("detail"), F.lit(False).alias("tainted"),
            none.alias("tainted_params"),
        )
    )
    every = from_calls.unionByName(constants).unionByName(dumps).unionByName(shells)
    return _finish_python(every, code)


def checked_functions(code: DataFrame) -> DataFrame:
    """Functions that keep paths inside a folder, themselves or through a helper of their file."""
    text = F.col("line_text")
    flags = code.where(F.col("function").isNotNull()).groupBy(*FUNCTION_KEY).agg(
        F.bool_or(text.rlike(r"\bis_relative_to\(|\bcommonpath\(|\.relative_to\(")).alias("compares"),
        F.bool_or(text.rlike(r"\.resolve\(|realpath\(|abspath\(|basename\(")).alias("resolves"),
        F.bool_or(text.contains(".startswith(")).alias("prefix"),
    )
    own = flags.where("compares or (resolves and prefix)").select(*FUNCTION_KEY)
    calls = code.where(F.col("function").isNotNull()).select(
        *FUNCTION_KEY, F.explode(F.regexp_extract_all("line_text", F.lit(CALL))).alias("name")
    ).select(*FUNCTION_KEY, F.substring_index("name", ".", -1).alias("callee")).distinct()
    helped = calls.join(own.withColumnRenamed("function", "callee"), [*FILE_KEY, "callee"]).select(*FUNCTION_KEY)
    return own.unionByName(helped).distinct().withColumn("checked", F.lit(True))


def _finish_python(hits: DataFrame, code: DataFrame) -> DataFrame:
    """One hit per file, category and line: the one that knows a tool first."""
    rest = F.struct("function", "tool", "line_text", "detail", "tainted", "tainted_params")
    first = hits.groupBy(*FILE_KEY, "category", "pos").agg(
        F.min_by(F.struct("nr", rest.alias("r")), F.struct(~F.col("tainted"), F.col("tool").isNull(), F.col("nr"))).alias("f")
    )
    rows = first.select(*FILE_KEY, "category", "pos", "f.nr", "f.r.*").join(checked_functions(code), list(FUNCTION_KEY), "left")
    shaped = rows.select(
        "server_id", (F.col("pos").cast("long") * 1000 + F.col("nr")).alias("seq"), "category", F.col("path").alias("file"),
        (F.col("pos") + 1).alias("line"), F.col("line_text").alias("snippet"), F.lit("python").alias("language"),
        "function", "tool", "tainted", "tainted_params", "detail",
        (F.coalesce("checked", F.lit(False)) & F.col("category").isin("file-read", "file-write")).alias("sanitized"),
    )
    return conform(shaped, CODE_HIT_SCHEMA)


# ---- secrets in code --------------------------------------------------------------------

PUBLIC_KEY_COMMENT = (
    r"(?i)(?:#|//|/\*|\*|<!--)[^\n]*(?:\bkey\b[^\n]*\bpublic\b|\bpublic\b[^\n]*\bkey\b|\bnot\s+(?:a\s+)?secret\b"
    r"|\bsafe\s+to\s+(?:commit|share|expose|publish)\b)"
)


def secret_hits(files: DataFrame) -> DataFrame:
    """Secrets in any source line; a comment up to two lines above may say the key is public."""
    lines = split_lines(F.col("text"))
    near = F.array_compact(
        F.transform(
            lines,
            lambda line, i: F.when(
                S.has_secret(line),
                F.struct(
                    i.alias("pos"), line.alias("raw"),
                    F.concat_ws("\n", F.get(lines, i - 2), F.get(lines, i - 1), line).alias("nearby"),
                ),
            ),
        )
    )
    # Files without a secret anywhere leave before their lines are looked at.
    rows = files.where(S.has_secret(F.col("text"))).select(*FILE_KEY, "language", F.explode(near).alias("l"))
    found = rows.select(*FILE_KEY, "language", "l.*", F.posexplode(S.find_secrets(F.col("l.raw"))).alias("nr", "s"))
    shaped = found.select(
        "server_id", (F.col("pos").cast("long") * 1000 + 950 + F.col("nr")).alias("seq"), F.lit("secret").alias("category"),
        F.col("path").alias("file"), (F.col("pos") + 1).alias("line"),
        F.concat(F.col("s.kind"), F.lit(": "), S.mask(F.col("s.value"))).alias("snippet"), "language",
        F.lit(False).alias("tainted"), F.array().cast("array<string>").alias("tainted_params"),
        F.col("s.kind").alias("detail"), F.lit(False).alias("sanitized"),
        F.when(F.col("nearby").rlike(PUBLIC_KEY_COMMENT), "marked public").alias("note"),
    )
    return conform(shaped, CODE_HIT_SCHEMA)


def code_hits(files: DataFrame) -> DataFrame:
    """All code facts of all files."""
    return javascript_hits(files).unionByName(python_hits(files)).unionByName(secret_hits(files))


def minified_files(files: DataFrame) -> DataFrame:
    """JavaScript files that are bundles or hold very wide lines: facts from them are less sure."""
    js = files.where(F.col("language") == "javascript")
    wide = F.exists(split_lines(F.col("text")), lambda line: F.char_length(F.btrim(line)) > LONG_LINE)
    return js.select("server_id", "path", is_minified(F.col("text")).alias("whole"), wide.alias("wide")).where("whole or wide")


def with_function_facts(hits: DataFrame) -> DataFrame:
    """Adds `beside`: the categories found in the same function (or outside functions, the same file).

    The categories are a fixed small set, so collecting them per function is bounded; no hits
    are paired with each other.
    """
    near = hits.groupBy("server_id", "file", F.coalesce("function", F.lit("")).alias("_function")).agg(
        F.collect_set("category").alias("beside")
    )
    keyed = hits.withColumn("_function", F.coalesce("function", F.lit("")))
    return keyed.join(near, ["server_id", "file", "_function"]).drop("_function")


# Code that makes a tool unsafe to call, in plain words.
UNSAFE_CODE = {
    "command": "starts programs",
    "code-eval": "evaluates code",
    "obfuscated-exec": "unpacks code and runs it",
    "file-write": "writes to files",
    "network": "talks to the network",
    "deserialization": "loads data that can carry code",
    "reverse-shell": "hands out a shell",
}


def unsafe_tools(hits: DataFrame) -> DataFrame:
    """Tools whose code does something dangerous, with the first reason."""
    reason = F.create_map(*[F.lit(x) for kv in UNSAFE_CODE.items() for x in kv])
    bad = hits.where(F.col("tool").isNotNull() & F.col("category").isin(*UNSAFE_CODE))
    first = bad.groupBy("server_id", "tool").agg(F.min_by("category", F.struct("file", "seq")).alias("category"))
    return first.select("server_id", "tool", F.element_at(reason, F.col("category")).alias("reason"))
