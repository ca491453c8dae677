"""Reaching definitions: hand-marked code, and random functions against a walk over all paths."""

import random

import pytest
from pyspark.sql import functions as F

from riskscan.operators import code as C
from riskscan.operators import flow as FL

HEAD = "import os, shlex\n\n@app.tool()\ndef go(a: str, b: str):\n"
# Each line that runs something ends in a comment: which parameters reach it.
MARKED = {
    "assigned_anew": "    x = a\n    os.system(x)  # a\n    x = 'fixed'\n    os.system(x)  # -\n    x = b\n    os.system(x)  # b\n",
    "cleaned": "    os.system(a)  # a\n    a = shlex.quote(a)\n    os.system(a)  # -\n",
    "shadowed": "    for a in [1, 2]:\n        os.system(a)  # -\n    os.system(a)  # a\n",
    "branch": "    x = 'fixed'\n    if b:\n        x = a\n        os.system(x)  # a\n    os.system(x)  # a\n    x = 'again'\n    os.system(x)  # -\n",
    "both_branches": "    if b:\n        x = a\n    else:\n        x = b\n    os.system(x)  # a b\n",
    "hidden_in_block": "    x = a\n    if b:\n        x = 'fixed'\n        os.system(x)  # -\n    os.system(x)  # a\n",
    "loop": "    x = 'fixed'\n    while b:\n        os.system(x)  # a\n        x = a\n",
    "loop_assigned_first": "    x = a\n    while b:\n        x = 'fixed'\n        os.system(x)  # -\n        x = a\n",
    "augmented": "    x = 'ls '\n    x += a\n    os.system(x)  # a\n",
    "through": "    x = a\n    y = x\n    x = 'fixed'\n    os.system(y)  # a\n    os.system(x)  # -\n",
    "itself": "    a = a.strip()\n    os.system(a)  # a\n",
}


def test_hand_marked_code(spark):
    files = spark.createDataFrame([("s", f"{n}.py", "python", HEAD + t) for n, t in MARKED.items()], "server_id string, path string, language string, text string")
    lines = C.python_lines(files)
    got = {}
    for r in C.input_reach(files, lines).collect():
        got.setdefault((r.path, r.pos), set()).add(r.param)
    for name, text in MARKED.items():
        for i, line in enumerate((HEAD + text).split("\n")):
            if "os.system" in line:
                want = {p for p in line.split("# ")[1].split() if p != "-"}
                inside = {p for p in got.get((f"{name}.py", i), set())}
                assert inside == want, (name, line)
    hits = {(r.file, r.line): r.tainted for r in C.python_hits(files).where("category = 'command'").collect()}
    assert hits["assigned_anew.py", 6] and not hits.get(("assigned_anew.py", 8), False)


def program(r, depth=0, budget=None):
    """Random nested code: ("def", name), ("use", name), ("if", block, block), ("loop", block)."""
    budget = budget or [9]
    out = []
    while budget[0] > 0 and len(out) < 4:
        budget[0] -= 1
        kind = r.choice(["def", "def", "use", "use", "if", "loop"] if depth < 2 else ["def", "use"])
        if kind in ("def", "use"):
            out.append((kind, r.choice("xy")))
        elif kind == "if":
            out.append(("if", program(r, depth + 1, budget) or [("use", "x")], program(r, depth + 1, budget) if r.random() < 0.5 else []))
        else:
            out.append(("loop", program(r, depth + 1, budget) or [("use", "y")]))
    return out


def laid_out(block, indent, lines):
    """The block with line numbers; `lines` gets (indent, kind, name)."""
    out = []
    for item in block:
        pos = len(lines)
        lines.append((indent, item[0], item[1] if item[0] in ("def", "use") else None))
        if item[0] == "if":
            own = laid_out(item[1], indent + 4, lines)
            other = []
            if item[2]:
                lines.append((indent, "else", None))
                other = laid_out(item[2], indent + 4, lines)
            out.append(("if", own, other))
        elif item[0] == "loop":
            out.append(("loop", laid_out(item[1], indent + 4, lines)))
        else:
            out.append((item[0], item[1], pos))
    return out


def walked(block, state, found):
    """What reaches each use on some path: `state` is a set of (name, definition)."""
    for item in block:
        if item[0] == "def":
            state = {s for s in state if s[0] != item[1]} | {(item[1], item[2])}
        elif item[0] == "use":
            found.setdefault(item[2], set()).update(d for n, d in state if n == item[1])
        elif item[0] == "if":
            state = walked(item[1], state, found) | walked(item[2], state, found)
        else:
            for _ in range(3):
                state = state | walked(item[1], state, found)
    return state


def test_random_functions_lose_no_definition(spark):
    """Every definition that reaches a use on some path is found; what straight code hides is not."""
    r = random.Random(12)
    rows, defs, uses, want = [], [], [], {}
    for f in range(150):
        lines = []
        block = laid_out(program(r), 4, lines)
        found = {}
        walked(block, set(), found)
        for pos, (indent, kind, name) in enumerate(lines):
            rows.append((f"f{f}", pos, indent, kind == "loop"))
            if kind == "def":
                defs.append((f"f{f}", name, pos, indent))
            if kind == "use":
                uses.append((f"f{f}", name, pos))
                want[f"f{f}", pos] = found.get(pos, set())
    line = spark.createDataFrame(rows, "fn string, pos int, indent int, is_loop boolean")
    d = spark.createDataFrame(defs, "fn string, name string, pos int, level int")
    u = spark.createDataFrame(uses, "fn string, name string, pos int")
    at, edges = FL.reaching(line, d, u, ["fn"])
    after = {}
    for e in edges.collect():
        after.setdefault(e.dst, set()).add(e.src)
    nodes = {x.node: x.pos for x in FL.numbered(d, ["fn"]).collect()}

    def sources(node):
        seen, todo = set(), [node]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        return {nodes[n] for n in seen if n in nodes}

    got = {}
    for x in at.collect():
        got.setdefault((x.fn, x.pos), set()).update(sources(x.node))
    exact = 0
    for key, real in want.items():
        assert real <= got.get(key, set()), key
        exact += real == got.get(key, set())
    assert exact / len(want) > 0.8


@pytest.mark.parametrize("n", [400])
def test_a_long_function_makes_few_edges(spark, n):
    """Branches that each define the name: edges grow with the definitions, not with definitions times uses."""
    rows = [("f", 3 * i + k, (4, 8, 4)[k], False) for i in range(n) for k in range(3)]
    line = spark.createDataFrame(rows, "fn string, pos int, indent int, is_loop boolean")
    d = line.where("indent = 8").select("fn", F.lit("x").alias("name"), "pos", F.col("indent").alias("level"))
    u = line.where("pos % 3 = 2").select("fn", F.lit("x").alias("name"), "pos")
    at, edges = FL.reaching(line, d, u, ["fn"])
    assert at.count() == n and edges.count() <= 3 * n
