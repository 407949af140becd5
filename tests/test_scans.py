"""Long logs, printed trees, numbers of rows and patches against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from textfacts.functions import text as X
from textfacts.operators import logs, order, patch, tree


def _plain_blocks(rows, most):
    out, n = [], {}
    for log, pos, line in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        n[log] = n.get(log, 0) + line.startswith("!")
        if log is not None and 1 <= n[log] <= most:
            out.append((log, pos, n[log]))
    return sorted(out)


@pytest.mark.parametrize("range_", [1, 7, 100, 65_536])
def test_blocks_of_long_logs(spark, range_):
    rng = random.Random(1)
    rows = [("long", i, "!" if rng.random() < 0.004 else "x") for i in range(3_000)] + [("none", i, "x") for i in range(50)] + [("all", i * 3, "!") for i in range(40)] + [(None, 1, "!"), ("one", 5, "!")]
    df = spark.createDataFrame(rows, "log string, pos long, line string").repartition(5)
    got = logs.blocks(df, "log", "pos", F.startswith("line", F.lit("!")), 5, range_)
    assert got.columns == ["log", "pos", "line", "block"] or sorted(got.columns) == ["block", "line", "log", "pos"]
    assert sorted((r["log"], r["pos"], r["block"]) for r in got.collect()) == _plain_blocks(rows, 5)
    assert logs.blocks(df.where("false"), "log", "pos", F.lit(True)).count() == 0


def _plain_totals(lines):
    import re

    for i in range(len(lines) - 1, -1, -1):
        if m := re.search(r"Total tests:\s*([0-9]+)", lines[i], re.IGNORECASE):
            told = {}
            for x in lines[i : i + 24]:
                for kind in ("passed", "failed"):
                    if k := re.fullmatch(rf"\s*{kind}:\s*([0-9]+)\s*", x, re.IGNORECASE):
                        told[kind] = int(k[1])
            if len(told) == 2:
                return told["failed"], told["passed"], 0, int(m[1])
    return None


@pytest.mark.parametrize("range_", [5, 24, 1_000])
def test_totals_of_long_logs(spark, range_):
    rng = random.Random(2)
    texts = {k: [rng.choice(["Total tests: 7", "Passed: 3", " failed: 2 ", "x", "x", "x", "Passed: 9"]) if rng.random() < 0.3 else "noise" for _ in range(400)] for k in range(12)}
    texts[90], texts[91] = ["Total tests: 1"] * 60, ["Passed: 1", "Failed: 1", "Total tests: 3"]
    df = spark.createDataFrame([(k, i, x) for k, ls in texts.items() for i, x in enumerate(ls)], "run int, pos long, line string")
    got = {r["run"]: tuple(r)[1:] for r in logs.last_totals(df, "run", "pos", range_=range_).collect()}
    assert got == {k: t for k, ls in texts.items() if (t := _plain_totals(ls))} and 90 not in got


def test_one_long_log_is_split(spark):
    """Half a million lines of one log: the lines that any task numbers are those of a range."""
    lines = spark.range(500_000).select(F.lit("a").alias("log"), F.col("id").alias("pos"), F.when(F.col("id") % 90_000 == 70_000, "  Failed Ns.T [1 ms]").when(F.col("id") % 90_000 == 70_001, "Error Message: bad").otherwise("x").alias("line"))
    found = logs.failures(lines, "log", "pos").orderBy("block").collect()
    assert [(r["block"], r["name"]) for r in found] == [(n, "Ns.T") for n in range(1, 6)] and all(r["error"].startswith("bad x x") and len(r["error"]) == 512 for r in found)
    plan = logs.blocks(lines, "log", "pos", F.lit(True))._jdf.queryExecution().toString()
    assert "windowspecdefinition(log#" in plan.replace(" ", "") and "_r#" in plan.split("RunningWindow")[0]


@pytest.mark.parametrize("range_rows", [3, 40, 10_000])
def test_numbered(spark, range_rows):
    keys = random.Random(3).sample([f"{i:05d}" for i in range(5_000)], 700)
    df = spark.createDataFrame([(k, 1, 2) for k in keys] + [(None, 3, 4)], "k string, _range int, _key int").repartition(6)
    got = {r["k"]: r["line_no"] for r in order.numbered(df.drop("_range", "_key"), F.col("k"), range_rows=range_rows).collect()}
    assert got == {None: 1, **{k: i + 2 for i, k in enumerate(sorted(keys))}}
    assert order.numbered(df.where("false").select("k"), F.col("k")).count() == 0


def _plain_tree(paths, root, depth, names):
    top: dict = {}
    for p in paths:
        at = top
        parts = [x for x in (p or "").split("/") if x]
        for i, x in enumerate(parts):
            at = at.setdefault(x, {}) if i < len(parts) - 1 or x in at else at.setdefault(x, {}) or at
    out = [root]

    def show(node, level):
        kept = [(not kids, x.upper(), x) for x, kids in node.items() if not (kids and x.lower() in names)]
        for n, (is_file, _, x) in enumerate(sorted(kept), 1):
            out.append(" " * 4 * level + ("└── " if n == len(kept) else "├── ") + x + ("" if is_file else "/"))
            if not is_file and level + 1 < depth:
                show(node[x], level + 1)

    if depth > 0:
        show(top, 0)
    return out


@pytest.mark.parametrize(("depth", "range_rows"), [(0, 9), (1, 9), (2, 1_000), (3, 5), (9, 2)])
def test_printed_tree(spark, depth, range_rows):
    paths = ["src/b.cs", "src/A.cs", "src/a/x/y/z.cs", "src/B/q", "README", "readme2", "bin/x.dll", "src/Obj/y", "src/bin", "a.txt", "A/1", "a-b/2", "ab/3", "", None, "src/b.cs", "Z/z/Z", "ä/ö", "x/.git/config"]
    df = spark.createDataFrame([(p, 1, "t") for p in paths], "path string, line_no int, text string")
    got = [(r["line_no"], r["text"]) for r in tree.printed(df, "path", "top", depth, range_rows=range_rows).orderBy("line_no").collect()]
    assert got == list(enumerate(_plain_tree(paths, "top", depth, {x.lower() for x in tree.EXCLUDED}), 1))
    assert [r["text"] for r in tree.printed(df.where("false"), "path", "top", depth).collect()] == ["top"]


@pytest.mark.parametrize(
    ("text", "old", "new", "want"),
    [("a b then a  b", "a b", "x a  b", "x a  b then x a  b"), ("a b then a  b", "a b", "a   b!", "a   b! then a   b!"), ("p q/r p  q/r", "p q/r", "$1\\", "$1\\ $1\\"), ("x\r\ny x y", "x\ny", "z\nw", "z\r\nw z\r\nw"), ("none", "a b", "c", "none")],
)
def test_replace_all_is_one_pass(spark, text, old, new, want):
    out, _ = patch.patched(F.col("t"), old, new, every=True)
    assert spark.createDataFrame([(text,)], "t string").select(out).first()[0] == want


def test_scratchpad_of_nulls(spark):
    rows = [("a", 1, "write", None), ("a", 2, "append", "x"), ("a", 3, "append", None), ("b", 1, "append", None), ("c", 1, "clear", None)]
    got = {r["pad"]: (r["content"], r["n_parts"]) for r in patch.folded(spark.createDataFrame(rows, "pad string, pos int, action string, content string"), "pad", "pos").collect()}
    assert got == {"a": ("\nx\n", 3), "b": ("", 1), "c": ("", 0)}


def test_places(spark):
    rows = ["license", "", "xx", "a license, license", "licenselicense", "lic.ense", None, "é😀license"]
    got = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "t string, i int").orderBy("i").select(X.places(F.col("t"), "license")).collect()]
    assert got == [[0], [], [], [2, 11], [0, 7], [], None, [2]]
    assert spark.createDataFrame([("a.b.c",)], "t string").select(X.places(F.col("t"), ".")).first()[0] == [1, 3]
