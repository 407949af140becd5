"""Each query against its SQL, and the operators on small hand-written rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textfacts.functions import text as X
from textfacts.operators import logs, patch, search, symbols
from textfacts.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in at]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_parity(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows([tuple(r) for r in got.collect()], got.columns) == _rows(want.fetchall(), want.columns)


def test_overloads_leave_none_out(spark):
    got = {(r["p_brand"], r["name"]): r["bodies"].split("\n\n---\n\n") for r in catalogue.QUERIES["overloads"](spark, SF).collect()}
    part = [r for r in spark.read.parquet(f"{SF}/part.parquet").orderBy("p_size", "p_name", "p_partkey").collect() if r["p_partkey"] % 13]
    assert got == {k: [r["p_name"] for r in part if (r["p_brand"], r["p_type"]) == k] for k in {(r["p_brand"], r["p_type"]) for r in part}}
    assert sum(map(len, got.values())) == len(part)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "line_no", "line"]


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_text(spark):
    t = F.col("t")
    assert _one(spark, "a\r\nb\rc\n", X.lines(t)) == ["a", "b", "c"]
    assert _one(spark, "a\r\nb", X.lines_physical(t)) == ["a", "", "b"]
    assert _one(spark, "a\n", X.lines_kept(t)) == ["a", ""]
    assert _one(spark, "x" * 3000, X.excerpt(t)) == "x" * 3000 and _one(spark, "x" * 3001, X.excerpt(t)) == "x" * 1000 + X.EXCERPT_MARK + "x" * 1500
    assert _one(spark, "<A> v </A>", X.tag_value(t, "a")) == "v" and _one(spark, "<a></a>", X.tag_value(t, "a")) is None


def test_logs(spark):
    df = spark.createDataFrame([(1, "src/A.cs(12,5): error X100: message"), (2, "src/B.cs(3, 1): WARNING X200: other"), (3, "Restore of all done")], "n int, line string")
    got = [(r["severity"], r["code"], r["location"], r["message"]) for r in logs.diagnostics(df).orderBy("n").collect()]
    assert got == [("error", "X100", "src/A.cs(12,5)", "message"), ("warning", "X200", "src/B.cs(3, 1)", "other")]
    error, stack = logs.between(F.col("t"))
    assert _one(spark, "Error Message:\n a\n b\nStack Trace:\n at x", error) == "a b"
    assert _one(spark, "Stack Trace: s Error Message: e", error) == ""


def test_patch(spark):
    for text, every, want, kind in [("a b a b", False, "X a b", "exact"), ("a  b\r\nc", False, "X\r\nc", "flexible"), ("c", False, "c", "none"), ("a b a  b", True, "X X", "exact")]:
        out, how = patch.patched(F.col("t"), "a b", "X", every)
        assert (_one(spark, text, out), _one(spark, text, how)) == (want, kind)
    with pytest.raises(ValueError):
        patch.patched(F.col("t"), " ", "x")


def test_enclosing(spark):
    """A method comes before its class, a constructor, property and field too; of several of a kind the innermost."""
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 1), ("f", 12), ("f", 15), ("f", 5), ("f", 9000), ("f", 9500)], "path string, pos long")
    rows = [("f", "class", 0, 20, "C"), ("f", "method", 3, 8, "M"), ("f", "ctor", 11, 13, "T"), ("f", "field", 11, 14, "F"), ("f", "event", 15, 16, "E"), ("f", "class", 14, 18, "N"), ("f", "interface", 0, 9600, "I"), ("f", "method", 8000, 9400, "O"), ("f", "method", 8900, 9100, "P")]
    spans = spark.createDataFrame(rows, "path string, kind string, start long, end long, header string")
    got = {(r["path"], r["pos"]): r["header"] for r in symbols.enclosing(points, spans).collect()}
    assert got == {("f", 5): "M", ("f", 12): "T", ("f", 15): "N", ("f", 50): "I", ("g", 1): None, ("f", 9000): "P", ("f", 9500): "I"}
    assert symbols.enclosing(points, spans.limit(0)).count() == 7 and symbols.enclosing(points.limit(0), spans).count() == 0


def test_renamed(spark):
    files = spark.createDataFrame([("a", "a.b$ axb$ a.b$c"), ("b", None)], "path string, text string")
    assert [r["after"] for r in symbols.renamed(files, "a.b$", "x$1\\").orderBy("path").collect()] == ["x$1\\ axb$ a.b$c", None]
    old = spark.createDataFrame([(1, "p", "x"), (2, "q", "y"), (3, None, "z")], "id long, path string, text string")
    new = spark.createDataFrame([(1, "p", "x2"), (2, "q", "y"), (3, None, "z2"), (4, "n", "n")], "id long, path string, text string")
    assert [r["id"] for r in symbols.differences(old, new, "id").collect()] == [1]


def test_diagnostic_formats(spark):
    lines = ["a.cs(1,2) : error CS1 : m", "a.cs(1,2): error AD0001-x: m", "a(3,4): error X: b(5,6): warning Y: z", "a.cs(1,2): error: m", "a.cs(1): error X: m", "", None]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {r["n"]: (r["severity"], r["code"], r["location"], r["message"]) for r in logs.diagnostics(df).collect()}
    assert got == {0: ("error", "CS1", "a.cs(1,2)", "m"), 1: ("error", "AD0001-x", "a.cs(1,2)", "m"), 2: ("warning", "Y", "a(3,4): error X: b(5,6)", "z")}


def _log(spark, *texts):
    return search.physical_lines(spark.createDataFrame(list(enumerate(texts)), "run long, text string"), "run")


def test_test_logs(spark):
    anchors = {"[xUnit.net 00:00:01.00]     Ns.T1 [FAIL]": "Ns.T1", "  Failed Ns.T2 [12 ms]": "Ns.T2", "Failed : T3": "T3", "Failed: 3": "3", "  Failed Ns.T4(x: 1)": "Ns.T4(x: 1)", "Passed Ns.T5 [1 ms]": None, "failed Ns.T6": None}
    for line, name in anchors.items():
        assert _one(spark, line, logs.failed_name(F.col("t"))) == name
    text = "x\r\n  Failed A.B [1 ms]\r\n  Error Message:\r\n   one\r\n\r\n   two\r\n  Stack Trace:\r\n     at a\r\n   at b  \r\n" + "".join(f"  at c{i}\n" for i in range(20)) + "[xUnit.net 0] C.D [FAIL]\n  why  \nStack Trace: s\nFailed : E\nError Message: " + "m" * 600 + "\nFailed G\nStack Trace: a\nError Message: b"
    got = [(r["name"], r["error"], r["stack"]) for r in logs.failures(_log(spark, text), "run", "pos").orderBy("block").collect()]
    assert got == [("A.B", "one two", "\n".join(["at a", "   at b", *(f"  at c{i}" for i in range(13))])), ("C.D", "why", "s"), ("E", "m" * 509 + "...", ""), ("G", "", "a\nError Message: b")]
    one = "Passed! - Failed: 0, Passed: 9, Skipped: 0, Total: 9\nFailed! - Failed: 1, Passed: 2, Skipped: 0, Total: 3\nFailed: 4, Passed: 4, Skipped: 4, Total: 12"
    many = "Total tests: 3\r\nPassed: 2\r\nFailed: 1\r\nTotal tests: 8\n" + "x\n" * 22 + "Passed: 7\nFailed: 1"  # the last block's failed tests come a line too late
    late = "Total tests: 8\n" + "x\n" * 21 + "Passed: 7\nFailed: 1"
    got = {r["run"]: (r["failed"], r["passed"], r["skipped"], r["total"]) for r in logs.totals(_log(spark, one, many, late, "Total tests: 1", "", many + "\n" + one), "run", "pos").collect()}
    assert got == {0: (1, 2, 0, 3), 1: (1, 2, 0, 3), 2: (1, 7, 0, 8), 5: (1, 2, 0, 3)}


def test_marks(spark):
    t = F.col("t")
    assert _one(spark, "x" * 500, X.telemetry_preview(t)) == "x" * 250 + "\n...[TRUNCATED]...\n" + "x" * 250 and _one(spark, "x" * 499, X.telemetry_preview(t)) == "x" * 499
    assert _one(spark, "x" * 8001, X.suffix_cut(t)) == "x" * 8000 + "... [truncated 1 chars]"
    assert _one(spark, ' { "b" : "a \\" : b" , "a" : [ 1 , 2.50 ] } ', X.rpc_params(t)) == '{"b":"a ' + chr(92) + 'u0022 : b","a":[1,2.50]}' and _one(spark, None, X.rpc_params(t)) == "(none)"
    assert _one(spark, "ProtectedOrInternal", X.modifiers(t, F.lit(True))) == "protected internal static " and _one(spark, "Private", X.modifiers(t, F.lit(False))) == ""
    assert _one(spark, "y" * 401 + "  ", X.line_cut(t)) == "y" * 400 + "…" and _one(spark, "a`b", X.without_backticks(t)) == "a'b"
    assert _one(spark, "a\n" * 500, X.guarded(t)) == "a\n" * 500 and _one(spark, "a\n" * 501, X.guarded(t)) is None
    assert _one(spark, "2147483647", X.last_line(t.cast("int"), F.lit(2))) is None


def test_search(spark):
    files = spark.createDataFrame([("a", "One\nTWO"), ("b", None), ("c", "")], "doc_id string, text string")
    assert [tuple(r) for r in search.search(files, "doc_id", "two").collect()] == [("a", 2, "TWO")]
    assert search.search(files, "doc_id", "^o", regex=True).count() == 1
