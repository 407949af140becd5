"""References found in sources, and edits by place, on small sources."""

import time

import pytest

from textfacts.functions import csharp
from textfacts.operators import edits, references

FILE = "path string, text string, name string, start long, scope string"
BOX = """namespace A.B;
[Note("Box")] public class Box
{
    public int Size = 1;
    public Box(int size) { Size = size; }
    ~Box() { }
    public int Get() => Size;
    public int Get(int @at) { return Get() + this.Get(1) + at; }
    class Inner { int Twice() { return Size * 2; } }
}
"""
SHOP = """using A.B;
namespace Shop
{
    class Till
    {
        Box box = new Box(3);
        string Show(Box other) { var b = new Box(1); return $"{other.Get()} {b.Size:N2} Box {{Box}}" + box.Get(2) + b.Get(1, 2); } // Box
        int Unknown() { return Make().Only() + Make().Get(); }
        int Size(int Get) { return Get; }
    }
}
"""
FAR = "namespace Far { class X { Box box; A.B.Box full; void Only() { } } }"


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a/Box.cs", BOX), ("b/Shop.cs", SHOP), ("b/Far.cs", FAR), ("b/none.cs", None), ("b/empty.cs", ""), (None, "class Q { Box b; }"), ("b/odd.cs", 'class { ( $"{ "')]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FILE)


@pytest.fixture(scope="module")
def found(files):
    return references.index(files).persist()


def _of(found, fqn):
    rows = references.resolved(found).where(f"fqn = '{fqn}' and path is not null").collect()
    return sorted((r["path"], r["line"], r["start"], r["n_params"], r["certain"]) for r in rows)


def test_types_are_seen_by_scope(found):
    got = _of(found, "A.B.Box")
    assert [(p, n) for p, n, *_ in got] == [("a/Box.cs", 6), ("b/Far.cs", 1), ("b/Shop.cs", 6), ("b/Shop.cs", 6), ("b/Shop.cs", 7), ("b/Shop.cs", 7)]
    far = next(s for p, _, s, *_ in got if p == "b/Far.cs")
    assert FAR[far - 4 : far + 3] == "A.B.Box"  # qualified; the plain one there sees nothing


def test_members_by_receiver_and_arguments(found):
    get = [(p, n, k, c) for p, n, _, k, c in _of(found, "A.B.Box.Get")]
    assert get == [("a/Box.cs", 8, 0, True), ("a/Box.cs", 8, 1, True), ("b/Shop.cs", 7, 0, True), ("b/Shop.cs", 7, 1, True), ("b/Shop.cs", 7, 0, True)]
    assert [(p, n) for p, n, *_ in _of(found, "A.B.Box.Size")] == [("a/Box.cs", 5), ("a/Box.cs", 7), ("a/Box.cs", 9), ("b/Shop.cs", 7)]
    assert [(p, n, c) for p, n, _, _, c in _of(found, "Far.X.Only")] == [("b/Shop.cs", 8, False)]  # by name alone
    assert _of(found, "Shop.Till.Size") == []


def test_places_are_names(files, found):
    texts = {r["path"]: r["text"] for r in files.collect()}
    for r in found.where("path is not null").collect():
        assert texts[r["path"]][r["start"] : r["end"]].lstrip("~@") == r["name"].lstrip("~")
        assert texts[r["path"]].count("\n", 0, r["start"]) + 1 == r["line"]
    assert {r["name"] for r in references.declarations(found).where("path = 'a/Box.cs'").collect()} == {"Box", "Size", "Get", "Inner", "Twice"}


def test_find_usages_and_references(files, found):
    got = references.find_usages(found, files, " BOX ", 3).orderBy("rank").collect()
    assert [(r["path"], r["rank"], r["total"], r["cut"]) for r in got][:1] == [("a/Box.cs", 1, 6, True)] and len(got) == 3
    assert got[-1]["source"] == "        Box box = new Box(3);"
    assert references.find_usages(found, files, "nothing").count() == 0
    around = references.find_references(found, "a/Box.cs", "Box").orderBy("rank").collect()
    assert [r["context"] for r in around] == ["class Box", "A.B.Box full;", "Box box = new Box(3);", "Box box = new Box(3);", "string Show(Box other);", "string Show(Box other);"]
    assert references.find_references(found, "a/Box.cs", "box").count() == 0


def test_rename_by_places(spark, files, found):
    new = spark.createDataFrame([("A.B.Box", "class", 0, "Crate"), ("A.B.Box.Get", "method", 1, "At")], "fqn string, kind string, n_params long, new string")
    got = {r["path"]: r["text"] for r in references.renamed(files, found, new).collect()}
    want = BOX.replace("class Box", "class Crate").replace("public Box(", "public Crate(").replace("~Box", "~Crate").replace("Get(int", "At(int").replace("this.Get(1)", "this.At(1)")
    assert got["a/Box.cs"] == want
    assert got["b/Shop.cs"] == SHOP.replace("Box box = new Box(3)", "Crate box = new Crate(3)").replace("Show(Box", "Show(Crate").replace("new Box(1)", "new Crate(1)").replace("box.Get(2)", "box.At(2)")
    assert got["b/Far.cs"] == FAR.replace("A.B.Box", "A.B.Crate") and len(got) == 3
    projects = spark.createDataFrame([("a/Box.cs", 1), ("b/Shop.cs", 2), ("b/Far.cs", 2)], "path string, project int")
    assert [r["path"] for r in references.renamed(files, found, new.selectExpr("*", "1 project"), projects).collect()] == ["a/Box.cs"]


def _broadcast(df):
    """Whether the plan that ran sends a table through the driver to all tasks."""
    df.collect()
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_renames_broadcast_nothing(spark, files, found):
    new = spark.createDataFrame([("A.B.Box", "class", 0, "Crate", 1)], "fqn string, kind string, n_params long, new string, project int")
    projects = spark.createDataFrame([("a/Box.cs", 1)], "path string, project int")
    assert not _broadcast(references.renamed(files, found, new, projects))


def test_usages_broadcast_nothing(files, found):
    used = references.usages(found)
    assert not _broadcast(used)
    lined = references.with_lines(used, files)
    assert not _broadcast(lined) and {r["source"] for r in lined.where("path = 'b/Far.cs'").collect()} == {FAR}
    assert not _broadcast(references.with_context(references.resolved(found), found))


def test_index_of_nothing(spark):
    none = references.index(spark.createDataFrame([], FILE))
    assert references.resolved(none).count() == 0 and references.usages(none).count() == 0


@pytest.mark.parametrize("text", ["class A { void F() { " + "f(" * 60_000, "class A { " + "a" * 200_000 + " }", "class A { int x; void F() { " + "x.y();" * 20_000 + "} }", "class A { " + "int a{0}; " * 5_000 + "}", "<" * 100_000, '$"{' * 20_000, "a." * 100_000, "class A { void F(int x) { " + "a<" * 50_000 + "} }"])
def test_occurrences_in_linear_time(text):
    start = time.process_time()
    csharp.occurrences(text)
    csharp.problems(text, 8)
    csharp.outline(text)
    assert time.process_time() - start < 20


def test_problems_stop_early():
    assert csharp.problems("\n]" * 100_000, 2) == ["line 2: unexpected ]", "line 3: unexpected ]"]


def test_splice():
    assert edits.splice("abcdef", [(0, 1, "X"), (3, 3, "-"), (4, 6, "")]) == "Xbc-d"
    assert edits.splice("", [(0, 0, "x")]) == "x" and edits.splice("é😀z", [(1, 2, "é")]) == "ééz"
    assert all(edits.splice("abc", e) is None for e in ([(0, 2, ""), (1, 3, "")], [(0, 4, "")], [(2, 1, "")], [(1, 1, "a"), (1, 1, "b")], [(1, 1, "a"), (1, 2, "b")]))


def test_spliced(spark):
    files = spark.createDataFrame([("a", "0123456789", 1), ("b", "xyz", 2), ("c", "same", 3), ("d", None, 4), (None, "n", 5), ("e", "over", 6)], "path string, text string, n_edits int")
    rows = [("a", 8, 9, "B"), ("a", 1, 3, "A"), ("a", 1, 3, "A"), ("a", 10, 10, None), ("b", 2, 5, "x"), ("d", 0, 0, "x"), ("none", 0, 0, "x"), ("a", None, 3, "x"), (None, 0, 1, "x"), ("e", 0, 2, ""), ("e", 1, 2, "")]
    got = {r["path"]: (r["text"], r["n_edits"], r["refused"]) for r in edits.spliced(files, spark.createDataFrame(rows, "path string, start long, end long, text string")).collect()}
    assert got == {"a": ("0A34567B9", 3, None), "b": ("xyz", 0, edits.OUTSIDE), "c": ("same", 0, None), "d": (None, 0, None), None: ("n", 0, None), "e": ("over", 0, edits.OVERLAP)}
    assert edits.spliced(files.where("false"), spark.createDataFrame(rows, "path string, start long, end long, text string")).count() == 0
    assert edits.spliced(files, spark.createDataFrame([], "path string, start long, end long, text string")).where("n_edits = 0").count() == 6
