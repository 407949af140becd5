"""Folder scans, project sources, growing logs and bucketed file tables."""

import os

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from textfacts.sources import scan, sinks, workspace
from textfacts.streaming import tail


def _make(root, files):
    for path, text in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", newline="") as f:
            f.write(text)


FILES = {"a.cs": "A\r\n", "src/b.cs": "é", "src/deep/er/c.txt": "c", "src/bin/no.cs": "x", "OBJ/no.cs": "x", "src/.git/config": "x", "src/x+y %20.cs": "", "bin.cs": "kept"}


class Recording:
    """A file system that tells which folders are listed."""

    def __init__(self) -> None:
        self.fs, self.listed = pafs.LocalFileSystem(), []

    def get_file_info(self, what):
        if isinstance(what, pafs.FileSelector):
            self.listed.append(what.base_dir)
        return self.fs.get_file_info(what)


@pytest.mark.parametrize("subtrees", [1, 2, 64])
def test_excluded_folders_are_never_listed(tmp_path, monkeypatch, subtrees):
    monkeypatch.setattr(scan, "SUBTREES", subtrees)
    _make(tmp_path, FILES)
    fs, wanted = Recording(), scan.Wanted([], ["bin", "obj", ".git"])
    found = [f for p in scan.parts_of(fs, str(tmp_path), wanted) for f in [*p.files, *(x.path for at, n in p.folders for x in scan.walked(fs, at, n, wanted))]]
    assert sorted(scan.below(str(tmp_path), f) for f in found) == sorted(p for p in FILES if "no.cs" not in p and ".git" not in p)
    assert sorted(scan.below(str(tmp_path), d) for d in fs.listed) == ["", "src", "src/deep", "src/deep/er"]  # each once


def test_files_source(spark, tmp_path):
    _make(tmp_path, FILES)
    (tmp_path / "empty").mkdir()
    got = {r["path"]: r["text"] for r in workspace.files(spark, str(tmp_path)).collect()}
    assert got == {p: t for p, t in FILES.items() if "no.cs" not in p and ".git" not in p}
    assert {r["path"] for r in workspace.files(spark, f"file://{tmp_path}", "*.{txt,sln}").collect()} == {"src/deep/er/c.txt"}
    scan.register(spark)
    read = lambda **o: {(r["path"], r["text"], r["size"]) for r in spark.read.format("textfacts_files").options(**o).load(str(tmp_path)).collect()}
    assert read(levels="1", glob="b*.cs") == {("bin.cs", "kept", 4)} and read(exclude="src,bin", text="false") == {("a.cs", None, 3), ("OBJ/no.cs", None, 1), ("bin.cs", None, 4)}
    assert read(glob="none") == set() and workspace.files(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="no folder"):
        spark.read.format("textfacts_files").load().count()


SLN = 'Project("{F}") = "App", "src\\\\App\\\\App.csproj", "{1}"\nEndProject\nProject("{F}") = "Lib", "src\\\\Lib\\\\Lib.csproj", "{2}"\n'
PROJECTS = {
    "All.sln": SLN.replace("\\\\", "\\"),
    "src/App/App.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><TargetFramework> net9.0 </TargetFramework><OutputType>Exe</OutputType><ProjectReference Include="..\\Lib\\Lib.csproj" /><ProjectReference Include="../Lib/./Lib.csproj" /><ProjectReference Include="..\\No.csproj" /></Project>',
    "src/Lib/Lib.csproj": '<Project><TargetFrameworks>a;b</TargetFrameworks><AssemblyName>L.Tests</AssemblyName><PackageReference Include="xunit" /><PackageReference Include="xunit" /></Project>',
    "src/W/W.csproj": '<Project Sdk="Microsoft.NET.Sdk.Worker"></Project>',
    "src/E/E.fsproj": "",
    "src/obj/Old.csproj": "<Project/>",
}


def test_projects_source_is_as_the_columns(spark, tmp_path):
    _make(tmp_path, PROJECTS)
    scan.register(spark)
    sources = spark.createDataFrame([(p, t) for p, t in PROJECTS.items() if "/obj/" not in p], "path string, text string")
    plain = {"projects": workspace.projects, "project_refs": workspace.project_refs, "assembly_refs": workspace.assembly_refs, "solution_projects": workspace.solution_projects}
    for name, of in plain.items():
        got = spark.read.format("textfacts_projects").option("table", name).load(str(tmp_path))
        want = of(sources)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.select(*got.columns).collect()))), name
        assert got.count() > 0


def test_projects_source_takes_filters(spark, tmp_path):
    _make(tmp_path, PROJECTS)
    reader = lambda table: scan.ProjectsReader({"path": str(tmp_path), "table": table})
    name, path = ("name",), ("path",)
    for filters, rest, want in [
        ([scan.EqualTo(name, "Lib")], 0, ["src/Lib/Lib.csproj"]),
        ([scan.In(path, ("src/W/W.csproj", "x", None))], 0, ["src/W/W.csproj"]),
        ([scan.StringStartsWith(path, "src/"), scan.StringEndsWith(("project_id",), "App.csproj")], 0, ["src/App/App.csproj"]),
        ([scan.EqualTo(("kind",), "Test")], 1, ["src/App/App.csproj", "src/E/E.fsproj", "src/Lib/Lib.csproj", "src/W/W.csproj"]),
    ]:
        r = reader("projects")
        assert len(list(r.pushFilters(filters))) == rest
        parts = r.partitions()
        assert all(len(p.files) <= 1 for p in parts) and sorted(x[0] for p in parts for x in r.read(p)) == want
    got = spark.read.format("textfacts_projects").load(str(tmp_path)).where("name = 'App' and kind = 'Web API'")
    assert [r["tfm"] for r in got.collect()] == ["net9.0"]


def test_nearest_solutions(spark):
    files = spark.createDataFrame([("All.sln", "x"), ("src/a/A.csproj", ""), ("src/a/B.csproj", ""), ("src/b/b.sln", ""), ("src/b/A.csproj", ""), ("src/c/x.vbproj", "")], "path string, text string")
    folders = spark.createDataFrame([(f, i) for i, f in enumerate(["src/a", "src/a/x/y", "src/b/z", "src/c", "", None, "src", "src/a", "srcs/a"])], "folder string, found int")
    got = {r["folder"]: r["found"] for r in workspace.nearest_solutions(files, folders).collect()}
    assert got == {"src/a": "src/a/A.csproj", "src/a/x/y": "src/a/A.csproj", "src/b/z": "src/b/b.sln", "src/c": "All.sln", "": "All.sln", None: None, "src": "All.sln", "srcs/a": "All.sln"}
    assert workspace.nearest_solutions(files.where("false"), folders).where("found is not null").count() == 0


def test_growing_logs_in_a_ring(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "sub").mkdir()
    lines = tail.ring_tail(tail.growing(spark, str(logs), "mcp-*.log"), 3)
    seen = {}

    def take(batch, _):
        for r in batch.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x")).collect():
            seen[r["path"]] = [tuple(x) for x in r["x"]]

    def run():
        q = lines.writeStream.foreachBatch(take).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def add(name, text):
        with open(logs / name, "a", newline="") as f:
            f.write(text)

    add("mcp-a.log", "one\r\ntwo\nthr")
    add("mcp-b.log", "".join(f"b{i}\n" for i in range(50)))
    add("other.log", "no\n")
    add("sub/mcp-c.log", "no\n")
    run()
    assert seen == {"mcp-a.log": [(1, "one"), (2, "two")], "mcp-b.log": [(48, "b47"), (49, "b48"), (50, "b49")]}
    seen.clear()
    add("mcp-a.log", "ee\nfour\nfive\n")
    run()
    assert seen == {"mcp-a.log": [(3, "three"), (4, "four"), (5, "five")]}
    seen.clear()
    run()
    assert seen == {}


def test_tail_of_the_latest_log(spark, tmp_path):
    _make(tmp_path, {"mcp-1.log": "old\n", "mcp-[2]*.log": "".join(f"Line {i}\n" for i in range(30)), "sub/mcp-3.log": "deeper\n", "other.log": "newer\n"})
    for name, at in (("mcp-1.log", 100), ("mcp-[2]*.log", 200), ("sub/mcp-3.log", 300), ("other.log", 300)):
        os.utime(tmp_path / name, (at, at))
    read = lambda *a: [tuple(r) for r in tail.tail_latest(spark, str(tmp_path), *a).collect()]
    assert read("mcp-*.log", 2) == [("mcp-[2]*.log", 29, "Line 28"), ("mcp-[2]*.log", 30, "Line 29")]
    assert [r[1] for r in read("mcp-*.log", 3, "LINE 1")] == [18, 19, 20] and read("none*.log") == [] and len(read("mcp-*.log", 99, " ")) == 30


def test_logs_are_read_in_spans(tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "BYTES", 20)
    text = "".join(f"line {i} é{'x' * (i % 30)}\n" for i in range(60)) + "open"
    _make(tmp_path, {"a.log": text})
    r = scan.LogsReader({"path": str(tmp_path)})
    spans = r.partitions({}, r.latestOffset())
    got = [row for s in spans for row in r.read(s)]
    assert len(spans) > 30 and [x[2] for x in got] == text.split("\n")[:-1]
    assert all(text.encode()[at:].startswith(line.encode()) for _, at, line in got)
    assert r.partitions(r.latestOffset(), r.latestOffset()) == [] and len(r.partitions({"a.log": 10**9}, r.latestOffset())) == len(spans)


ROW = "path string, text string, at int"


def test_write_through_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"f{i}", f"t{i}", 0) for i in range(200)]
    sinks.write_files(spark.createDataFrame(rows, ROW), path, 16)
    names = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = names()
    updates = [("f1", "new", 1), ("f1", "newer", 2), ("f1", "a", 3), ("added", "x", 1), ("f2", "zz", 1), ("f2", None, 2)]
    df = spark.createDataFrame(updates, ROW)
    touched = {r["b"] for r in df.select(sinks.bucket_of(F.col("path"), 16).alias("b")).collect()}
    want = {p: t for p, t, _ in rows} | {"f1": "a", "added": "x"}
    del want["f2"]
    for _ in range(2):
        sinks.write_through(spark, df, path, "bucketed", "at")
        assert {r["path"]: r["text"] for r in spark.table("bucketed").collect()} == want
    after = names()
    same = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert len(touched) < 16 and same and all(after.get(f) == before[f] for f in same)
    assert sinks.write_through(spark, df.where("false"), path, "bucketed").count() == 200
    spark.catalog.dropTempView("bucketed")


def test_write_through_empties_a_bucket(spark, tmp_path):
    path = str(tmp_path / "files")
    sinks.write_files(spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], ROW), path, 1_000)
    left = sinks.write_through(spark, spark.createDataFrame([("a", None, 0)], ROW), path, "emptied")
    assert [tuple(r) for r in left.collect()] == [("b", "2")]
    spark.catalog.dropTempView("emptied")


def test_stream_of_updates(spark, tmp_path):
    path, inbox = str(tmp_path / "files"), str(tmp_path / "in")
    sinks.write_files(spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], ROW), path, 4)
    for n, rows in enumerate([[("a", "3", 1)], [("b", None, 2), ("c", "4", 2)]]):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(inbox)
        q = sinks.stream_updates(spark.readStream.schema(ROW).parquet(inbox), path, "streamed", str(tmp_path / "c"), "at").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None, n
    assert sorted(map(tuple, spark.read.parquet(path).select("path", "text").collect())) == [("a", "3"), ("c", "4")]
    spark.catalog.dropTempView("streamed")
