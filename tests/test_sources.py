"""C# sources, workspaces, sinks and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from textfacts.functions import csharp
from textfacts.operators import code, graph
from textfacts.sources import settings, sinks, workspace
from textfacts.streaming import tail

CODE = '''namespace A.B;
// class Fake {
public class C<T> : Base where T : class
{
    static readonly Func<int> F = () => { return 1; };
    public string Name { get; private set; } = "x;{";
    public int Count => 3;
    public C(int a, Dictionary<string, int> b) : base(a) { _a = a; }
    public int M(int x) { if (x > 0) { return $"{d["}"]}".Length; } return '{'; }
    public int M() => @"""{".Length;
    enum K { A, B }
}
record R(int X, string Y);
'''


def test_declarations():
    got = [(d.kind, d.name, d.n_params) for d in csharp.declarations(CODE)]
    assert got == [("namespace", "A.B", 0), ("class", "C", 0), ("field", "F", 0), ("property", "Name", 0), ("property", "Count", 0), ("ctor", "C", 2), ("method", "M", 1), ("method", "M", 0), ("enum", "K", 0), ("record", "R", 0)]
    bare = csharp.without_bodies(CODE)
    assert "public int M(int x) { }" in bare and "{ get; private set; }" in bare and "return 1" in bare and "Length" not in bare
    for odd in (None, "", "}", "{", 'class A { string s = "', "/*", "class A { void F(", "\x00 class"):
        csharp.declarations(odd)
        assert csharp.without_bodies(odd) is None or isinstance(csharp.without_bodies(odd), str)


def test_method_body(spark):
    files = spark.createDataFrame([("a.cs", CODE), ("b.cs", None), ("c.cs", "class D { void M() { } }")], "path string, text string")
    assert [tuple(r) for r in code.method_body(files, "C", "M").collect()] == [("a.cs", CODE[CODE.index("public int M(int x)") : CODE.index("    public int M()")].strip())]
    assert code.members(files.where("false")).count() == 0
    assert code.skeletons(files).count() == 3


def test_workspace(spark, tmp_path):
    (tmp_path / "src" / "App").mkdir(parents=True)
    (tmp_path / "src" / "Lib").mkdir()
    (tmp_path / "src" / "bin").mkdir()
    (tmp_path / "All.sln").write_text('Project("{F}") = "App", "src\\App\\App.csproj", "{1}"\nEndProject\n')
    (tmp_path / "src/App/App.csproj").write_text('<Project><TargetFramework>net9.0</TargetFramework><OutputType>Exe</OutputType><ProjectReference Include="..\\Lib\\Lib.csproj" /><ProjectReference Include="..\\No.csproj" /></Project>')
    (tmp_path / "src/Lib/Lib.csproj").write_text('<Project><TargetFrameworks>a;b</TargetFrameworks><PackageReference Include="xunit" Version="2" /></Project>')
    (tmp_path / "src/bin/Old.csproj").write_text("<Project/>")
    got = [tuple(r) for r in workspace.load(spark, str(tmp_path), "w_").select("name", "path", "tfm", "output_type", "kind").collect()]
    assert got == [("App", "src/App/App.csproj", "net9.0", "Exe", "Library"), ("Lib", "src/Lib/Lib.csproj", "a;b", None, "Test")]
    assert sorted(tuple(r)[:2] for r in spark.table("w_project_refs").collect()) == [("src/App/App.csproj", "src/Lib/Lib.csproj"), ("src/App/App.csproj", "src/No.csproj")]
    files = spark.table("w_files")
    assert [tuple(r) for r in workspace.solution_projects(files).collect()] == [("All.sln", "src/App/App.csproj")]
    assert workspace.nearest_solution(files, "src/Lib").first().path == "src/Lib/Lib.csproj"  # nearer than the solution
    assert workspace.nearest_solution(files, "src").first().path == "All.sln" and workspace.nearest_solution(files, "src/App/x/y").first().path == "src/App/App.csproj"
    assert workspace.nearest_solution(files.where("path != 'All.sln'"), "src/Lib").first().path == "src/Lib/Lib.csproj"
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        workspace.load(spark, str(tmp_path / "none"), "w_")
    with pytest.raises(ValueError, match="Error X"):
        workspace.load(spark, str(tmp_path), "w_", ["Warning: a", "Failure: Error X"])
    assert spark.table("w_projects").count() == 2  # as before
    assert workspace.reset(spark, "w_") == 4 and workspace.reset(spark, "w_") == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "files")
    row = "path string, text string"
    spark.createDataFrame([("a", "1"), ("b", "2")], row).write.parquet(path)
    for _ in range(2):
        after = sinks.upserted(spark.read.parquet(path), spark.createDataFrame([("a", "3"), ("b", None), ("c", "4")], row))
        sinks.overwrite(spark, after, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "3"), ("c", "4")]
    log = str(tmp_path / "log")
    sinks.append_log(spark.sql("select timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id as int)) ts, id from range(20)"), log)
    assert sorted(r.id for r in sinks.read_log(spark, log).collect()) == list(range(6, 20))


def test_project_kinds(spark):
    rows = [("a/App.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"></Project>'), ("b/B.Tests.csproj", '<Project Sdk="Microsoft.NET.Sdk.Web"></Project>'), ("c/C.csproj", '<Project Sdk="Microsoft.NET.Sdk.Worker"></Project>'), ("d/D.csproj", '<Project><PackageReference Include="NUnit" /><FrameworkReference Include="Microsoft.AspNetCore.App" /></Project>'), ("e/E.csproj", "<Project><OutputType> </OutputType></Project>")]
    found = workspace.projects(spark.createDataFrame(rows, "path string, text string"))
    assert {r.name: r.kind for r in found.collect()} == {"App": "Web API", "B.Tests": "Test", "C": "Worker", "D": "Test", "E": "Library"}
    refs = workspace.project_refs(spark.createDataFrame(rows, "path string, text string"))
    assert {r.name: (r.tfm, r.output_type, r.references) for r in graph.described(found, refs).collect()}["App"] == ("(unknown)", "(unknown)", "(none)")


def test_logs_of_the_service(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"2026-01-{d:02d}", "t", "x" * d if d % 2 else None) for d in range(1, 19)]
    sinks.log_outputs(spark.createDataFrame(rows, "ts string, tool string, result string").withColumn("ts", F.col("ts").cast("timestamp")), path)
    assert sorted(sinks.prune_log(spark, path)) == [f"day=2026-01-{d:02d}" for d in range(1, 5)]
    assert sorted((r.day.day, r.length, r.tokens) for r in spark.read.parquet(path).collect()) == [(d, d if d % 2 else 0, (d if d % 2 else 0) // 4) for d in range(5, 19)]
    asked = spark.createDataFrame([("1", "m", '{"a": 1}'), (None, "n", None), (None, None, "x")], "id string, method string, params string").withColumn("ts", F.current_timestamp())
    try:
        spark.conf.set("spark.textfacts.requests.log", "False")
        assert not sinks.log_requests(asked, str(tmp_path / "rpc"))
        spark.conf.set("spark.textfacts.requests.log", "1")
        spark.conf.set("spark.textfacts.requests.maxChars", "4")
        assert sinks.log_requests(asked, str(tmp_path / "rpc"))
        spark.conf.set("spark.textfacts.requests.maxChars", "none")
        assert settings.settings(spark) == (True, 8000, None)
    finally:
        spark.conf.unset("spark.textfacts.requests.log")
        spark.conf.unset("spark.textfacts.requests.maxChars")
    assert sorted((r.kind, r.params) for r in spark.read.parquet(str(tmp_path / "rpc")).collect()) == [("message", "x"), ("notification", "(none)"), ("request", '{"a"... [truncated 3 chars]')]


def test_write_through(spark, tmp_path):
    path, row = str(tmp_path / "files"), "path string, text string"
    spark.createDataFrame([("a", "1")], row).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("through")
    sinks.write_through(spark, spark.createDataFrame([("a", "2"), ("b", "3")], row), path, "through")
    assert sorted(map(tuple, spark.table("through").collect())) == [("a", "2"), ("b", "3")]
    spark.catalog.dropTempView("through")


def test_problems():
    assert csharp.problems(CODE) == [] and csharp.problems(None) == []
    assert csharp.problems("class A {\n void F( }\n") == ["line 1: { is not closed", "line 2: ( is not closed", "line 2: unexpected }"]


def test_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text("src/A.cs(1,2): error X1: no\nnothing\nsrc/A.cs(3,2): error X1: no\n")
    counts = tail.diagnostic_counts(tail.log_lines(spark, str(tmp_path / "logs")))
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.awaitTermination(60)
    finally:
        query.stop()
    assert [(r.severity, r.code, r.n) for r in spark.table("counted").collect()] == [("error", "X1", 2)]
