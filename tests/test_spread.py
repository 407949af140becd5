"""Sources that lie in one file are lexed by many tasks, and what is read twice is lexed once."""

import pytest
from pyspark.sql import functions as F

from textfacts.operators import code, references
from textfacts.sources import sinks

TEXT = "using System;\nnamespace N { class Box { int x; string Name(int a) { return Name(a); } string Name() => null; class Inner { void Name(long b) { } } } class Box { void Name() { } } }"
BODY = "string Name(int a) { return Name(a); }"


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"src/P{i}.cs", TEXT if i % 2 else TEXT.replace("Box", f"Box{i}")) for i in range(64)] + [(None, TEXT), ("none.cs", None)]
    return spark.createDataFrame(rows, "path string, text string").coalesce(1)


def _tasks(df):
    return df.select(F.spark_partition_id().alias("n")).distinct().count()


def test_members_are_spread(files):
    assert _tasks(code.members(files)) > 1


def test_outlines_and_notes_are_spread(files):
    assert _tasks(code.outlines(files)) > 1 and _tasks(code.with_notes(files)) > 1
    assert code.with_notes(files.withColumn("m", F.create_map(F.lit(1), "path"))).count() == 66  # maps have no hash


def test_method_body_is_lexed_once(files):
    got = code.method_body(files, "Box", "Name")
    assert _tasks(got) > 1
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["path"], r["source"]) for r in got.collect()) == sorted((f"src/P{i}.cs", BODY) for i in range(1, 64, 2))
    assert code.method_body(files, "Inner", "Name").select("source").distinct().collect()[0]["source"] == "void Name(long b) { }"


def test_index_is_spread_and_kept(spark, files, tmp_path):
    found = references.index(files)
    assert _tasks(found) > 1
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    again = sinks.kept(found)
    assert "MapInArrow" not in again._jdf.queryExecution().optimizedPlan().toString()
    assert again.schema == found.schema and sorted(map(repr, again.collect())) == sorted(map(repr, found.collect()))


def test_index_of_one_name(files):
    rows = lambda found: sorted(map(repr, references.find_references(found, "src/P2.cs", "Box2").collect()))
    some = references.index(files, names=["Box2"])
    assert rows(some) == rows(references.index(files))
    assert {r["path"] for r in some.select("path").distinct().collect()} == {f"src/P{i}.cs" for i in (2, 20, 22, 24, 26, 28)}
    assert {r["name"] for r in some.where("role <> 'declaration'").collect()} <= {"Box2"}
