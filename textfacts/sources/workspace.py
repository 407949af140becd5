"""Solutions and projects as tables, read by Spark from any store, and registered as views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projects as P
from ..functions import text as X
from ..operators import graph, tree
from . import scan

VIEWS = ("files", "projects", "project_refs", "assembly_refs")
_PROJECT_LINE, _PROJECT_REF, _PACKAGE, _SDK = P.PROJECT_LINE, P.PROJECT_REF, P.PACKAGE, P.SDK
TEST_REFERENCES, TEST_NAMES, KINDS, SDK_REFERENCES = P.TEST_REFERENCES, P.TEST_NAMES, P.KINDS, P.SDK_REFERENCES


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below the root, with forward slashes), text and modified of all files under a folder; folders that scans don't enter are left out.

    Excluded folders aren't even listed where Arrow knows the store; of others Spark lists all. A file is one row, so its size is bounded by a task's
    memory. An empty folder gives no rows.
    """
    if scan.readable(root):
        scan.register(spark)
        return spark.read.format("textfacts_files").option("glob", ",".join(braced(glob))).load(root).select("path", "text", "modified")
    whole = spark.read.text(root, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    own = whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    base = F.lit(root.split("://")[-1].removeprefix("file:").strip("/") + "/")
    at = F.instr("path", base)
    below = F.when(at > 0, F.substring("path", at + F.char_length(base), F.char_length("path"))).otherwise(F.col("path"))
    return own.withColumn("path", F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))).where(~tree.excluded(F.col("path")))


def braced(glob: str) -> list[str]:
    """A pattern with at most one list in braces, as patterns without."""
    head, _, rest = glob.partition("{")
    some, _, end = rest.partition("}")
    return [head + x + end for x in some.split(",")] if rest else [glob]


def _table(spark: SparkSession, root: str, name: str, sources: DataFrame | None) -> DataFrame:
    """projects, project_refs, assembly_refs or solution_projects of a folder, from its files where Arrow doesn't know the store."""
    if sources is not None:
        return {"projects": projects, "project_refs": project_refs, "assembly_refs": assembly_refs, "solution_projects": solution_projects}[name](sources)
    return spark.read.format("textfacts_projects").option("table", name).load(root)


def _from(folder: Column, path: Column) -> Column:
    """A path of a project file, taken from the folder that it stands in; .. and . are resolved."""
    parts = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    step = lambda done, x: F.when(x == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when((x == ".") | (x == ""), done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def references(text: Column) -> Column:
    """What a project file refers to outside of the solution, and what its SDK brings along."""
    sdk = F.lower(F.regexp_extract(text, _SDK, 1))
    brought = F.lit(None).cast("string")
    for name, framework in SDK_REFERENCES.items():
        brought = F.when(sdk == name, framework).otherwise(brought)
    return F.concat(F.regexp_extract_all(text, F.lit(_PACKAGE), 1), F.when(brought.isNull(), F.array().cast("array<string>")).otherwise(F.array(brought)))


def project_kind(refs: Column, assembly: Column) -> Column:
    """Test by what is referred to or the assembly's name, else Web API, Worker or Library; `refs` is one text of all references."""
    named = graph.classified(assembly, [("Test", TEST_NAMES)], "")
    return F.when(named == "Test", named).otherwise(graph.classified(refs, [("Test", TEST_REFERENCES), *KINDS], "Library"))


def projects(sources: DataFrame) -> DataFrame:
    """project_id (its path), name, path, tfm, output_type (null if not told), assembly_name and kind of each project file among (path, text)."""
    own = sources.where(F.lower("path").endswith("proj"))
    stem = X.file_stem(F.col("path"))
    tfm = F.coalesce(X.tag_value(F.col("text"), "TargetFramework"), X.tag_value(F.col("text"), "TargetFrameworks"))
    assembly = F.coalesce(X.tag_value(F.col("text"), "AssemblyName"), stem)
    return own.select(
        F.col("path").alias("project_id"),
        stem.alias("name"),
        "path",
        tfm.alias("tfm"),
        X.tag_value(F.col("text"), "OutputType").alias("output_type"),
        assembly.alias("assembly_name"),
        project_kind(F.array_join(references(F.col("text")), "\n"), assembly).alias("kind"),
    )


def solution_projects(sources: DataFrame) -> DataFrame:
    """solution and project_id of the projects that solution files name."""
    own = sources.where(F.lower("path").endswith(".sln"))
    named = own.select(F.col("path").alias("solution"), F.explode(F.regexp_extract_all("text", F.lit(_PROJECT_LINE), 1)).alias("p"))
    return named.select("solution", _from(_folder(F.col("solution")), F.col("p")).alias("project_id")).distinct()


def project_refs(sources: DataFrame) -> DataFrame:
    """src_id, dst_id and ord of references between projects, each once; dst_id may name a file that isn't there."""
    own = sources.where(F.lower("path").endswith("proj"))
    found = own.select(F.col("path").alias("src_id"), F.posexplode(F.regexp_extract_all("text", F.lit(_PROJECT_REF), 1)).alias("ord", "p"))
    return found.select("src_id", _from(_folder(F.col("src_id")), F.col("p")).alias("dst_id"), "ord").groupBy("src_id", "dst_id").agg(F.min("ord").alias("ord"))


def assembly_refs(sources: DataFrame) -> DataFrame:
    """project_id and name of the packages and assemblies that projects refer to."""
    own = sources.where(F.lower("path").endswith("proj"))
    return own.select(F.col("path").alias("project_id"), F.explode(references(F.col("text"))).alias("path")).distinct()


def nearest_solutions(sources: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """Each of many folders with `found`: the path of the solution, else project, in the nearest folder at or above it that has either; null without one.

    A folder is exploded to itself and those above it, which meet solution and project files by equality; of a folder's files only the best counts,
    and of the hits the deepest. Equal folders are one; a null folder has none.
    """
    kind = F.when(F.lower("path").endswith(".sln"), 0).when(F.lower("path").endswith(".csproj"), 1)
    best = F.min_by("path", F.struct(kind, "path"))
    there = sources.where(kind.isNotNull()).groupBy(_folder(F.col("path")).alias("_at")).agg(best.alias("_path"))
    own = folders.select(F.col(folder).alias(folder)).distinct()
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hits = own.select(folder, F.posexplode(above).alias("_depth", "_at")).join(there, "_at")
    found = hits.groupBy(F.col(folder).alias("_of")).agg(F.max_by("_path", "_depth").alias("found"))
    return own.join(found, own[folder] == found["_of"], "left").select(folder, "found")


def nearest_solution(sources: DataFrame, folder: str) -> DataFrame:
    """path of the solution, else project, in the nearest folder at or above `folder` that has either; one row or none."""
    one = sources.sparkSession.range(1).select(F.lit(folder).alias("folder"))
    return nearest_solutions(sources, one).where("found is not null").select(F.col("found").alias("path"))


def load(spark: SparkSession, root: str, prefix: str = "", diagnostics: Iterable[str] = ()) -> DataFrame:
    """Register the views of a workspace and return its projects by name in any case.

    diagnostics are messages of whatever restored or built the workspace. Views are swapped only when all tables could be
    planned, a project was found and no diagnostic tells of an error; otherwise ValueError is raised and the views stay as they were.
    """
    told = list(dict.fromkeys(diagnostics))
    if any("error" in d.lower() for d in told):
        raise ValueError(f"cannot load {root}:\n" + "\n".join(told))
    scan.register(spark)
    project_files = None if scan.readable(root) else files(spark, root, "*.{sln,csproj}")
    found = {"files": files(spark, root)} | {name: _table(spark, root, name, project_files) for name in VIEWS[1:]}
    if found["projects"].limit(1).count() == 0:
        raise ValueError(f"no project under {root}")
    for name, df in found.items():
        df.createOrReplaceTempView(prefix + name)
    return found["projects"].orderBy(F.upper("name"), "name", "path")


def reset(spark: SparkSession, prefix: str = "") -> int:
    """Drop the views of a workspace; how many there were."""
    return sum(spark.catalog.dropTempView(prefix + name) for name in VIEWS)


def stop(spark: SparkSession, prefix: str = "") -> None:
    """Drop the views of a workspace and end the session."""
    reset(spark, prefix)
    spark.stop()
