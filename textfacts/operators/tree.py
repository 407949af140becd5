"""Paths as trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

#: What stands in front of an entry, and in front of the last of its folder; and a level's indent.
BRANCH, LAST_BRANCH, INDENT = "├── ", "└── ", 4
#: Folders that a scan does not enter.
EXCLUDED = [".git", ".vs", "bin", "obj"]


def segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"^[a-z]+://|[?#].*$", ""), "/"), lambda x: x != "")


def excluded(path: Column, names: list[str] | None = None) -> Column:
    """Whether a folder above the file has one of the names, in any case."""
    parts = F.transform(segments(path), F.lower)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit([n.lower() for n in names or EXCLUDED]))


def tree(paths: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """Nodes to a depth: parent, name, depth, is_dir, rank among siblings (folders first, any case) and is_last."""
    deep = max(depth, 0)
    parts = paths.select(segments(F.col(path)).alias("s"))
    node = parts.select("s", F.posexplode(F.slice("s", 1, deep + 1) if deep else F.slice("s", 1, 1)).alias("depth", "name"))
    node = node.select(F.array_join(F.slice("s", 1, F.col("depth")), "/").alias("parent"), "name", F.col("depth").cast("long"), (F.col("depth") < F.size("s") - 1).alias("is_dir"))
    node = node.groupBy("parent", "name", "depth").agg(F.bool_or("is_dir").alias("is_dir"))
    siblings = Window.partitionBy("parent").orderBy(F.col("is_dir").desc(), F.upper("name"), "name")
    count = F.count("*").over(Window.partitionBy("parent"))
    return node.select("*", F.row_number().over(siblings).cast("long").alias("rank")).withColumn("is_last", F.col("rank") == count)


def printed(paths: DataFrame, path: str, root: str = ".", depth: int = 2, names: list[str] | None = None, range_rows: int = order.RANGE_ROWS) -> DataFrame:
    """line_no and text of a folder's tree as it is printed: its name, then its entries to a depth, each folder's before its files, both by name in any case.

    The order is that of one sort key: of each segment whether it is a file, its name in upper case and its name. A folder's last entry is the greatest
    of its keys, which tasks find apart before they meet. Folders of the names in `names`, and all below them, are left out. Null and empty paths are no entries.
    """
    deep = max(depth, 0)
    bar, end = F.lit("\x01"), F.lit("\x00")
    part = lambda flag, s: F.concat(flag, F.upper(s), bar, s)
    own = paths.select(segments(F.col(path)).alias("s"))
    node = own.select("s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(deep)))).alias("n")).where("n >= 1 and n <= size(s)") if deep else own.where("false").select("s", F.lit(1).alias("n"))
    folders = F.slice("s", 1, F.when(F.col("n") < F.size("s"), F.col("n")).otherwise(F.col("n") - 1))
    node = node.where(~F.arrays_overlap(F.transform(folders, F.lower), F.lit([n.lower() for n in names or EXCLUDED])))
    above = F.array_join(F.transform(F.slice("s", 1, F.col("n") - 1), lambda x: part(F.lit("0"), x)), "\x00")
    node = node.select(above.alias("above"), (F.col("n") - 1).alias("depth"), F.element_at("s", F.col("n")).alias("name"), (F.col("n") < F.size("s")).alias("is_dir"))
    node = node.groupBy("above", "depth", "name").agg(F.bool_or("is_dir").alias("is_dir"))
    node = node.withColumn("own", part(F.when(F.col("is_dir"), "0").otherwise("1"), F.col("name")))
    node = node.join(node.groupBy("above").agg(F.max("own").alias("last")), "above")
    line = F.concat(F.repeat(F.lit(" "), F.col("depth") * INDENT), F.when(F.col("own") == F.col("last"), LAST_BRANCH).otherwise(BRANCH), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    lines = node.select(F.concat(F.when(F.col("depth") == 0, "").otherwise(F.concat("above", end)), "own").alias("key"), line.alias("text"))
    head = paths.sparkSession.range(1).select(F.lit("").alias("key"), F.lit(root).alias("text"))
    return order.numbered(head.unionByName(lines), F.col("key"), "line_no", range_rows).select("line_no", "text")
