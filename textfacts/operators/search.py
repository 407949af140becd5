"""Files as lines: search, ranges, previews and tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def file_lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each line of each file, numbered from 1."""
    return files.select("*", F.posexplode(X.lines(F.col(text))).alias("pos", "line")).drop(text).withColumn("line_no", F.col("pos").cast("long") + 1).drop("pos")


def physical_lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each entry of each file that a CR or LF ends, numbered from 0; CRLF yields an empty one more."""
    return files.select(key, F.posexplode(X.lines_physical(F.col(text))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def search(files: DataFrame, key: str, pattern: str, regex: bool = False, text: str = "text") -> DataFrame:
    """Lines that hold a pattern, in any case. A plain pattern without a line end is looked for in whole texts first: others have no such line."""
    if not pattern.strip():
        raise ValueError("the pattern is empty")
    if regex:
        hit: Column = F.rlike(F.col("line"), F.lit(f"(?iu){pattern}"))
    else:
        hit = X.contains_ci(F.col("line"), pattern)
        if not set("\r\n") & set(pattern):
            files = files.where(X.contains_ci(F.col(text), pattern))
    return file_lines(files.select(key, text), key, text).where(hit).select(key, "line_no", "line")


def top(matches: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The first matches by file and line: a top-k heap for each task, no full sort."""
    return matches.orderBy(key, "line_no").limit(most)


def summary(files: DataFrame, matches: DataFrame, most: int = 50) -> DataFrame:
    """Files scanned, matches in all, and whether the cap was reached."""
    total = matches.agg(F.count("*").alias("total"))
    scanned = files.agg(F.count("*").alias("files_scanned"))
    return scanned.join(total).select("files_scanned", "total", (F.col("total") >= most).alias("limit_reached"))


def preview(files: DataFrame, key: str, whole: int = X.WHOLE_FILE_LINES, head: int = X.PREVIEW_LINES) -> DataFrame:
    """Each file whole if it has at most `whole` lines, else its first `head` lines."""
    parts = X.lines_kept(F.col("text"))
    n = F.size(parts)
    return files.select(key, n.cast("long").alias("n_lines"), (n > whole).alias("cut"), F.when(n <= whole, F.replace("text", F.lit("\r\n"), F.lit("\n"))).otherwise(F.array_join(F.slice(parts, 1, head), "\n")).alias("content"))


def line_range(files: DataFrame, key: str, start: int, count: int) -> DataFrame:
    """Lines start to start + count - 1 of each file, numbered; short tells that the file ends before."""
    if start < 1 or count < 1:
        raise ValueError("start and count are 1 or more")
    if start + count - 1 > 2**31 - 1:
        raise ValueError("start + count is too large")
    found = X.lines(F.col("text"))
    some = files.select(key, F.size(found).cast("long").alias("n"), F.posexplode(F.slice(found, start, count)).alias("i", "line"))
    no = F.col("i").cast("long") + start
    return some.select(key, no.alias("line_no"), F.concat(no.cast("string"), F.lit(" | "), "line").alias("numbered"), (F.col("n") < start + count - 1).alias("short"))


def tail(log: DataFrame, by: list[str], order: str, text: str, last: int = 200, keyword: str | None = None) -> DataFrame:
    """The last rows of each log that hold a keyword in any case; a blank keyword is none. The filter comes before the cut."""
    if keyword and keyword.strip():
        log = log.where(X.contains_ci(F.col(text), keyword))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return log.withColumn("_n", rank).where(F.col("_n") <= last).drop("_n")


def latest(log: DataFrame, group: str, age: str) -> DataFrame:
    """The rows of the newest group."""
    newest = log.agg(F.max_by(F.col(group), F.struct(age, group)).alias(group))
    return log.join(F.broadcast(newest), group, "left_semi")  # one row
