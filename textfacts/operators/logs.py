"""Build and test output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: What lines of build and test output look like.
DIAGNOSTIC = r"(?i)^([^\r\n]+\([0-9]+,\s*[0-9]+\))\s*:\s*(error|warning)\s+(\S+)\s*:\s*([^\r\n]*)$"
SUMMARY = r"(Passed|Failed)!\s+-\s+Failed:\s*([0-9]+),\s*Passed:\s*([0-9]+),\s*Skipped:\s*([0-9]+),\s*Total:\s*([0-9]+)"
TOTAL = r"(?i)Total tests:\s*([0-9]+)"
PASSED = r"(?i)^\s*Passed:\s*([0-9]+)\s*$"
FAILED = r"(?i)^\s*Failed:\s*([0-9]+)\s*$"
#: Lines that a failed test's report begins with, in the order in which they are tried.
ANCHORS = [
    r"^\[xUnit\.net[^\]]*\]\s+(.+?)\s+\[FAIL\]\s*$",
    r"(?i)^\s*Failed\s*:\s*(.+)\s*$",
    r"^\s*Failed\s+(.+?)(?:\s+\[[0-9.]+\s*ms\])?\s*$",
]
ERROR_LABEL, STACK_LABEL = "Error Message:", "Stack Trace:"
MOST_DIAGNOSTICS, MOST_FAILED, TOTALS_WINDOW = 20, 5, 24
#: A log is split into ranges of so many places.
RANGE = 65_536


def diagnostics(lines: DataFrame, line: str = "line") -> DataFrame:
    """location, severity (lower case), code and message of the lines that are diagnostics, with all other columns. They aren't de-duplicated.

    A line is matched once, and only if it has parentheses: the match, rewritten into its parts, which hold no line ends, is exploded where there is one.
    """
    parts = F.when(F.contains(line, F.lit("(")) & F.contains(line, F.lit(")")), F.split(F.regexp_replace(line, DIAGNOSTIC, "\n$2\n$3\n$1\n$4"), "\n"))
    got = lines.select("*", F.explode(F.filter(F.array(parts), lambda x: F.size(x) == 5)).alias("_d"))
    return got.select("*", F.lower(F.col("_d")[1]).alias("severity"), F.col("_d")[2].alias("code"), X.trimmed(F.col("_d")[3]).alias("location"), X.trimmed(F.col("_d")[4]).alias("message")).drop("_d")


def errors_first(found: DataFrame, order: list[str], most: int = MOST_DIAGNOSTICS) -> DataFrame:
    """The first diagnostics, errors before warnings."""
    return found.orderBy((F.col("severity") != "error").cast("int"), *order).limit(most)


def rendered(found: DataFrame, severity: Column, line_no: Column, code: Column, message: Column) -> DataFrame:
    """The errors and warnings with `shown`: their severity, line, id and message as one line."""
    shown = F.format_string("[%s] Line %s: (%s) %s", severity, line_no.cast("string"), code, message)
    return found.where(F.lower(severity).isin("error", "warning")).withColumn("shown", shown)


def last_summary(runs: DataFrame, by: str, pos: str, line: str = "line") -> DataFrame:
    """Totals of the last summary line of each run; earlier ones don't count."""
    got = runs.where(F.rlike(line, F.lit(SUMMARY))).groupBy(by).agg(F.max_by(line, pos).alias("l"))
    last = rf"(?s)^.*{SUMMARY}"  # of several in a line the last
    names = ("failed", "passed", "skipped", "total")
    return got.select(by, *(F.regexp_extract("l", last, i + 2).cast("long").alias(n) for i, n in enumerate(names)))


def last_totals(lines: DataFrame, by: str, pos: str, line: str = "line", range_: int = RANGE) -> DataFrame:
    """Totals of each run's last block of totals: a line with the number of tests after which, within TOTALS_WINDOW lines, both the passed and the failed ones are told.

    Lines are those that CR and LF each end, numbered by `pos`; of several lines of a kind in a block, the last counts.
    Ranges of a log are looked at apart, each with the few lines after it that its last blocks may need.
    """
    number = lambda pattern: F.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1).cast("long"))
    told = lines.select(by, pos, number(TOTAL).alias("total"), number(PASSED).alias("p"), number(FAILED).alias("f")).where("coalesce(total, p, f) is not null")
    near = F.floor(F.col(pos) / range_).cast("long")
    told = told.withColumn("_own", near).withColumn("_r", F.explode(F.sequence(F.floor((F.col(pos) - (TOTALS_WINDOW - 1)) / range_).cast("long"), near)))
    ahead = Window.partitionBy(by, "_r").orderBy(pos).rangeBetween(0, TOTALS_WINDOW - 1)
    told = told.withColumn("passed", F.last("p", ignorenulls=True).over(ahead)).withColumn("failed", F.last("f", ignorenulls=True).over(ahead))
    best = told.where("_r = _own and total is not null and passed is not null and failed is not null").groupBy(by).agg(F.max_by(F.struct("failed", "passed", "total"), pos).alias("t"))
    return best.select(by, "t.failed", "t.passed", F.lit(0).cast("long").alias("skipped"), "t.total")


def totals(lines: DataFrame, by: str, pos: str, line: str = "line") -> DataFrame:
    """The totals of each run: those of its last summary line, else of its last block of totals."""
    first = last_summary(lines, by, pos, line)
    return first.unionByName(last_totals(lines, by, pos, line).join(first.select(by), by, "left_anti"))


def failed_name(line: Column) -> Column:
    """The name of the test whose failure a line reports, else null."""
    return F.coalesce(*(F.nullif(X.trimmed(F.regexp_extract(line, p, 1)), F.lit("")) for p in ANCHORS))


def blocks(lines: DataFrame, by: str, pos: str, anchor: Column, most: int = MOST_FAILED, range_: int = RANGE) -> DataFrame:
    """Lines with the number of the block that they stand in: from an anchor up to the next one. The first blocks of each log are kept; lines before the first anchor aren't in one.

    A prefix scan: the anchors of each range of a log are counted, the counts of the ranges before are carried over to it, and within it anchors
    are counted line by line. So one log is split over many tasks, and ranges behind its first blocks are dropped before they are sorted.
    Lines whose log is null are in no block.
    """
    own = lines.withColumn("_anchor", F.coalesce(anchor, F.lit(False)).cast("long")).withColumn("_r", F.floor(F.col(pos) / range_).cast("long"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = own.groupBy(by, "_r").agg(F.sum("_anchor").alias("_n")).withColumn("_before", before).where((F.col("_before") <= most) & (F.col("_before") + F.col("_n") > 0))
    so_far = F.sum("_anchor").over(Window.partitionBy(by, "_r").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    own = own.join(carried.drop("_n"), [by, "_r"]).withColumn("block", F.col("_before") + so_far)
    return own.where((F.col("block") >= 1) & (F.col("block") <= most)).drop("_anchor", "_r", "_before")


def failures(lines: DataFrame, by: str, pos: str, line: str = "line", most: int = MOST_FAILED, range_: int = RANGE) -> DataFrame:
    """block, name, error and stack of the first failed tests of each log.

    The error is what stands after its label, or without one after the first line, up to the stack's label, as one line; the stack
    is what follows its label, as far as it is shown. A stack before the error's label leaves no error.
    """
    named = lines.withColumn("_name", failed_name(F.col(line)))
    own = blocks(named, by, pos, F.col("_name").isNotNull(), most, range_)
    low = F.lower(line)
    e, s = F.instr(low, F.lit(ERROR_LABEL.lower())), F.instr(low, F.lit(STACK_LABEL.lower()))
    own = own.select(by, "block", pos, F.col(line).alias("_line"), "_name", F.when(e > 0, e).alias("_e"), F.when(s > 0, s).alias("_s"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("pos"), F.col(c).alias("at"))))
    heads = own.groupBy(by, "block").agg(F.min_by("_name", pos).alias("name"), F.min(pos).alias("head"), first("_e").alias("error_at"), first("_s").alias("stack_at"))
    at = own.drop("_name", "_e", "_s").join(heads.drop("name"), [by, "block"])
    # What of each line belongs to either part.
    p, a, b = F.col(pos), F.col("error_at"), F.col("stack_at")
    ahead = F.when(p == b["pos"], F.left("_line", b["at"] - 1)).when(b.isNull() | (p < b["pos"]), F.col("_line"))
    labelled = F.when(p > a["pos"], ahead).when((p == a["pos"]) & (b.isNull() | (b["pos"] > p) | (b["at"] > a["at"])), F.substr(F.coalesce(ahead, F.lit("")), a["at"] + len(ERROR_LABEL)))
    error = F.when(a.isNotNull() & (b.isNull() | (a < b)), labelled).when(a.isNull() & (p > F.col("head")), F.when(b.isNotNull(), ahead))
    stack = F.when(p > b["pos"], F.col("_line")).when(p == b["pos"], F.substr("_line", b["at"] + len(STACK_LABEL)))
    part = F.explode(F.array(F.struct(F.lit("error").alias("part"), X.trimmed(error).alias("text")), F.struct(F.lit("stack").alias("part"), F.regexp_replace(stack, r"\s+$", "").alias("text"))))
    rank = F.row_number().over(Window.partitionBy(by, "block", "part").orderBy(pos))
    rows = at.select(by, "block", pos, part.alias("x")).select(by, "block", pos, "x.*").where("text != ''").withColumn("n", rank)
    # Each kept line of an error is a character at least, so no more lines than characters can be shown; tasks keep only so many before they meet.
    rows = rows.where(F.col("n") <= X.DETAIL_CHARS)
    rows = rows.where(F.when(F.col("part") == "stack", F.col("n") <= X.STACK_LINES).otherwise(F.col("n") <= X.DETAIL_CHARS))
    joined = lambda name, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("n", "text")))), lambda x: x["text"]), mark)
    texts = rows.groupBy(by, "block").agg(joined("error", " ").alias("error"), F.regexp_replace(joined("stack", "\n"), r"^\s+", "").alias("stack"))
    out = heads.select(by, "block", "name").join(texts, [by, "block"], "left")
    cut = lambda c, n: X.ellipsis(F.coalesce(c, F.lit("")), n, "...", n - 3)
    return out.select(by, "block", "name", cut(F.col("error"), X.DETAIL_CHARS).alias("error"), cut(F.col("stack"), X.STACK_CHARS).alias("stack"))


def between(text: Column, first: str = ERROR_LABEL, second: str = STACK_LABEL) -> tuple[Column, Column]:
    """What stands after the first label up to the second, and what stands after the second; empty where a label is missing or out of order."""
    low = F.lower(text)
    a, b = F.instr(low, F.lit(first.lower())), F.instr(low, F.lit(second.lower()))
    end = F.when(b > 0, b).otherwise(F.char_length(text) + 1)
    error = F.when((a > 0) & (end >= a + len(first)), F.substring(text, a + len(first), end - a - len(first))).otherwise("")
    stack = F.when(b > 0, F.substring(text, b + len(second), F.char_length(text))).otherwise("")
    return X.one_line(error), stack


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
