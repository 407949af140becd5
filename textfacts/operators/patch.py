"""Text patches and the scratchpad."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def flexible_pattern(old: str) -> str:
    """The words of a text, escaped, with any white space between."""
    return r"\s+".join(re.escape(w).replace("/", r"\/") for w in old.split())


def patched(text: Column, old: str, new: str, every: bool = False) -> tuple[Column, Column]:
    """The patched text and how it matched: exact, flexible (white space differs) or none. An exact match anywhere comes first; replacing all is one pass; line ends are restored."""
    if not old.strip():
        raise ValueError("the text to replace is blank")
    own, old, new = X.normal_eol(text), old.replace("\r\n", "\n"), new.replace("\r\n", "\n")
    exact = F.instr(own, F.lit(old))
    flexible = flexible_pattern(old)
    literal = new.replace("\\", "\\\\").replace("$", "\\$")
    where = F.regexp_instr(own, F.lit(flexible))
    kind = F.when(exact > 0, "exact").when(F.rlike(own, F.lit(flexible)), "flexible").otherwise("none")
    if every:
        # At each place the exact text comes first; what has been put in isn't looked at again.
        exactly = re.escape(old).replace("/", r"\/")
        out = F.regexp_replace(own, f"{exactly}|{flexible}", literal)
    else:
        first = F.concat(F.left(own, exact - 1), F.lit(new), F.substring(own, exact + len(old), F.char_length(own)))
        hit = F.regexp_substr(own, F.lit(flexible))
        other = F.concat(F.left(own, where - 1), F.lit(new), F.substring(own, where + F.char_length(hit), F.char_length(own)))
        out = F.when(exact > 0, first).when(kind == "flexible", other).otherwise(own)
    return F.when(kind == "none", text).otherwise(X.restored_eol(out, text)), kind


def folded(events: DataFrame, by: str, pos: str) -> DataFrame:
    """The text of each pad after its events: write replaces, append adds a line, clear empties; what precedes the last write or clear doesn't count. Null contents are empty."""
    since = F.max(F.when(F.col("action").isin("write", "clear"), F.col(pos))).over(Window.partitionBy(by))
    live = events.withColumn("_since", since).where(F.col("_since").isNull() | (F.col(pos) >= F.col("_since")))
    parts = F.array_sort(F.collect_list(F.when(F.col("action") != "clear", F.struct(pos, F.coalesce("content", F.lit("")).alias("content")))))
    return live.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("content"), F.count_if(F.col("action") != "clear").alias("n_parts"))
