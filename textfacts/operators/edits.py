"""Edits by place: many spans of a text replaced in one pass."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OVERLAP, OUTSIDE = "overlapping edits", "an edit outside of the text"


def splice(text: str, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with sorted spans (start, end, new text) replaced, in time linear in it; None where one begins before another ends or lies outside."""
    out, at = [], 0
    for n, (start, end, new) in enumerate(spans):
        if start < at or end < start or end > len(text) or (n and start == spans[n - 1][0]):
            return None
        out += [text[at:start], new]
        at = end
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def _spliced(texts: pd.Series, edits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or e is None else splice(t, [(x["start"], x["end"], x["text"] or "") for x in e]) for t, e in zip(texts, edits, strict=True)], dtype="object")


def spliced(files: DataFrame, edits: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files with their edits (path, start, end, text) applied, and n_edits and `refused`: null, or why a file stays as it was.

    Places are in characters, the end exclusive; an empty span inserts. Equal edits count once, null new texts are empty. A file's edits are refused
    together where two overlap or begin at one place, or one lies outside of the text. Files without edits stay; edits of no file, with null
    places or of null texts have no effect. A file's edits meet in one row, as its text is one; more than it has places are refused.
    """
    own = edits.where("start is not null and end is not null").select(F.col(path).alias("_path"), F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text")).alias("_e")).distinct()
    by = own.groupBy("_path").agg(F.array_sort(F.collect_list("_e")).alias("_edits"))
    got = files.join(by.hint("merge"), files[path] == by["_path"], "left").drop("_path")
    new = _spliced(F.col(text), F.col("_edits"))
    outside = F.exists("_edits", lambda e: (e["start"] < 0) | (e["end"] < e["start"]) | (e["end"] > F.char_length(text)))
    done = got.withColumn("_new", new)
    why = F.when(F.col("_edits").isNull() | F.col(text).isNull() | F.col("_new").isNotNull(), None).when(outside, OUTSIDE).otherwise(OVERLAP)
    done = done.withColumn("refused", why).withColumn("n_edits", F.when(F.col("_new").isNull(), 0).otherwise(F.size("_edits")).cast("long"))
    return done.withColumn(text, F.coalesce("_new", text)).drop("_edits", "_new")
