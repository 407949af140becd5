"""Symbols, their references and what encloses them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Fixed values.
MOST_REFERENCES, MOST_DEFINITIONS, MOST_USAGES, MOST_CANDIDATES, RENAME_PREVIEW = 20, 200, 30, 10, 100
UNKNOWN_FILE, NO_DOCUMENT, NO_LINE = "(unknown file)", "(document unavailable)", "(source line unavailable)"
#: What encloses a reference, the best first.
ENCLOSING = ["method", "ctor", "property", "field", "class", "interface"]
#: Which of several symbols of a name is meant.
PRIORITY = {"type": 400, "method": 300, "property": 250, "event": 200, "field": 150}
OTHER_PRIORITY = 100
BIN = 4096


def kind_rank(kind: Column) -> Column:
    """Smaller comes first; kinds that enclose nothing are null."""
    out = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(ENCLOSING))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def symbol_priority(kind: Column) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for k, n in PRIORITY.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def definitions(symbols: DataFrame, name: str, order: list[str], most: int = MOST_DEFINITIONS) -> DataFrame:
    """Declarations of a name in any case, each once."""
    return symbols.where(F.lower("name") == name.lower()).dropDuplicates().orderBy(*order).limit(most)


def located(symbols: DataFrame, name: str, order: list[str], locations: str = "locations", most: int = MOST_DEFINITIONS) -> DataFrame:
    """Declarations of a name in any case, a row for each place (path, line); those of no place have nulls and don't count towards the cap."""
    own = symbols.where(F.lower("name") == name.strip().lower()).dropDuplicates()
    places = own.select("*", F.posexplode_outer(locations).alias("_i", "_at")).select("*", F.col("_at.path").alias("path"), F.col("_at.line").alias("line")).drop("_at", locations)
    sort = [*order, "_i"]
    with_place = places.where("_i is not null").orderBy(*sort).limit(most)
    return with_place.unionByName(places.where("_i is null")).orderBy(*sort).drop("_i")


def primary(symbols: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Symbols ranked within their name; rank 1 is the primary, others are candidates."""
    return symbols.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def chosen(symbols: DataFrame, by: list[str], kind: str = "kind", parameters: str = "n_params", fqn: str = "fqn", most: int = MOST_CANDIDATES) -> DataFrame:
    """Of the symbols of each name the primary one (place 0), by kind, then of methods the fewest parameters, then full name; the first others by full name (places from 1); and `more`, how many others are left out."""
    fewest = F.when(F.col(kind) == "method", F.col(parameters)).otherwise(0)
    ranked = primary(symbols, by, [symbol_priority(F.col(kind)).desc(), fewest, F.col(fqn)])
    own = Window.partitionBy(*by)
    ranked = ranked.withColumn("_total", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy((F.col("rank") > 1).cast("int"), F.col(fqn))).cast("long") - 1)
    return ranked.where(F.col("place") <= most).withColumn("more", F.greatest(F.col("_total") - 1 - most, F.lit(0))).drop("_total", "rank")


def usages(refs: DataFrame, symbol: str | list[str], order: list[Column | str], most: int = MOST_USAGES) -> DataFrame:
    """The first references of each symbol (one column or several), with the number of all of them and whether some were left out.

    All are counted by a sum of the tasks' counts, and each task keeps only its first ones of a symbol before they meet, however popular it is.
    """
    by = [symbol] if isinstance(symbol, str) else symbol
    total = refs.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("total"))
    first = refs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return first.join(total.hint("merge"), same).drop(*(f"_{c}" for c in by)).withColumn("cut", F.col("total") > most)


def with_source_lines(refs: DataFrame, lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """References with `source`: the line that they stand in, cut to its limit and without backticks; a mark where there is none or it is blank."""
    shown = lines.select(*keys, X.without_backticks(X.line_cut(F.col(line))).alias("source"))
    got = refs.join(shown, keys, "left")
    return got.withColumn("source", F.when(F.coalesce("source", F.lit("")) == "", NO_LINE).otherwise(F.col("source")))


def with_documents(refs: DataFrame, documents: DataFrame, key: str, path: str = "path") -> DataFrame:
    """References with the path of their document, or a mark if there is no such document; `known` tells which."""
    known = documents.select(key, F.col(path).alias("_path"), F.lit(True).alias("known"))
    got = refs.join(known, key, "left")
    return got.withColumn(path, F.coalesce("_path", F.lit(UNKNOWN_FILE))).withColumn("known", F.coalesce("known", F.lit(False))).drop("_path")


def at_paths(documents: DataFrame, paths: DataFrame, path: str = "path", any_case: bool = False) -> DataFrame:
    """Each wanted path with the document of that path, the first by id column order where several have it; nulls without one."""
    key = (lambda c: F.lower(c)) if any_case else (lambda c: F.col(c))
    others = [c for c in documents.columns if c != path]
    first = documents.withColumn("_k", key(path)).groupBy("_k").agg(F.min(F.struct(F.col(path).alias("found"), *others)).alias("_d"))
    return paths.withColumn("_k", key(path)).join(first, "_k", "left").select(path, *(F.col(f"_d.{c}") for c in ("found", *others)))


def enclosing(points: DataFrame, spans: DataFrame, path: str = "path", size: int = BIN, more: list[str] | None = None) -> DataFrame:
    """Each different point with what encloses it: the best kind, of that the innermost span, with its columns `more`; points in no span have nulls.

    Spans and points meet by path and by bins of positions, so that a point meets only spans of its part of a file.
    """
    own = points.columns
    bins = spans.where("start < end").where(kind_rank(F.col("kind")).isNotNull()).select(F.col(path).alias("_path"), "kind", "start", "end", "header", *(more or []), F.explode(F.expr(f"sequence(cast(floor(start / {size}) as bigint), cast(floor((end - 1) / {size}) as bigint))")).alias("_bin"))
    at = points.distinct().withColumn("_bin", F.floor(F.col("pos") / size).cast("long"))
    inside = (F.col(path) == F.col("_path")) & (at["_bin"] == bins["_bin"]) & (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end"))
    best = F.min(F.when(F.col("kind").isNotNull(), F.struct(kind_rank(F.col("kind")).alias("rank"), (F.col("end") - F.col("start")).alias("length"), "start", "end", "kind", "header", *(more or [])))).alias("_best")
    return at.join(bins, inside, "left").groupBy(*own).agg(best).select(*own, "_best.kind", "_best.start", "_best.end", "_best.header", *(f"_best.{c}" for c in more or []))


def _quoted(name: str) -> str:
    """A pattern of exactly this text."""
    return re.escape(name)


def renamed(files: DataFrame, name: str, new: str, scope: Column | None = None) -> DataFrame:
    """path-keyed files with `after`: whole words of a name replaced, within the scope; filtered before, so nothing is undone later."""
    word = rf"(?<![\p{{L}}\p{{N}}_]){_quoted(name)}(?![\p{{L}}\p{{N}}_])"
    after = F.regexp_replace("text", word, new.replace("\\", "\\\\").replace("$", "\\$"))
    return files.withColumn("after", after if scope is None else F.when(scope, after).otherwise(F.col("text")))


def changed(files: DataFrame) -> DataFrame:
    return files.where(~F.col("text").eqNullSafe(F.col("after")))


def differences(before: DataFrame, after: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """The documents of `after` whose text isn't that of the same id in `before`; those that are new there or have no path are left out."""
    old = before.select(key, F.col(text).alias("_old"))
    return after.join(old, key).where(F.col(path).isNotNull() & ~F.col(text).eqNullSafe(F.col("_old"))).drop("_old")
