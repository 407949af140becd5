"""References found in sources: an index of names, joined to declarations by scope.

The index has a row for each name of each source, written by the lexer, over which sources are dealt out. A use is looked for
in the scopes that it can see, by equality of scope and name, so no use meets all declarations of its name. What a value's
type is comes from its declaration in the same member or type; there is no other binding, and inherited members aren't found.

Tables that grow with the sources meet by sorted joins, which is hinted: an index of repeated names is a small fraction of its size as Parquet and the
texts of sources may be put together from little, so that Spark takes them for small and would broadcast them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import csharp
from ..functions import text as X
from ..sources import sinks
from . import code, edits, search, symbols

INDEX = """path string, name string, start long, end long, line long, role string, before string, n_args long, owner long, scopes array<string>,
  ord long, kind string, scope string, n_params long, context string, header string, decl_start long, decl_end long"""
_TEXTS = {"path", "name", "role", "before", "kind", "scope", "context", "header"}
_SCHEMA = pa.schema([(x.split()[0], pa.list_(pa.string()) if "<" in x else pa.string() if x.split()[0] in _TEXTS else pa.int64()) for x in INDEX.split(", ") for x in x.split(",\n")])
_NOT_DECLARED = (None,) * 8
#: Kinds that are types, and those that a reference can be asked for by file.
TYPES, ASKED = list(csharp.TYPES), ["class", "interface", "method"]


def index(files: DataFrame, path: str = "path", text: str = "text", names: list[str] | None = None) -> DataFrame:
    """The names of each source in order of place: declarations, uses, and uses of parameters and variables. Null texts have none; null paths give null paths.

    With `names`, of the sources that hold one of these only: their declarations, and the uses of these names.
    """
    wanted = None if names is None else frozenset(names)

    def rows(where: str | None, source: str | None) -> list[tuple]:
        out = []
        for o in csharp.occurrences(source):
            own = o.declared
            if wanted is not None and not own and o.name not in wanted:
                continue
            d = own.at if own else None
            about = (d.ord, d.kind, own.scope, d.n_params, own.context, d.header, d.start, d.end) if own else _NOT_DECLARED
            out.append((where, o.name, o.start, o.end, o.line, o.role, o.before, o.n_args, o.owner, o.scopes, *about))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return code.batched((rows(where, source) for where, source in code.pairs(batches)), _SCHEMA)

    some = files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    if wanted is not None:
        some = some.where(reduce(lambda a, b: a | b, (F.contains("text", F.lit(n)) for n in sorted(wanted)), F.lit(False)))
    return code.spread(some).mapInArrow(run, INDEX)


def declarations(found: DataFrame) -> DataFrame:
    """Types and members of an index with their full names (`fqn`); namespaces are left out."""
    own = found.where("role = 'declaration' and kind != 'namespace'")
    return own.select("path", "name", "kind", "scope", F.concat_ws(".", F.nullif("scope", F.lit("")), "name").alias("fqn"), "n_params", "ord", "line", "start", "end", "context", "header", "decl_start", "decl_end")


def resolved(found: DataFrame) -> DataFrame:
    """Uses with the symbol that they name: fqn, kind and n_params, and `certain`, false where only the name tells.

    Of the scopes that a use can see the innermost with such a symbol counts; of several methods there the one of as many parameters as the call has
    arguments, else of the fewest. A member of a value of unknown type is resolved if only one symbol has its name. Constructors are no symbols
    of their own: they stand for their type.
    """
    own = declarations(found).where("kind != 'ctor'").select("scope", "name", "kind", "fqn", F.when(F.col("kind") == "method", F.col("n_params")).otherwise(0).alias("n_params")).distinct()
    uses = found.where("role = 'use'").select("path", "name", "start", "end", "line", "owner", "before", "n_args", "scopes")
    told = uses.where("before != '?'").select("*", F.posexplode("scopes").alias("rank", "scope")).drop("scopes")
    told = told.withColumn("scope", F.when(F.col("before") == "", F.col("scope")).otherwise(F.concat_ws(".", F.nullif("scope", F.lit("")), "before"))).drop("before")
    hits = told.join(own.hint("merge"), ["scope", "name"])
    odd = ((F.col("kind") == "method") & ~F.col("n_args").eqNullSafe(F.col("n_params"))).cast("int")
    best = F.min_by(F.struct("name", "end", "line", "owner", "fqn", "kind", "n_params"), F.struct("rank", odd.alias("odd"), "n_params", "kind"))
    sure = hits.groupBy("path", "start").agg(best.alias("s")).select("path", "start", "s.*", F.lit(True).alias("certain"))
    alone = own.where(~F.col("kind").isin(TYPES)).groupBy("name").agg(F.min(F.struct("fqn", "kind", "n_params")).alias("s"), F.count("*").alias("n")).where("n = 1").select("name", "s.*")
    rest = uses.where("before = '?'").join(alone.hint("merge"), "name").select("path", "start", "name", "end", "line", "owner", "fqn", "kind", "n_params", F.lit(False).alias("certain"))
    return sure.unionByName(rest)


def by_place() -> list[Column | str]:
    return [F.upper("path"), "path", "line", "start"]


def with_context(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References with `context`: the method, constructor, property or field around as one line, else the class or interface, else the name itself."""
    around = declarations(found).select("path", F.col("ord").alias("owner"), "context")
    return refs.join(around.hint("merge"), ["path", "owner"], "left").withColumn("context", F.coalesce("context", "name"))


def with_lines(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References with `source`, the line that they stand in. Only lines of files that hold references are split."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a table of files may be read by one task
    own = files.select(F.col("path").cast("string").alias("path"), "text").where("path is not null").repartition(tasks, "path").join(refs.select("path").distinct().hint("merge"), "path", "left_semi")
    lines = search.file_lines(own, "path").withColumnRenamed("line", "_line").select("path", F.col("line_no").alias("line"), "_line")
    return symbols.with_source_lines(refs, lines.hint("merge"), ["path", "line"], "_line")


def usages(found: DataFrame, most: int = symbols.MOST_USAGES) -> DataFrame:
    """The first references of every symbol by path in any case, line and place, with their rank, the number of all and whether some were left out."""
    return symbols.usages(sinks.kept(resolved(found)), ["fqn", "kind", "n_params"], by_place(), most)  # read twice


def primary(found: DataFrame, name: str) -> DataFrame:
    """The symbol that a name in any case means: a row of fqn, kind and n_params, or none."""
    own = declarations(found).where(F.lower("name") == name.strip().lower()).where("kind != 'ctor'")
    own = own.select("fqn", "kind", F.when(F.col("kind") == "method", F.col("n_params")).otherwise(0).alias("n_params")).distinct()
    kind = F.when(F.col("kind").isin(TYPES), "type").otherwise(F.col("kind"))
    return own.orderBy(symbols.symbol_priority(kind).desc(), "n_params", "fqn").limit(1)


def find_usages(found: DataFrame, files: DataFrame, name: str, most: int = symbols.MOST_USAGES) -> DataFrame:
    """The first usages of the symbol that a name means, with source lines; no such symbol gives no rows."""
    named = found.where(F.lower("name") == name.strip().lower())  # what a use names depends on declarations of its name alone
    own = resolved(named).join(F.broadcast(primary(named, name)), ["fqn", "kind", "n_params"], "left_semi")  # one row
    return with_lines(symbols.usages(own, ["fqn", "kind", "n_params"], by_place(), most), files)


def find_references(found: DataFrame, path: str, name: str, most: int = symbols.MOST_REFERENCES) -> DataFrame:
    """The first references, with contexts, of what a file first declares by exactly this name as class, interface or method. An index of this name is enough."""
    asked = declarations(found).where((F.col("path") == path) & (F.col("name") == name) & F.col("kind").isin(ASKED)).orderBy("start").limit(1)
    asked = asked.select("fqn", "kind", F.when(F.col("kind") == "method", F.col("n_params")).otherwise(0).alias("n_params"))
    own = resolved(found.where(F.col("name") == name)).join(F.broadcast(asked), ["fqn", "kind", "n_params"], "left_semi")  # one row
    first = symbols.usages(own, ["fqn", "kind", "n_params"], by_place(), most)
    return with_context(first, found.join(F.broadcast(first.select("path").distinct()), "path", "left_semi"))  # `most` rows


def rename_edits(found: DataFrame, renames: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """The edits (path, start, end, text) that rename symbols: their declarations, those of constructors of a type, and the certain references.

    renames has fqn, kind, new, and n_params of methods (else 0); with a column `project`, only files that `projects` (path, project) puts there are edited.
    """
    own = declarations(found)
    of_type = F.col("kind") == "ctor"
    named = own.select("path", "start", "end", F.when(of_type, F.col("scope")).otherwise(F.col("fqn")).alias("fqn"), F.when(of_type, F.lit("ctor")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "method", F.col("n_params")).otherwise(0).alias("n_params"))
    places = named.unionByName(resolved(found).where("certain").select("path", "start", "end", "fqn", "kind", "n_params"))
    made = renames.where(F.col("kind").isin(TYPES)).withColumn("kind", F.lit("ctor"))
    got = places.join(renames.unionByName(made).hint("merge"), ["fqn", "kind", "n_params"])
    if "project" in renames.columns:
        got = got.join(projects.select("path", "project").hint("merge"), ["path", "project"], "left_semi")
    return got.select("path", "start", "end", F.col("new").alias("text")).distinct()


def renamed(files: DataFrame, found: DataFrame, renames: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """The files that the renames change, with their new texts. Files whose places overlap are told by `refused` and stay as they were."""
    after = edits.spliced(files, rename_edits(found, renames, projects))
    return symbols.differences(files.hint("merge"), after.where("n_edits > 0"), "path")
