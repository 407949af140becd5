"""Projects, their references and assemblies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def _by_name(names: Column) -> Column:
    """Names in case-insensitive order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.upper(names).alias("u"), names.alias("n")))), lambda x: x["n"]), ", ")


def adjacency(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """name and deps of each project: names it refers to, an unknown one by its id, (none) without any."""
    to = projects.select(F.col("project_id").alias("dst_id"), F.col("name").alias("to"))
    named = edges.join(to, "dst_id", "left").select(F.col("src_id").alias("project_id"), F.coalesce("to", F.col("dst_id").cast("string")).alias("to"))
    deps = named.groupBy("project_id").agg(_by_name(F.col("to")).alias("deps"))
    return projects.join(deps, "project_id", "left").select("project_id", "name", F.coalesce("deps", F.lit("(none)")).alias("deps"))


def listing(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """As adjacency, but references to unknown projects are dropped and none is empty."""
    to = projects.select(F.col("project_id").alias("dst_id"), F.col("name").alias("to"))
    deps = edges.join(to, "dst_id").groupBy(F.col("src_id").alias("project_id")).agg(_by_name(F.col("to")).alias("deps"))
    return projects.join(deps, "project_id", "left").withColumn("deps", F.coalesce("deps", F.lit("")))


def described(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """name, path, tfm, output_type and references of each project: the names of known projects in order of `ord`, (none) without any; a mark for what isn't known."""
    to = projects.select(F.col("project_id").alias("dst_id"), F.col("name").alias("to")).where("trim(name) != ''")
    refs = edges.join(to, "dst_id").groupBy(F.col("src_id").alias("project_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "to"))), lambda x: x["to"]), ", ").alias("references"))
    or_mark = lambda c, mark: F.coalesce(c, F.lit(mark)).alias(c)
    return projects.join(refs, "project_id", "left").select("name", or_mark("path", "(unknown path)"), or_mark("tfm", "(unknown)"), or_mark("output_type", "(unknown)"), or_mark("references", "(none)"))


def classified(value: Column, rules: list[tuple[str, list[str]]], other: str) -> Column:
    """The first kind one of whose markers stands in the value, in any case."""
    low, out = F.lower(value), F.lit(other)
    for kind, markers in reversed(rules):
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(low, F.lit(m.lower()))
        out = F.when(hit, kind).otherwise(out)
    return out


def first_of_any_case(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of the rows whose names are equal in any case, the first by order; null names are left out."""
    others = [c for c in rows.columns if c != name]
    first = rows.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("_low")).agg(F.min_by(F.struct(name, *others), F.struct(order, name)).alias("_r"))
    return first.select(*(F.col(f"_r.{c}").alias(c) for c in rows.columns))


#: Characters of the pieces of names in the index.
GRAM = 3


def grams(text: Column, n: Column) -> Column:
    """The different pieces of n characters of a text."""
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def resolved(wanted: DataFrame, assemblies: DataFrame, key: str, path: str, order: str) -> DataFrame:
    """For each wanted name the first assembly whose file's stem it is, else the first whose file name holds it, in any case; rank is 0 or 1.

    Of paths that are equal in any case the first counts. Stems meet by equality. For the rest, file names are in an index of their pieces of GRAM characters; a wanted name meets
    the names of its own rarest piece, which are then looked through. Shorter names meet by all pieces of their length. Equal wanted names are one; null and empty names find nothing.
    """
    asked = wanted.select(F.col(key).alias("_key"), F.lower(key).alias("_want")).where("_want != ''").distinct()
    own = first_of_any_case(assemblies.select(F.col(path).alias(path), F.col(order).alias(order)).distinct(), path, order)
    own = own.select(path, order, F.lower(X.file_stem(F.col(path))).alias("_stem"), F.lower(X.file_name(F.col(path))).alias("_file"))
    best = F.min_by(F.struct(path, order), F.struct(order, path)).alias("_a")
    exact = asked.join(own, asked["_want"] == own["_stem"]).groupBy("_key").agg(best).withColumn("rank", F.lit(0))

    rest = asked.join(exact, "_key", "left_anti")
    size = F.least(F.char_length("_want"), F.lit(GRAM))
    sizes = rest.select(size.alias("_n")).distinct()
    index = own.join(F.broadcast(sizes)).select(path, order, "_file", F.explode(grams(F.col("_file"), F.col("_n"))).alias("_gram"))  # at most GRAM rows
    pieces = rest.select("_key", "_want", F.explode(grams(F.col("_want"), size)).alias("_gram"))
    counts = index.join(pieces.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = pieces.join(counts, "_gram").groupBy("_key", "_want").agg(F.min_by("_gram", F.struct("_df", "_gram")).alias("_gram"))
    held = rarest.join(index, "_gram").where(F.contains("_file", F.col("_want"))).groupBy("_key").agg(best).withColumn("rank", F.lit(1))
    return exact.unionByName(held).select(F.col("_key").alias(key), f"_a.{path}", f"_a.{order}", "rank")


def sections(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Parts of the same columns one after the other, with the rank of their section."""
    out = None
    for i, (name, df) in enumerate(parts):
        df = df.withColumn("section", F.lit(name)).withColumn("section_rank", F.lit(i).cast("long"))
        out = df if out is None else out.unionByName(df)
    return out


def visible_types(types: DataFrame) -> DataFrame:
    """The public and protected classes and interfaces whose names no compiler made, with `ns`, their namespace or the mark of the global one."""
    own = types.where(F.col("kind").isin("class", "interface") & X.public_or_protected(F.col("access")) & ~X.generated_name(F.col("name")))
    return own.withColumn("ns", F.when(F.trim(F.coalesce("namespace", F.lit(""))) == "", X.GLOBAL_NAMESPACE).otherwise(F.col("namespace")))


def by_namespace(types: DataFrame) -> DataFrame:
    """ns, n and types, "kind name" in order of the names, of the visible types."""
    named = F.array_sort(F.collect_list(F.struct("name", F.concat_ws(" ", "kind", "name").alias("shown"))))
    return visible_types(types).groupBy("ns").agg(F.count("*").alias("n"), F.array_join(F.transform(named, lambda x: x["shown"]), ", ").alias("types"))


def visible_members(members: DataFrame) -> DataFrame:
    """Public and protected members whose names no compiler made, neither accessors nor operators, with `shown`, their modifiers and signature, and `section`: fields, properties, then methods.

    `place` is the order within a type: by section, name, and of methods the number of parameters.
    """
    own = members.where(X.public_or_protected(F.col("access")) & ~X.generated_name(F.col("name")) & ~F.coalesce("is_accessor", F.lit(False)) & ~F.coalesce("is_operator", F.lit(False)))
    own = own.withColumn("section", F.when(F.col("kind") == "field", 0).when(F.col("kind") == "property", 1).otherwise(2).cast("long"))
    place = F.row_number().over(Window.partitionBy("type_id").orderBy("section", "name", F.when(F.col("section") == 2, F.col("n_params")).otherwise(0), "signature"))
    return own.withColumn("shown", F.concat(X.modifiers(F.col("access"), F.col("is_static")), F.col("signature"))).withColumn("place", place.cast("long"))


def overload_bodies(methods: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The bodies of the methods of each name (the last of `by`) that aren't accessors, in order, joined, and how many; blank ones are dropped, and so are names without any.

    A name's overloads come into one row, as they are shown at once.
    """
    own = methods.where(~F.coalesce("is_accessor", F.lit(False)) & (X.trimmed(F.col("body")) != ""))
    rows = F.array_sort(F.collect_list(F.struct(*order, F.regexp_replace("body", r"\s+$", "").alias("_body"))))
    return own.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["_body"]), "\n\n---\n\n").alias("bodies"), F.count("*").alias("n"))


def preferred(instances: DataFrame, version: str, order: str, least_major: int = 17) -> DataFrame:
    """The first instance by order whose version's first number is large enough, else the first of all; no instances give none."""
    enough = F.regexp_extract(version, "^([0-9]+)", 1).try_cast("int") >= least_major
    return instances.orderBy((~F.coalesce(enough, F.lit(False))).cast("int"), order).limit(1)
