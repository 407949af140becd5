"""Facts about C# sources. Lexing runs in Arrow batches, a file at a time; what follows is plain DataFrame code.

Lexing takes far longer than reading, and a table of sources may lie in one small file, which is one task. So sources are dealt out by
hash before they are lexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import csharp
from . import tree

#: Fixed values.
MOST_SKELETON_FILES, MOST_NOTES = 20, 8
MEMBER = "path string, ord long, parent long, depth long, kind string, name string, n_params long, start long, body long, end long, header string"
_NAMES = [x.split()[0] for x in MEMBER.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if n in ("path", "kind", "name", "header") else pa.int64()) for n in _NAMES])
BATCH_ROWS = 8192


def spread(files: DataFrame) -> DataFrame:
    """Files dealt over as many tasks as the session's shuffles have, by the hash of the columns. Streams stay as they are."""
    keys = [c for c, t in files.dtypes if "map<" not in t and "variant" not in t]  # what can be hashed
    return files if files.isStreaming else files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def batched(rows: Iterator[list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of at least BATCH_ROWS, as far as there are so many; a file's rows stay together."""
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    own = {id(v): v for v in values}  # many rows share a list
    at = {k: n for n, k in enumerate(own)}
    return pa.array(list(own.values()), kind).take(pa.array([at[id(v)] for v in values], pa.int32()))


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The first two columns of each row."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def members(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row for each declaration of each file. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(([(p, *d) for d in csharp.declarations(t)] for p, t in pairs(batches)), _SCHEMA)

    return spread(files.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))).mapInArrow(run, MEMBER)


def method_body(files: DataFrame, type_name: str, method: str, path: str = "path", text: str = "text") -> DataFrame:
    """path and source of a method: of the first class of that name in each file, the first direct member of that name. Files without a path are left out."""
    schema = pa.schema([("path", pa.string()), ("source", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((_bodies(p, t, type_name, method) for p, t in pairs(batches)), schema)

    some = files.where(F.col(path).isNotNull() & F.contains(F.col(text), F.lit(type_name)) & F.contains(F.col(text), F.lit(method)))
    return spread(some.select(F.col(path).cast("string").alias("path"), F.col(text).alias("text"))).mapInArrow(run, "path string, source string")


def _bodies(path: str, text: str, type_name: str, method: str) -> list[tuple[str, str]]:
    found = csharp.declarations(text)
    own = next((d.ord for d in found if d.kind == "class" and d.name == type_name), None)
    return [(path, text[d.start : d.end]) for d in found if d.kind == "method" and d.name == method and d.parent == own][:1]


@F.pandas_udf(T.StringType())
def without_bodies(texts: pd.Series) -> pd.Series:
    return texts.map(csharp.without_bodies, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def notes(texts: pd.Series) -> pd.Series:
    """What the lexer finds wrong with each source, the first few."""
    return texts.map(lambda t: csharp.problems(t, MOST_NOTES), na_action="ignore")


@F.pandas_udf(T.StringType())
def outline(texts: pd.Series) -> pd.Series:
    return texts.map(csharp.outline, na_action="ignore")


def skeletons(files: DataFrame, path: str = "path", text: str = "text", most: int = MOST_SKELETON_FILES) -> DataFrame:
    """path and skeleton of the first sources of a folder by path in any case, without those in excluded folders."""
    own = files.where(F.lower(F.col(path)).endswith(".cs") & ~tree.excluded(F.col(path)))
    return own.orderBy(F.upper(path), path).limit(most).select(path, without_bodies(F.col(text)).alias("skeleton"))


def outlines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path and outline of each source: headers of usings, namespaces, types and members."""
    return spread(files.where(F.lower(F.col(path)).endswith(".cs")).select(path, text)).select(path, outline(F.col(text)).alias("outline"))


def with_notes(files: DataFrame, text: str = "text") -> DataFrame:
    """Sources with `notes`, an array that is empty where nothing is wrong."""
    return spread(files).withColumn("notes", notes(F.col(text)))
