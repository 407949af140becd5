"""What the training-data operators share: tables, checkpoints, hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: ten thousand very long texts don't fit a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Lists of the tables written since their scope began, innermost last.
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, which spark.checkpoint.dir names. Only in one process alone, as in tests, a local one stands in where it is unset; elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="textfacts-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def stored(df: DataFrame, wide: bool = False) -> DataFrame:
    """Compute df once and cut its lineage: a compressed Parquet table in the shared folder, read again.

    wide tells that single rows are megabytes, so that the writer looks at their size after each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write
    if wide:
        writer = writer.options(**{"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"})
    writer.parquet(path)
    for scope in _SCOPES:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """As stored(), for narrow rows between steps."""
    return stored(df)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of the tables that stored() and cut() write within, in order, so that the caller can discard() them."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield own
    finally:
        _SCOPES.remove(own)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing will read again."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as remainder of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def lower_az(text: str) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and nothing else changed. Lone surrogates become '?'."""
    return text.encode("utf-8", "replace").lower()


def words_of(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a lower-cased text; bytes.split() splits at exactly these."""
    return lower_az(text).split() if text else []


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from a partition sorted by them, each as one table.

    Only runs of two rows or more are given out. A run is held until its end is seen,
    so callers choose keys whose runs have a bound.
    """
    held: pa.Table | None = None

    def ends(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        at = ends(t)
        for i in np.flatnonzero(np.diff(at[:-1]) > 1):
            yield t.slice(at[i], at[i + 1] - at[i])
        held = t.slice(at[-2])
    if held is not None and held.num_rows > 1:
        yield held


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class Joined:
    """Union-find over hashable nodes."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def join(self, a, b) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes, each a groupBy-min and a join over the edges
    alone, written in between. No component is gathered in one task or the driver;
    only a count and a sum come to the driver, to see whether a round changed anything.
    No edges give no rows.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
