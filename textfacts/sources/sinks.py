"""File tables and logs as sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import text as X
from . import settings

KEPT_DAYS, BUCKETS = 14, 64


def upserted(files: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """(path, text) after updates: a path's new text replaces the old, new paths are added, a null text deletes.

    Of several updates of one path that of the greatest `order` counts, of equal orders or without one the greatest text, as rows have no order.
    """
    rank = F.struct(*([order] if order else []), F.col("text").isNotNull(), "text")
    one = updates.groupBy("path").agg(F.max_by(F.struct("text"), rank).alias("_u")).select("path", "_u.text")
    return files.join(one.select("path"), "path", "left_anti").select("path", "text").unionByName(one.where("text is not null"))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: a Parquet table in the folder that spark.checkpoint.dir names, which holds more than a cache and is read by columns; the session's cache where none is set."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist()
    path = f"{folder}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def overwrite(spark: SparkSession, after: DataFrame, path: str) -> None:
    """Replace a table of files, which `after` may itself be read from: it is written beside, then the folders are swapped."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    after.write.parquet(new)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, source, old = jvm.Path(path), jvm.Path(new), jvm.Path(f"{new}-old")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        raise OSError(f"cannot replace {path}")
    if not fs.rename(source, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"cannot replace {path}")
    if held:
        fs.delete(old, True)


def append_log(events: DataFrame, path: str) -> None:
    """Add rows with a column `ts` to a log with a folder for each day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, days: int = KEPT_DAYS) -> DataFrame:
    """The rows of a log's last days, counted from its newest; older folders aren't read."""
    log = spark.read.parquet(path)
    newest = log.agg(F.max("day")).first()[0]
    return log.where(F.col("day") > F.date_sub(F.lit(newest), days)) if newest else log


def prune_log(spark: SparkSession, path: str, days: int = KEPT_DAYS) -> list[str]:
    """Delete all but the newest folders of a log; the names of those deleted. A log has few of them, one a day."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("day="))
    for name in found[:-days]:
        fs.delete(jvm.Path(root, name), True)
    return found[:-days]


def log_outputs(outputs: DataFrame, path: str) -> None:
    """Log results (ts, tool, result) by their length, estimated tokens and a preview; a null result is empty."""
    text = F.coalesce("result", F.lit(""))
    append_log(outputs.select("ts", "tool", F.char_length(text).cast("long").alias("length"), X.tokens_estimate(text).alias("tokens"), X.telemetry_preview(text).alias("preview")), path)


def log_requests(requests: DataFrame, path: str) -> bool:
    """Log requests and notifications (ts, id, method, params) with their parameters as compact JSON, if the session's settings say so; whether they do."""
    own = settings.settings(requests.sparkSession)
    if own.log_requests:
        kind = F.when(F.col("method").isNull(), "message").when(F.col("id").isNull(), "notification").otherwise("request")
        append_log(requests.select("ts", kind.alias("kind"), "id", "method", X.rpc_params(F.col("params"), own.request_chars).alias("params")), path)
    return own.log_requests


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write_files(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write (path, text) as a table of files in so many buckets, a folder each."""
    files.select("path", "text", bucket_of(F.col("path"), buckets).alias("bucket"), F.lit(buckets).alias("buckets")).repartition("bucket").write.partitionBy("buckets", "bucket").parquet(path)


def _buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets a table of files has, by the name of its folder; None if it has none."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    return next((int(n.removeprefix("buckets=")) for n in names if n.startswith("buckets=")), None)


def write_through(spark: SparkSession, updates: DataFrame, path: str, view: str, order: str | None = None) -> DataFrame:
    """Apply updates to a table of files and have its view read the new files; the table, (path, text).

    In a table of write_files() only the buckets of the updated paths are read and replaced; others keep their files. A bucket that is left without files
    is deleted. Tables without buckets are rewritten. Applying the same updates again changes nothing.
    """
    n = _buckets(spark, path)
    if n is None:
        overwrite(spark, upserted(spark.read.parquet(path), updates, order), path)
    else:
        touched = [r["b"] for r in updates.select(bucket_of(F.col("path"), n).alias("b")).distinct().collect()]
        if touched:
            held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select("path", "text")
            after = upserted(held, updates, order).withColumns({"bucket": bucket_of(F.col("path"), n), "buckets": F.lit(n)})
            after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("buckets", "bucket").parquet(path)
            # The write replaces buckets that have rows; of the others, those whose rows are all deleted go.
            again = upserted(spark.read.parquet(path).where(F.col("bucket").isin(touched)), updates, order)
            left = {r["b"] for r in again.select(bucket_of(F.col("path"), n).alias("b")).distinct().collect()}
            jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
            for b in set(touched) - left:
                folder = jvm.Path(f"{path}/buckets={n}/bucket={b}")
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    after = spark.read.parquet(path).select("path", "text")
    after.createOrReplaceTempView(view)
    return after


def stream_updates(updates: DataFrame, path: str, view: str, checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """A stream of updates (path, text) that writes each batch through; start() it. A batch that is run again after a failure changes nothing more."""

    def through(batch: DataFrame, _: int) -> None:
        batch.persist()
        write_through(batch.sparkSession, batch, path, view, order)
        batch.unpersist()

    return updates.writeStream.foreachBatch(through).option("checkpointLocation", checkpoint)
