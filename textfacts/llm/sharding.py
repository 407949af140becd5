"""K-d tree partitioning of documents into shards of near equal bytes.

A node is split at the weighted median (or, of an odd number of leaves, the quantile next to it) of its widest dimension
until its leaves hold the target bytes. The dimensions are measures of the text: its length, line breaks, characters beyond
ASCII, digits and upper-case letters. Equal texts have equal coordinates and stay together; texts alike in a dimension are
told apart by a hash, and only a group of copies too heavy to stay whole is split, by document id.
A quantile is found by narrowing: each pass sums weights in at most BINS bins of every node, finds the
bin that holds the quantile by a running sum, and brings one row a node to the driver; only that bin is looked into again.
Passes run over narrow rows, for all nodes of a level at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

BINS = 2048
TOLERANCE = 0.001
BUCKET_ROWS = 500_000
LEAST_BUCKETS = 64
#: Measures of a text, for splits.
DIMENSIONS = ["chars", "breaks", "wide", "digits", "capitals"]


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes, none for a null text, plus 1), text_crc32 and the coordinates of each document."""
    text = F.coalesce("text", F.lit(""))
    count = lambda some: (F.char_length(text) - F.char_length(F.translate(text, some, ""))).cast("long")
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.char_length(text).cast("long").alias("chars"),
        count("\n").alias("breaks"),
        (F.octet_length(text) - F.char_length(text)).cast("long").alias("wide"),
        count("0123456789").alias("digits"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("capitals"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("text_hash"),
    )


def kd_partition(points: DataFrame, dimensions: list[str], ties: list[str], weight: str, leaves: int, tolerance: float = TOLERANCE) -> DataFrame:
    """points with a column `leaf` from 0 to leaves - 1, of near equal sums of `weight`.

    dimensions and ties are long columns without nulls. A node that will have m leaves gives the
    lower side m // 2 of them and that share of its weight. Rows alike in all columns stay together.
    `tolerance` is how far, in shares of a leaf, a cut may be from its quantile for the sake of not
    looking further. The driver holds a few numbers for each leaf, and tasks are sent as many. No rows give no rows.
    """
    spark = points.sparkSession
    out = points.withColumn("leaf", F.lit(0))
    nodes = {0: leaves}
    extent = points.agg(*(F.max(d) - F.min(d) for d in dimensions)).first()
    while any(m > 1 for m in nodes.values()):
        rows = out.groupBy("leaf").agg(F.sum(weight).alias("w"), *(f(c).alias(f"{f.__name__}_{c}") for c in dimensions + ties for f in (F.min, F.max))).collect()
        open_nodes = {r["leaf"]: _Cut(r, dimensions, ties, extent, nodes[r["leaf"]], tolerance) for r in rows if nodes[r["leaf"]] > 1}
        while todo := [c for c in open_nodes.values() if not c.done]:
            asked = spark.createDataFrame([(c.node, *c.question()) for c in todo], "leaf int, axes array<int>, settled array<long>, axis int, low long, high long, width long, want double")
            columns = dimensions + ties
            # The coordinates in the node's own order: its widest dimension, then the ties.
            bins = out.join(F.broadcast(asked), "leaf").withColumn("at", F.array(*columns)).where(
                "forall(zip_with(axes, settled, (a, v) -> at[a] = v), same -> same)"
            ).withColumn("x", F.expr("at[axis]")).where("x between low and high").groupBy("leaf", "want", F.expr("(x - low) div width").alias("bin")).agg(F.sum(weight).alias("w"), F.min("x").alias("least"), F.max("x").alias("most"))
            order = Window.partitionBy("leaf").orderBy("bin")
            bins = bins.withColumn("upto", F.sum("w").over(order)).withColumn("below", F.lag("most").over(order))
            over = F.when(F.col("upto") > F.col("want"), F.struct("bin", (F.col("upto") - F.col("w")).alias("before"), "w", "least", "most", "below"))
            found = {r["leaf"]: r for r in bins.groupBy("leaf").agg(F.min(over).alias("bin"), F.max("most").alias("last")).collect()}
            for c in todo:
                c.answer(found.get(c.node))
        nodes, out = _split(spark, out, nodes, open_nodes, dimensions + ties)
    rank = {leaf: n for n, leaf in enumerate(sorted(nodes))}
    names = spark.createDataFrame([(leaf, n) for leaf, n in rank.items()], "leaf int, n int")
    return out.join(F.broadcast(names), "leaf").drop("leaf").withColumnRenamed("n", "leaf")


class _Cut:
    """The search for one node's cut: below it in lexicographic order of the node's columns lies the lower side."""

    def __init__(self, row, dimensions: list[str], ties: list[str], extent, leaves: int, tolerance: float) -> None:
        self.node, self.leaves = row["leaf"], leaves
        spread = [(row[f"max_{d}"] - row[f"min_{d}"]) / max(1, e or 0) for d, e in zip(dimensions, extent, strict=True)]
        widest = max(range(len(dimensions)), key=lambda i: (spread[i], -i))
        columns = dimensions + ties
        self.order = [widest, *range(len(dimensions), len(columns))]
        self.ranges = {i: (row[f"min_{columns[i]}"], row[f"max_{columns[i]}"]) for i in self.order}
        self.want = row["w"] * (leaves // 2) / leaves  # weight still to be taken below the cut
        self.slack = row["w"] / leaves * tolerance
        self.fixed: list[tuple[int, int]] = []  # columns settled, with their value at the cut
        self.place = 0
        self.low, self.high = self.ranges[self.order[0]]
        self.done = False
        self.bound: int | None = None  #: last column: values up to this one are below

    def question(self) -> tuple:
        return [i for i, _ in self.fixed], [v for _, v in self.fixed], self.order[self.place], self.low, self.high, (self.high - self.low) // BINS + 1, float(self.want)

    def answer(self, row) -> None:
        """row has the first bin that reaches beyond the wanted weight, if any does, and the largest value of all bins."""
        if row is None or row["bin"] is None:
            self.bound = self.low if row is None else row["last"]
            self.done = True
            return
        _, before, w, least, most, below = row["bin"]
        if below is not None:
            self.bound = below
        over = before + w - self.want
        self.want -= before
        if min(self.want, over) <= self.slack:  # near enough on one side of this bin
            if over < self.want:
                self.bound = most
            elif self.bound is None or self.bound >= least:
                self.bound = least - 1
            self.done = True
        elif least < most:
            self.low, self.high = least, most
            self.bound = least - 1
        elif self.place + 1 < len(self.order):
            self.fixed.append((self.order[self.place], least))
            self.place += 1
            self.low, self.high = self.ranges[self.order[self.place]]
            self.bound = self.low - 1
        else:  # rows alike in all columns
            self.bound = most if over < self.want else least - 1
            self.done = True


def _split(spark: SparkSession, out: DataFrame, nodes: dict[int, int], cuts: dict[int, _Cut], columns: list[str]) -> tuple[dict[int, int], DataFrame]:
    """Each node's rows go to 2 n (below or at its cut, or whole) or 2 n + 1."""
    after: dict[int, int] = {}
    for n, m in nodes.items():
        after |= {2 * n: m // 2, 2 * n + 1: m - m // 2} if m > 1 else {2 * n: m}
    rows = [(c.node, [i for i, _ in c.fixed] + [c.order[c.place]], [v for _, v in c.fixed] + [c.bound]) for c in cuts.values()]
    table = spark.createDataFrame(rows, "leaf int, axes array<int>, bounds array<long>")
    at = out.join(F.broadcast(table), "leaf", "left").withColumn("at", F.array(*columns))
    # Lexicographic: the first settled column in which the row differs decides, else the last one.
    above = """aggregate(sequence(0, size(axes) - 1), 0, (s, i) -> case
        when s != 0 then s
        when at[axes[i]] > bounds[i] then 1
        when at[axes[i]] < bounds[i] then -1
        else 0 end) > 0"""
    side = F.when(F.col("axes").isNull(), 0).otherwise(F.expr(above).cast("int"))
    return after, cut(at.withColumn("leaf", (F.col("leaf") * 2 + side).cast("int")).drop("axes", "bounds", "at"))


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """df, of about `rows` rows a shard, with `slot`, gapless from 0 in each shard.

    A shard may hold a large part of all rows, so its rows are numbered in hash buckets of about BUCKET_ROWS, and
    the numbers of a bucket start where the one before it ends.
    """
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(shard, "bucket").agg(F.count("*").alias("count"))
    before = Window.partitionBy(shard).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = df.withColumn("n", F.row_number().over(Window.partitionBy(shard, "bucket").orderBy(*order)))
    return numbered.join(starts, [shard, "bucket"]).withColumn("slot", (F.col("start") + F.col("n") - 1).cast("long")).drop("bucket", "n", "start")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document: shards of near equal bytes, so many or of about target_bytes each.

    Equal texts share a shard unless their group is too heavy for the bytes to stay near equal; then
    it is split by doc_id. Null texts have size 1, null ids come first. Repeated rows get a slot each.
    """
    points = cut(metadata(docs).withColumn("id_order", F.coalesce("doc_id", F.lit(-(2**62)))))
    total, rows = points.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    leaves = shards or max(1, -(-total // target_bytes))
    placed = kd_partition(points, DIMENSIONS, ["text_hash", "id_order"], "size", leaves)
    numbered = with_slots(placed.withColumnRenamed("leaf", "shard"), "shard", ["id_order", "text_hash", "size"], -(-rows // leaves))
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")
