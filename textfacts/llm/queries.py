"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, clustering, decontaminate, licences, lm, packing, quality, ranking, secrets, sharding, simhash, suffixes, toxicity
from .common import remainder, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(clustering.clusters(table(spark, sf_dir, "embeddings")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_OPERATORS = [op1_simhash_near_dedup, op2_suffix_array_dedup, op3_benchmark_decontamination, op4_toxicity, op5_nearest_neighbours, op6_secret_scan, op7_license_scan, op8_sharding, op9_language_model, op10_packing, op11_ranked_search, op12_centroid_clustering, op13_quality]
QUERIES = {f.__name__: f for f in _OPERATORS}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RANKED = f"""with t as (select doc_id, {_TERMS} ts from documents), g as (select count(*) n_docs, sum(len(ts))::bigint n_terms from t where len(ts) > 0),
  q as (select distinct item_id, unnest({_TERMS}) term from benchmark), p as (select doc_id, term, count(*) tf from (select doc_id, unnest(ts) term from t) where term in (select term from q) group by all),
  d as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) w from p, g group by term, n_docs),
  m as (select doc_id, 10 + (90 * len(ts) * n_docs) // n_terms m from t, g),
  s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) score from q join p using (term) join d using (term) join m using (doc_id) group by all),
  r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank from s where score > 0) select item_id, rank, doc_id, score from r where rank <= 10"""


def _lloyd_sql() -> str:
    """The rounds one after the other, in long form: k rows, c centroids, a assignments."""
    parts = ["""k as materialized (select row_number() over (order by vec_id) r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) x from embeddings
      where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)"""]
    parts.append("c0 as materialized (select row_number() over (order by h) - 1 c, x from (select sha256('2:' || vec_id) h, x from k order by h limit 40))")
    for n in range(clustering.ROUNDS + 1):
        parts.append(f"d{n} as (select r, c, cast(list_sum(list_transform(list_zip(k.x, c{n}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) d from k, c{n})")
        parts.append(f"a{n} as materialized (select r, arg_min(c, (d, c)) c, min(d) d from d{n} group by r)")
        if n < clustering.ROUNDS:
            parts.append(f"s{n} as (select c, j, sum(v) s, count(*) n from (select c, unnest(x) v, unnest(range(64)) j from a{n} join k using (r)) group by all)")
            parts.append(f"m{n} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) x from s{n} group by c)")
            parts.append(f"c{n + 1} as materialized (select c, coalesce(m{n}.x, c{n}.x) x from c{n} left join m{n} using (c))")
    n = clustering.ROUNDS
    return "with " + ", ".join(parts) + f""" select vec_id, cast(c as int) "cluster", d distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
      sha256(array_to_string(c{n}.x, ',')) centroid_sha256 from a{n} join k using (r) join c{n} using (c)"""


SQL: dict[str, str] = {"op11_ranked_search": _RANKED, "op12_centroid_clustering": _lloyd_sql()}
