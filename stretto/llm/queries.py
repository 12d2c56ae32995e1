"""The queries of this subpackage: each applies its operator to a whole table and derives the columns asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, mixing, pii, ppm, repair, simhash, suffixes, topk, toxicity, vectors


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ppm.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{common.shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    repair.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, target)
    shards = spark.read.schema(repair.SHARDS).parquet(target)
    return repair.positions(shards, repair.read_shards(shards, with_ids=False)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pii.find(docs, pii.train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    secrets = [F.size("secrets").cast("long").alias("n_secret"), joined("secrets").alias("secrets"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found")]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *secrets)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package, not in it: the operators do without

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm": op1_ppm,
        "op2_mix": op2_mix,
        "op3_topk": op3_topk,
        "op4_suffixes": op4_suffixes,
        "op5_toxicity": op5_toxicity,
        "op6_pii": op6_pii,
        "op7_simhash": op7_simhash,
        "op8_repair": op8_repair,
        "op9_bpe": op9_bpe,
        "op10_vectors": op10_vectors,
        "pipeline": pipeline,
    }


#: Vectors that are there and hold finite numbers only, quantised or at length 1.
_TOPK = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding::double[], lambda x: floor(1024 * x)::bigint) as w from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as q, q.vec_id as query_id, v.vec_id, list_sum(list_transform(generate_series(1, len(v.w)), lambda i: q.w[i] * v.w[i]))::bigint as score from v q join v on v.r <> q.r where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by q order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10"""

_COPIES = """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e,
    label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good from embeddings),
pairs as (select a.r as a, b.r as b from v a join v b on a.label = b.label and a.r <> b.r and a.good and b.good where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select r, vec_id as root from v union select p.b, reach.root from reach join pairs p on p.a = reach.r),
least as (select r, min(root) as component_id from reach group by r),
n as (select a as r, count(*) as n from pairs group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept from v join least using (r) left join n using (r)"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are held against brute force in tests/llm."""
    return {"op3_topk": _TOPK, "op10_vectors": _COPIES}
