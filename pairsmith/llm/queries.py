"""The operators bound to the driver's tables, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .token_counts import count_tokens
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_classes
    return simhash_classes(read_table(spark, sf_dir, "documents"), keep=["doc_id"], size=4, max_bits=4)


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from .decontam import contamination
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                          keep=["doc_id"])
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from .sharding import shuffle_into_shards
    body = F.coalesce(F.col("text"), F.lit(""))
    slim = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64("text", "source", "lang").alias("content"))
    return shuffle_into_shards(slim, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sizes
    return mixed_sizes(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged
    out, _ = judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"]) \
        .select("doc_id", "held_out", "score", "predicted", "evidence")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from .common import span_text
    from .pii_crf import KINDS, find_personal_data, train
    docs = read_table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train(docs), keep=["doc_id"])
    plain = F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    counts = [F.size(F.filter("spans", _is_base(k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(plain).alias("spans"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import digest, scan_licences
    return digest(scan_licences(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_links import digest, scan
    return digest(scan(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])


def _is_base(kind: int):
    return lambda s: s["base"] & (s["rank"] == kind)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from .alignment import COLUMNS, align
    found = align(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                  public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], digest=True)
    return found.select("doc_id", *COLUMNS, found["groups"].alias("groups_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from .hard_negatives import hard_negatives
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), anchor=F.col("vec_id") % 100 == 0)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F
    from .pieces import decode_pieces, encode_pieces
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode_pieces(encode_pieces(read_table(spark, sf_dir, "documents"), model, keep=["doc_id"]), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
