"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import article, bpe, codes, media, mixing, pii, repeats, simhash, token_counts, toxicity, urls, vectors, whitening
from .storage import read, stored


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).withColumn("base", F.filter("spans", lambda s: s.base))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text("base"), 256).alias("base_sha256"), pii.span_text("spans").alias("spans"))


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.train(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return toxicity.score(docs, network).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep_bytes=False).drop("removed")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce("text", F.lit("")).cast("binary")
    padded = F.greatest(F.lit(1), F.expr("cast((n_bytes + 63) div 64 as int)")) * 64
    docs = (
        read(spark, sf_dir, "documents")
        .select("doc_id", data.alias("data"))
        .withColumn("n_bytes", F.octet_length("data").cast("long"))
        .select("doc_id", "n_bytes", F.rpad("data", padded, F.lit(b"\0")).alias("payload"))
    )
    loaded = media.load(media.store(docs).drop("payload"))
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.octet_length("stored").cast("long").alias("payload_bytes"),
        F.sha2("stored", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(stored, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.aggregate("tensors", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t.rgb)).alias("tensor_bytes"),
        F.array_join(F.transform("tensors", lambda t: F.sha2(t.rgb, 256)), ",").alias("tensor_sha256"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    end_of_document = 50_256
    flat = stored(token_counts.flatten(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_of_document))
    counts = token_counts.count_tokens(flat.where("data is not null"), end_of_document)
    return flat.where("ordinal is not null").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "component")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = codes.compress(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return codes.label_errors(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
