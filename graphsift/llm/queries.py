"""Registered queries of the corpus operators: each applies its operator with
production parameters to its whole table and derives the contract's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsift.llm import (embedding_dedup, exact_dedup, html_text, langid, merkle, oracle_sql, packing, secret_scan,
                           sentence_piece, simhash, spelling, token_files, toxicity, warc)
from graphsift.llm.common import table
from graphsift.session import shared_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs.where(~held_out))
    out = langid.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"), keep=["url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentence_piece.encode(table(spark, sf_dir, "documents"), model, keep=["text"])
    back = sentence_piece.decode(ids, model)
    return back.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_pieces"),
                       F.crc32("ids").alias("ids_crc32"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    out = exact_dedup.dedup_table(spark, path, spark.read.parquet(path).schema)
    return out.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([*[F.col(c) for c in fields[:-1]], merkle.lower_a_to_z(F.col("text"))])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle.manifest(table(spark, sf_dir, "documents"), fields, claim=F.when(chosen, tampered))
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("claim", "leaf")))
    return out.select("doc_id", *[merkle.hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
                      merkle.proof_digest().alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == merkle.hex_of(F.col("root"))).alias("verified"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), min_length=7, min_count=2, change=spelling.drop_one(31))
    return spelling.variants(words, min_length=7, times=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_language_id, op3_warc, op4_embedding_dedup, op5_html_text, op6_sentence_piece, op7_packing,
    op8_secret_scan, op9_toxicity, op10_exact_dedup, op11_token_files, op12_merkle, op13_spelling)}

ORACLES = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op12_merkle": oracle_sql.MERKLE,
    "op13_spelling": oracle_sql.SPELLING,
}
