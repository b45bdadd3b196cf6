"""Corpus pipeline: stages over ``documents``, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``:

1. toxicity: documents that are more probably toxic than not go;
2. exact dedup: of equal texts the row with the largest id stays;
3. SimHash near-dedup: of each group the document with the smallest id stays;
4. secret scans: accepted findings in a text become ``[SECRET]``;
5. packing: what is left is tokenised and packed into sequences.

Edge cases: null texts count as empty and, like any equal texts, leave one
row; rows that repeat id and text leave one row; rows without an id are kept
or dropped by their text like others; empty tables pass through; further
columns of ``documents`` are carried along whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsift.llm import exact_dedup as exact
from graphsift.llm import packing, secret_scan, simhash, toxicity
from graphsift.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(docs).where("kept").select("row.*")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_equal), ("simhash", drop_similar),
          ("secret_scan", redact_secrets), ("packing", pack)]

#: The stages hold trained models and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
