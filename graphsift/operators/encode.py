"""Feature encoding of patterns for LSH (ENC2, ENC3).

A feature vector is a small label code followed by one 0/1 flag per
property. Codes come from ``pyspark.ml.feature.Word2Vec`` fitted on
one-token "sentences" (so, as in the reference, the code is the model's
seeded initial vector of the token) or, with ``code="hash"``, from a seeded
hash of the label text. Encoding runs on distinct patterns, never elements.
"""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: code sizes per token kind (as in the reference) -----------
NODE_LABEL_DIM = 5
EDGE_REL_DIM = 10
EDGE_SRC_DIM = 4
EDGE_DST_DIM = 4
# -------------------------------------------------------------------------------


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as a number any engine can recompute."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _hash_code(token: Column, dim: int, seed: int) -> Column:
    """dim values in [-0.1, 0.1) from a seeded hash of the token."""
    return F.array(*[hash32(F.concat(F.lit(f"{seed}:{i}:"), token)).cast("double") / F.lit(float(1 << 32))
                     * F.lit(0.2) - F.lit(0.1) for i in range(dim)])


def token_code(df: DataFrame, token_col: str, out_col: str, dim: int, code: str = "word2vec",
               seed: int = 42) -> DataFrame:
    """Add ``out_col`` = array<double> code of the text in ``token_col``."""
    tok = F.coalesce(F.col(token_col), F.lit(""))
    if code == "hash":
        return df.withColumn(out_col, _hash_code(tok, dim, seed))
    if code != "word2vec":
        raise ValueError(f"unknown code {code!r}")
    sent = "_w2v_in"
    data = df.withColumn(sent, F.array(tok))
    model = Word2Vec(vectorSize=dim, minCount=0, seed=seed, inputCol=sent,
                     outputCol="_w2v_out").fit(data.select(sent))
    return (model.transform(data)
            .withColumn(out_col, vector_to_array("_w2v_out"))
            .drop(sent, "_w2v_out"))


def property_vocabulary(pats: DataFrame) -> list[str]:
    """Distinct property names of a pattern table (schema-level, bounded by the
    number of property keys, not by the data)."""
    return sorted(r[0] for r in pats.select(F.explode("prop_keys")).distinct().collect())


def _flags(vocab: list[str]) -> Column:
    """One 0/1 flag per name; the plan holds the names as one array literal."""
    if not vocab:
        return F.array().cast("array<double>")
    return F.transform(F.lit(vocab), lambda p: F.array_contains(F.col("prop_keys"), p).cast("double"))


def encode_node_patterns(pats: DataFrame, code: str = "word2vec", seed: int = 42,
                         vocab: list[str] | None = None) -> DataFrame:
    """ENC2: ``features`` (ML vector) = label code (5) ++ property flags."""
    vocab = property_vocabulary(pats) if vocab is None else vocab
    coded = token_code(pats, "labels_key", "_code", NODE_LABEL_DIM, code, seed)
    return (coded.withColumn("features_arr", F.concat("_code", _flags(vocab)))
            .withColumn("features", array_to_vector("features_arr")).drop("_code"))


def encode_edge_patterns(pats: DataFrame, code: str = "word2vec", seed: int = 42,
                         vocab: list[str] | None = None) -> DataFrame:
    """ENC3: rel code (10) ++ source code (4) ++ target code (4) ++ property flags."""
    vocab = property_vocabulary(pats) if vocab is None else vocab
    c = token_code(pats, "rel_type", "_rel", EDGE_REL_DIM, code, seed)
    c = token_code(c, "src_key", "_src", EDGE_SRC_DIM, code, seed)
    c = token_code(c, "dst_key", "_dst", EDGE_DST_DIM, code, seed)
    return (c.withColumn("features_arr", F.concat("_rel", "_src", "_dst", _flags(vocab)))
            .withColumn("features", array_to_vector("features_arr"))
            .drop("_rel", "_src", "_dst"))
