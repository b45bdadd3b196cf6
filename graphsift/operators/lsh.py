"""LSH clustering of patterns (CLU1-5, CLU7).

Clustering runs on distinct patterns (equal patterns have equal features
and therefore equal hashes), so the element table is never hashed or
shuffled with its ids. ``BucketedRandomProjectionLSH`` from ``pyspark.ml``
does the hashing; elements sharing the whole hash array form a cluster.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphsift.functions.sets import euclidean
from graphsift.functions.text import joined
from graphsift.operators.encode import encode_edge_patterns, encode_node_patterns
from graphsift.operators.joins import broadcast_if_small
from graphsift.operators.patterns import exact_edge_clusters, exact_node_clusters
from graphsift.session import cut_lineage

# ---- fixed values: parameter rule of the reference ----------------------------
NODE_BUCKET_FACTOR = 0.3
EDGE_BUCKET_FACTOR = 0.2
NODE_TABLES_DIVISOR = 30000
EDGE_TABLES_DIVISOR = 20000
NODE_TABLES_RANGE = (5, 10)
EDGE_TABLES_RANGE = (3, 8)
# label-set count bound -> (bucket factor, table factor)
LABEL_ADJUSTMENTS = [(3, 0.5, 1.5), (10, 1.0, 1.0), (None, 1.5, 0.7)]
DEFAULT_BUCKET = 0.2
DEFAULT_TABLES = 5
# -------------------------------------------------------------------------------

PARTNERS = 400      # expected size of the sample that all patterns are compared with
BLOCKS = 16         # it is dealt to, so that no task compares with all of it


def label_set_count(node_pats: DataFrame) -> DataFrame:
    """CLU3: number of distinct label sets (the reference counts label-set strings)."""
    return node_pats.agg(F.countDistinct("labels_key").alias("label_sets"))


def _pattern_id(encoded: DataFrame):
    """Text that names a node or edge pattern."""
    keys = ["rel_type", "src_key", "dst_key"] if "rel_type" in encoded.columns else ["labels_key"]
    return F.concat_ws("#", *keys, joined(F.col("prop_keys"), ","))


def partner_sample(encoded: DataFrame, partners: int = PARTNERS, seed: int = 42) -> DataFrame:
    """(f2, w2, p2): patterns that all others are compared with, weighted by
    their elements over their chance of being in the sample.

    The chance is ``partners / 2`` times the pattern's share of all elements,
    plus the same times its share of all patterns, at most 1. A pattern with
    more than ``2 / partners`` of all elements is always in it, so pairs of
    heavy patterns count exactly; with up to ``partners / 2`` patterns all are
    in, and every pair does. On average at most ``partners`` are in it. Which
    ones follows from a hash of the pattern, so the sample does not depend on
    partitions.
    """
    total = encoded.agg(F.sum(F.col("n").cast("double")), F.count("*")).first()
    n, patterns = total[0] or 1.0, max(1, total[1])
    chance = F.least(F.lit(1.0), F.lit(partners / 2) * (F.col("n") / F.lit(n) + F.lit(1.0 / patterns)))
    drawn = F.xxhash64(F.lit(seed), "p").cast("double") / F.lit(float(1 << 64)) + 0.5
    named = encoded.select("features_arr", F.col("n").cast("double").alias("n"), _pattern_id(encoded).alias("p"))
    return named.where(drawn < chance).select(F.col("features_arr").alias("f2"), (F.col("n") / chance).alias("w2"),
                                              F.col("p").alias("p2"))


def weighted_pairs(encoded: DataFrame, partners: int = PARTNERS, seed: int = 42) -> DataFrame:
    """(f1, f2, w): every pattern with every one of the sample but itself,
    w = n1 * n2 / chance of n2: sums over them are unbiased estimates of sums
    over all pairs of elements, and the sums themselves where all are in it."""
    sample = partner_sample(encoded, partners, seed).withColumn("b", F.pmod(F.xxhash64("p2"), F.lit(BLOCKS)))
    sample = broadcast_if_small(cut_lineage(sample))
    rows = encoded.select(F.col("features_arr").alias("f1"), F.col("n").cast("double").alias("n"),
                          _pattern_id(encoded).alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint"))).alias("b"))
    return (rows.join(sample, "b").where(F.col("p") != F.col("p2"))
            .select("f1", "f2", (F.col("n") * F.col("w2")).alias("w")))


def pattern_distance_stats(encoded: DataFrame, partners: int = PARTNERS, seed: int = 42) -> DataFrame:
    """CLU1: avg/min/max/stddev Euclidean distance over pairs with unequal
    features, weighted by the elements behind a pair, and how many (ordered)
    pairs were compared. With more patterns than ``partners / 2``, min and max
    are of the compared pairs, and the average's relative standard error is
    about that of ``partners / 2`` random draws, and none among heavy patterns."""
    d = (weighted_pairs(encoded, partners, seed).where(F.col("f1") != F.col("f2"))
         .select(euclidean("f1", "f2").alias("d"), "w"))
    avg = F.sum(F.col("w") * F.col("d")) / F.sum("w")
    square = F.sum(F.col("w") * F.col("d") * F.col("d")) / F.sum("w")
    return d.agg(avg.alias("avg_distance"), F.min("d").alias("min_distance"), F.max("d").alias("max_distance"),
                 F.sqrt(F.greatest(square - avg * avg, F.lit(0.0))).alias("stddev_distance"),
                 F.count(F.lit(1)).alias("pairs"))


def estimate_lsh_params(avg_distance: float | None, rows: int, is_edge: bool,
                        label_sets: int | None = None) -> tuple[float, int]:
    """CLU2: bucket length and number of hash tables from the reference's rule."""
    avg = avg_distance or 0.0
    if is_edge:
        bucket = avg * EDGE_BUCKET_FACTOR
        lo, hi = EDGE_TABLES_RANGE
        tables = min(hi, max(lo, rows // EDGE_TABLES_DIVISOR))
    else:
        bucket = avg * NODE_BUCKET_FACTOR
        lo, hi = NODE_TABLES_RANGE
        tables = min(hi, max(lo, rows // NODE_TABLES_DIVISOR))
        if label_sets is not None:
            for bound, bf, tf in LABEL_ADJUSTMENTS:
                if bound is None or label_sets <= bound:
                    bucket, tables = bucket * bf, max(lo, int(tables * tf))
                    break
    if bucket == 0.0:
        bucket = DEFAULT_BUCKET
    if tables == 0:
        tables = DEFAULT_TABLES
    return bucket, tables


def lsh_params_table(encoded: DataFrame, is_edge: bool, partners: int = PARTNERS,
                     seed: int = 42) -> DataFrame:
    """One-row table (avg_distance, rows, label_sets, bucket_length, num_tables)."""
    st = pattern_distance_stats(encoded, partners, seed).first()
    rows = encoded.agg(F.sum("n")).first()[0] or 0
    ls = None if is_edge else encoded.agg(F.countDistinct("labels_key")).first()[0]
    b, t = estimate_lsh_params(st["avg_distance"], int(rows), is_edge, ls)
    spark = encoded.sparkSession
    return spark.createDataFrame(
        [(st["avg_distance"], int(rows), ls, float(b), int(t))],
        "avg_distance double, rows bigint, label_sets bigint, bucket_length double, num_tables int")


def _lsh(encoded: DataFrame, exact_id: str, bucket: float, tables: int, seed: int, prefix: str):
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                        bucketLength=bucket, numHashTables=tables, seed=seed).fit(encoded)
    hashed = model.transform(encoded).withColumn("_hkey", F.col("hashes").cast("string"))
    # cluster id: the smallest exact pattern id in the bucket (deterministic)
    ids = hashed.groupBy("_hkey").agg(F.concat(F.lit(prefix), F.min(exact_id)).alias("cluster_id"))
    return hashed.join(ids, "_hkey").drop("_hkey", "hashes", "features", "features_arr", exact_id)


def lsh_cluster_nodes(node_pats: DataFrame, bucket_length: float | None = None,
                      num_tables: int | None = None, seed: int = 42, code: str = "word2vec",
                      partners: int = PARTNERS) -> DataFrame:
    """CLU4: node patterns with an LSH ``cluster_id`` (CLU7: empty in, empty out)."""
    # pattern-level tables are materialised once: fitting and parameter
    # estimation run several actions over them
    base = cut_lineage(exact_node_clusters(node_pats).withColumnRenamed("cluster_id", "_exact"))
    if base.isEmpty():
        return base.withColumnRenamed("_exact", "cluster_id")
    enc = cut_lineage(encode_node_patterns(base, code=code, seed=seed))
    if bucket_length is None or num_tables is None:
        p = lsh_params_table(enc, False, partners, seed).first()
        bucket_length = bucket_length or p["bucket_length"]
        num_tables = num_tables or p["num_tables"]
    return _lsh(enc, "_exact", bucket_length, num_tables, seed, "lsh:")


def lsh_cluster_edges(edge_pats: DataFrame, bucket_length: float | None = None,
                      num_tables: int | None = None, seed: int = 42, code: str = "word2vec",
                      partners: int = PARTNERS) -> DataFrame:
    """CLU5: edge patterns with an LSH ``cluster_id``."""
    base = cut_lineage(exact_edge_clusters(edge_pats).withColumnRenamed("cluster_id", "_exact"))
    if base.isEmpty():
        return base.withColumnRenamed("_exact", "cluster_id")
    enc = cut_lineage(encode_edge_patterns(base, code=code, seed=seed))
    if bucket_length is None or num_tables is None:
        p = lsh_params_table(enc, True, partners, seed).first()
        bucket_length = bucket_length or p["bucket_length"]
        num_tables = num_tables or p["num_tables"]
    return _lsh(enc, "_exact", bucket_length, num_tables, seed, "lsh:")
