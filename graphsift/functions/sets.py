"""Set and vector similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def jaccard(a, b) -> Column:
    """|a ∩ b| / |a ∪ b| over distinct elements; 0 when the union is empty."""
    a, b = _c(a), _c(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def euclidean(a, b) -> Column:
    """Euclidean distance of two equally long array<double> columns."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def is_abstract(labels) -> Column:
    """Endpoint/type label list counts as abstract: empty, null or all blank."""
    c = _c(labels)
    return F.coalesce(F.forall(c, lambda x: F.coalesce(F.trim(x), F.lit("")) == ""), F.lit(True))
