"""Canonical property-graph tables.

nodes(node_id BIGINT, labels ARRAY<STRING>, props MAP<STRING,STRING>)
edges(edge_id STRING, src_id BIGINT, dst_id BIGINT, rel_type STRING,
      src_labels ARRAY<STRING>, dst_labels ARRAY<STRING>, props MAP<STRING,STRING>)

Property values are text (types are inferred later); the map holds only
non-null values, so the key set of a row is its property pattern. A map
keeps the plan size independent of the number of distinct property keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphsift.operators.joins import broadcast_if_small
from graphsift.session import cut_lineage

NODE_COLUMNS = ["node_id", "labels", "props"]
EDGE_COLUMNS = ["edge_id", "src_id", "dst_id", "rel_type", "src_labels", "dst_labels", "props"]


def _text(c: Column, is_list: bool = False) -> Column:
    """Value as text; the items of a list are joined by commas."""
    return F.when(c.isNotNull(), F.concat_ws(",", c.cast("array<string>"))) if is_list else c.cast("string")


def _lists(df: DataFrame, props: Mapping[str, Column | str]) -> set[str]:
    """Names of the properties whose values are lists."""
    if not props:
        return set()
    cols = [(F.expr(v) if isinstance(v, str) else v).alias(f"p{i}") for i, v in enumerate(props.values())]
    kinds = df.select(*cols).schema.fields
    return {k for k, f in zip(props, kinds) if f.dataType.typeName() == "array"}


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def props_map_sql(props: Mapping[str, str], lists: set[str] = frozenset(), values: bool = True) -> str:
    """SQL text of :func:`props_map` for SQL-expression property values.

    One expression string is parsed JVM-side, instead of building the same
    expression tree through hundreds of driver-to-JVM calls.
    """
    empty = "CAST(map() AS MAP<STRING,STRING>)"
    if not props:
        return empty
    def text(k: str, v: str) -> str:
        if not values:
            return "CAST(NULL AS STRING)"
        return f"concat_ws(',', CAST(({v}) AS ARRAY<STRING>))" if k in lists else f"CAST(({v}) AS STRING)"

    parts = [f"CASE WHEN ({v}) IS NOT NULL THEN map({_sql_str(k)}, {text(k, v)}) ELSE {empty} END"
             for k, v in props.items()]
    return parts[0] if len(parts) == 1 else "map_concat(" + ", ".join(parts) + ")"


def props_map(props: Mapping[str, Column], lists: set[str] = frozenset(), values: bool = True) -> Column:
    """MAP<STRING,STRING> of the non-null entries of ``props``; without
    ``values`` only the keys, each with a null, so no value is ever built.

    Built from conditional one-entry maps (``map_concat`` / ``CASE``), which
    stay inside whole-stage codegen, unlike a lambda ``filter``.
    """
    empty = F.create_map().cast("map<string,string>")
    if not props:
        return empty
    parts = []
    for k, v in props.items():
        t = _text(v, k in lists)
        entry = F.create_map(F.lit(k), t if values else F.lit(None).cast("string"))
        parts.append(F.when(t.isNotNull(), entry).otherwise(empty))
    return parts[0] if len(parts) == 1 else F.map_concat(*parts)


# Names that a number can mark, one bit each.
_MASK_BITS = 62


def names_mask(props: Mapping[str, Column | str], lists: set[str] = frozenset()) -> Column:
    """The names :func:`props_map` would hold, as bits of a number in the order of ``props``."""
    out = F.lit(0).cast("bigint")
    for i, (k, v) in enumerate(_columns(props).items()):
        out = out + F.when(_text(v, k in lists).isNotNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return out


def names_of_mask(mask: Column, names: Sequence[str]) -> Column:
    """The map of names alone that :func:`names_mask` stands for."""
    return props_map({k: F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit("")) for i, k in enumerate(names)},
                     values=False)


@dataclass
class NodeSpec:
    """One node source: a DataFrame (or loader) plus how to read id, labels, props.

    ``labels`` is a list of fixed labels or a Column / SQL text of ARRAY<STRING>.
    ``props`` maps property name -> Column or SQL text (any type, stringified).
    ``id_offset`` is added to the id column so several tables share one id space.
    """
    source: DataFrame | Callable[[SparkSession], DataFrame]
    id_col: str | Column
    labels: Sequence[str] | Column | str = ()
    props: Mapping[str, Column | str] = field(default_factory=dict)
    id_offset: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source(spark)


@dataclass
class EdgeSpec:
    """One edge source. ``edge_id`` defaults to ``rel_src_dst``."""
    source: DataFrame | Callable[[SparkSession], DataFrame]
    rel_type: str | Column
    src_col: str | Column
    dst_col: str | Column
    props: Mapping[str, Column | str] = field(default_factory=dict)
    src_offset: int = 0
    dst_offset: int = 0
    edge_id: Column | str | None = None
    distinct: bool = False

    def frame(self, spark: SparkSession) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source(spark)


def _col(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def read_nodes(spark: SparkSession, specs: Sequence[NodeSpec], values: bool = True) -> DataFrame:
    """SRC1: union of node sources in canonical form (one scan per source).

    Without ``values`` the property maps hold the names alone: enough for
    patterns, clusters and types, and nothing of the values is carried along."""
    frames = []
    for s in specs:
        df = s.frame(spark)
        lists = _lists(df, s.props)
        if _all_sql(s.props) and isinstance(s.id_col, str) and not isinstance(s.labels, Column):
            labels = s.labels if isinstance(s.labels, str) else (
                "CAST(array(" + ", ".join(_sql_str(x) for x in s.labels) + ") AS ARRAY<STRING>)")
            frames.append(df.selectExpr(
                f"CAST({s.id_col} AS BIGINT) + {int(s.id_offset)} AS node_id",
                f"coalesce({labels}, CAST(array() AS ARRAY<STRING>)) AS labels",
                f"{props_map_sql(s.props, lists, values)} AS props"))
            continue
        labels = (s.labels if isinstance(s.labels, Column)
                  else F.expr(s.labels) if isinstance(s.labels, str)
                  else F.array(*[F.lit(x) for x in s.labels]).cast("array<string>"))
        frames.append(df.select(
            (_col(s.id_col).cast("bigint") + F.lit(s.id_offset)).alias("node_id"),
            F.coalesce(labels, F.array().cast("array<string>")).alias("labels"),
            props_map(_columns(s.props), lists, values).alias("props"),
        ))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _columns(props: Mapping[str, Column | str]) -> dict[str, Column]:
    return {k: F.expr(v) if isinstance(v, str) else v for k, v in props.items()}


def _all_sql(props: Mapping) -> bool:
    return all(isinstance(v, str) for v in props.values())


def read_edges(spark: SparkSession, specs: Sequence[EdgeSpec], nodes: DataFrame | None,
               values: bool = True) -> DataFrame:
    """SRC2: union of edge sources, endpoint label sets attached from ``nodes``.

    Without ``values`` the property maps hold the names alone (see
    :func:`read_nodes`), and the joins with the labels carry no value: an edge
    is a few numbers there, its source's place in ``specs`` and a bit per name."""
    if nodes is not None and not values and all(len(s.props) <= _MASK_BITS and isinstance(s.rel_type, str) for s in specs):
        return _read_named_edges(spark, specs, nodes)
    frames = []
    for s in specs:
        df = s.frame(spark)
        lists = _lists(df, s.props)
        if (_all_sql(s.props) and isinstance(s.rel_type, str) and isinstance(s.src_col, str)
                and isinstance(s.dst_col, str) and (s.edge_id is None or isinstance(s.edge_id, str))):
            src = f"CAST({s.src_col} AS BIGINT) + {int(s.src_offset)}"
            dst = f"CAST({s.dst_col} AS BIGINT) + {int(s.dst_offset)}"
            cols = [f"{_sql_str(s.rel_type)} AS rel_type", f"{src} AS src_id", f"{dst} AS dst_id",
                    f"{props_map_sql(s.props, lists, values)} AS props"]
            cols.append(f"CAST({s.edge_id} AS STRING) AS edge_id" if s.edge_id is not None
                        else f"concat_ws('_', {_sql_str(s.rel_type)}, {src}, {dst}) AS edge_id")
            if s.distinct and not s.props and s.edge_id is None:
                # dedup the primitive endpoint pair first (hash aggregate with
                # map-side partial dedup), then build the row
                base = df.selectExpr(f"{src} AS src_id", f"{dst} AS dst_id").distinct()
                e = base.selectExpr(f"{_sql_str(s.rel_type)} AS rel_type", "src_id", "dst_id",
                                    f"{props_map_sql({})} AS props",
                                    f"concat_ws('_', {_sql_str(s.rel_type)}, src_id, dst_id) AS edge_id")
                frames.append(e.select("edge_id", "src_id", "dst_id", "rel_type", "props"))
                continue
            e = df.selectExpr(*cols)
            if s.distinct:
                e = e.dropDuplicates(["rel_type", "src_id", "dst_id"])
            frames.append(e.select("edge_id", "src_id", "dst_id", "rel_type", "props"))
            continue
        rel = F.lit(s.rel_type) if isinstance(s.rel_type, str) else s.rel_type
        src = (_col(s.src_col).cast("bigint") + F.lit(s.src_offset))
        dst = (_col(s.dst_col).cast("bigint") + F.lit(s.dst_offset))
        cols = [rel.alias("rel_type"), src.alias("src_id"), dst.alias("dst_id"),
                props_map(_columns(s.props), lists, values).alias("props")]
        if s.edge_id is not None:
            cols.append(_col(s.edge_id).cast("string").alias("edge_id"))
        e = df.select(*cols)
        if s.distinct:
            e = e.dropDuplicates(["rel_type", "src_id", "dst_id"])
        if s.edge_id is None:
            e = e.withColumn("edge_id", F.concat_ws("_", "rel_type", "src_id", "dst_id"))
        frames.append(e.select("edge_id", "src_id", "dst_id", "rel_type", "props"))
    raw = frames[0]
    for f in frames[1:]:
        raw = raw.unionByName(f)
    if nodes is None:
        return raw.select(
            "edge_id", "src_id", "dst_id", "rel_type",
            F.array().cast("array<string>").alias("src_labels"),
            F.array().cast("array<string>").alias("dst_labels"), "props")
    return attach_endpoint_labels(raw, nodes)


def _read_named_edges(spark: SparkSession, specs: Sequence[EdgeSpec], nodes: DataFrame) -> DataFrame:
    """:func:`read_edges` with names alone; maps and relation types are made after the joins."""
    raw = None
    for i, s in enumerate(specs):
        df = s.frame(spark)
        e = df.select((_col(s.src_col).cast("bigint") + F.lit(s.src_offset)).alias("src_id"),
                      (_col(s.dst_col).cast("bigint") + F.lit(s.dst_offset)).alias("dst_id"),
                      names_mask(s.props, _lists(df, s.props)).alias("_mask"),
                      *([] if s.edge_id is None else [_col(s.edge_id).cast("string").alias("edge_id")]))
        if s.distinct:
            e = e.distinct() if not s.props and s.edge_id is None else e.dropDuplicates(["src_id", "dst_id"])
        if s.edge_id is None:
            e = e.withColumn("edge_id", F.concat_ws("_", F.lit(s.rel_type), "src_id", "dst_id"))
        e = e.select("edge_id", "src_id", "dst_id", F.lit(i).alias("_spec"), "_mask")
        raw = e if raw is None else raw.unionByName(e)
    out = attach_endpoint_labels(raw, nodes)
    rel, props = F.lit(specs[-1].rel_type), names_of_mask(F.col("_mask"), list(specs[-1].props))
    for i, s in reversed(list(enumerate(specs[:-1]))):
        here = F.col("_spec") == i
        rel = F.when(here, F.lit(s.rel_type)).otherwise(rel)
        props = F.when(here, names_of_mask(F.col("_mask"), list(s.props))).otherwise(props)
    return out.withColumns({"rel_type": rel, "props": props}).select(*EDGE_COLUMNS)


def attach_endpoint_labels(raw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add src_labels/dst_labels by two equi-joins on node id; all columns of
    ``raw_edges`` ride along, so give it only what is needed afterwards.

    Plain left joins: Spark/AQE picks broadcast when the node side is small
    and sort-merge otherwise; a hub node with a large share of the edges is
    split by AQE's skew-join handling. Edges whose endpoint is missing keep
    an empty label list (an abstract endpoint).
    """
    lab = nodes.select("node_id", "labels")
    s = lab.select(F.col("node_id").alias("src_id"), F.col("labels").alias("src_labels"))
    d = lab.select(F.col("node_id").alias("dst_id"), F.col("labels").alias("dst_labels"))
    empty = F.array().cast("array<string>")
    given = [c for c in raw_edges.columns if c not in ("src_labels", "dst_labels")]
    narrow = raw_edges.select(given)
    own = {"edge_id", "rel_type"} <= set(given)
    if own:
        narrow = narrow.withColumn("edge_id", _own_id())
    out = (narrow.join(s, "src_id", "left").join(d, "dst_id", "left")
           .withColumns({c: F.coalesce(c, empty) for c in ("src_labels", "dst_labels")}))
    if own:
        out = out.withColumn("edge_id", _whole_id())
    return out.select([c for c in EDGE_COLUMNS if c in out.columns] + [c for c in given if c not in EDGE_COLUMNS])


def _usual_id() -> Column:
    return F.concat_ws("_", "rel_type", "src_id", "dst_id")


def _own_id() -> Column:
    """What of ``edge_id`` must ride a join: nothing (null) where it is the usual one."""
    return (F.when(F.col("edge_id").isNull(), F.lit("-"))
            .when(F.col("edge_id") != _usual_id(), F.concat(F.lit("="), F.col("edge_id").cast("string"))))


def _whole_id() -> Column:
    """The id that :func:`_own_id` has packed."""
    return (F.when(F.col("edge_id").isNull(), _usual_id())
            .when(F.col("edge_id") != "-", F.substring("edge_id", 2, 1 << 30)))


def attach_to_ends(raw_edges: DataFrame, nodes: DataFrame, value: Column, name: str, missing: str) -> DataFrame:
    """(edge_id, src_id, dst_id, rel_type, src_<name>, dst_<name>): the text ``value`` of both
    endpoints, made once per node, by the joins of :func:`attach_endpoint_labels`; ``missing`` where no
    node has it. An edge's id rides them only if it is not the one it would get."""
    out = raw_edges.select(_own_id().alias("edge_id"), "src_id", "dst_id", "rel_type")
    told = nodes.select("node_id", value.alias("value"))
    for end in ("src", "dst"):
        out = out.join(told.select(F.col("node_id").alias(f"{end}_id"), F.col("value").alias(f"{end}_{name}")), f"{end}_id", "left")
    return out.select(_whole_id().alias("edge_id"), "src_id", "dst_id", "rel_type",
                      *[F.coalesce(f"{end}_{name}", F.lit(missing)).alias(f"{end}_{name}") for end in ("src", "dst")])


def as_often(raw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``raw_edges``, each as often as :func:`attach_endpoint_labels` gives it: once,
    unless ids of ``nodes`` come twice. Only those ids meet the edges."""
    twice = cut_lineage(nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1 AND node_id IS NOT NULL"))
    if twice.isEmpty():
        return raw_edges
    out, small = raw_edges, broadcast_if_small(twice)
    for end in ("src", "dst"):
        out = out.join(small.select(F.col("node_id").alias(f"{end}_id"), F.col("n").alias(f"_{end}_n")), f"{end}_id", "left")
    times = F.coalesce("_src_n", F.lit(1)) * F.coalesce("_dst_n", F.lit(1))
    out = out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    return out.select(raw_edges.columns)
