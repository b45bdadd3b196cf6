"""End-to-end schema discovery: nodes/edges -> typed node and edge types.

One lazy DataFrame graph. The only passes over element-level data are the
two pattern aggregations, the two value-typing aggregations and the degree
statistics; everything else runs on pattern- or type-level tables.
"""

from __future__ import annotations


from pyspark.sql import DataFrame

from graphsift.operators import infer, merge, patterns, profile
from graphsift.session import cut_lineage


class GraphSchema:
    """Lazily computed schema tables; each is built (and, with ``materialize``,
    checkpointed into the shared checkpoint folder) on first access only.

    node_types          type_id, labels, is_abstract, n, n_clusters, mandatory, optional
    edge_types          type_id, rel_types, src_labels, dst_labels, n, mandatory, optional, cardinality
    node_pattern_types  labels_key, prop_keys, n, cluster_id, type_id
    edge_pattern_types  rel_type, src_key, dst_key, prop_keys, n, cluster_id, type_id
    node_prop_types / edge_prop_types   property, type, n_values
    cardinality         rel_type, degree statistics, cardinality
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, raw_edges: DataFrame | None,
                 method: str, threshold: float, multi: bool, granularity: str,
                 edge_merge: str, date_mode: str, materialize: bool, lsh_options: dict):
        self._nodes, self._edges = nodes, edges
        self._raw, self._plain = raw_edges, raw_edges if raw_edges is not None else edges
        self._method, self._threshold, self._multi = method, threshold, multi
        self._granularity, self._edge_merge, self._date_mode = granularity, edge_merge, date_mode
        self._keep = cut_lineage if materialize else (lambda df: df)
        self._lsh = lsh_options
        self._memo: dict[str, DataFrame] = {}

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = self._keep(build())
        return self._memo[name]

    # one pass per element table: pattern counts and value typing together
    def _node_profile(self) -> DataFrame:
        return self._get("nprof", lambda: profile.node_profile(self._nodes, self._date_mode))

    # With raw edges, values are typed there and only names ride the label joins.
    def _edge_profile(self) -> DataFrame:
        return self._get("eprof", lambda: profile.edge_profile(self._edges, self._date_mode, self._raw))

    @property
    def node_patterns(self) -> DataFrame:
        return profile.patterns_of(self._node_profile(), patterns.NODE_KEY)

    @property
    def edge_patterns(self) -> DataFrame:
        return profile.patterns_of(self._edge_profile(), patterns.EDGE_KEY)

    def _node_merge(self):
        if "nt" not in self._memo:
            assigned = cluster_nodes(self.node_patterns, self._method, **self._lsh)
            t, pt = merge.merge_node_types(assigned, self._threshold, self._multi, self._granularity,
                                           keep=self._keep)
            self._memo["npt"] = pt
            self._memo["nt"] = self._keep(t)
        return self._memo["nt"], self._memo["npt"]

    def _edge_merge_(self):
        if "et" not in self._memo:
            assigned = cluster_edges(self.edge_patterns, self._method, **self._lsh)
            t, pt = merge.merge_edge_types(assigned, self._edge_merge, keep=self._keep)
            self._memo["ept"] = pt
            self._memo["et"] = self._keep(infer.type_cardinality(t, self.cardinality))
        return self._memo["et"], self._memo["ept"]

    @property
    def node_types(self) -> DataFrame:
        return self._node_merge()[0]

    @property
    def node_pattern_types(self) -> DataFrame:
        return self._node_merge()[1]

    @property
    def edge_types(self) -> DataFrame:
        return self._edge_merge_()[0]

    @property
    def edge_pattern_types(self) -> DataFrame:
        return self._edge_merge_()[1]

    @property
    def cardinality(self) -> DataFrame:
        return self._get("card", lambda: infer.infer_cardinality(self._plain))

    @property
    def node_prop_types(self) -> DataFrame:
        return profile.types_of(self._node_profile())

    @property
    def edge_prop_types(self) -> DataFrame:
        return profile.types_of(self._edge_profile())

    def typed_node_types(self) -> DataFrame:
        """node_types + mandatory_typed / optional_typed (array<struct<name,type>>)."""
        return self._get("tnt", lambda: infer.annotate_types(self.node_types, self.node_prop_types))

    def typed_edge_types(self) -> DataFrame:
        return self._get("tet", lambda: infer.annotate_types(self.edge_types, self.edge_prop_types))


def cluster_nodes(node_pats: DataFrame, method: str = "exact", **lsh_options) -> DataFrame:
    if method == "exact":
        return patterns.exact_node_clusters(node_pats)
    if method == "lsh":
        from graphsift.operators import lsh
        return lsh.lsh_cluster_nodes(node_pats, **lsh_options)
    raise ValueError(f"unknown clustering method {method!r}")


def cluster_edges(edge_pats: DataFrame, method: str = "exact", **lsh_options) -> DataFrame:
    if method == "exact":
        return patterns.exact_edge_clusters(edge_pats)
    if method == "lsh":
        from graphsift.operators import lsh
        return lsh.lsh_cluster_edges(edge_pats, **lsh_options)
    raise ValueError(f"unknown clustering method {method!r}")


def discover_schema(nodes: DataFrame, edges: DataFrame, method: str = "exact",
                    threshold: float = 0.9, multi: bool = False,
                    granularity: str = "instance", edge_merge: str = "rel_type",
                    date_mode: str = "lenient", raw_edges: DataFrame | None = None,
                    materialize: bool = True, **lsh_options) -> GraphSchema:
    """Discover node and edge types (lazy; see :class:`GraphSchema`).

    ``raw_edges`` (edges before endpoint labels were attached) lets typing and
    degree statistics skip the two label joins: of ``edges`` only the names of
    properties are then used, so read them with ``values=False``. With ``materialize`` the
    small pattern-, type- and statistics-level tables are checkpointed into
    the shared checkpoint folder, so later steps never re-scan elements and
    survive executor loss without recomputing the element aggregations.
    """
    return GraphSchema(nodes, edges, raw_edges, method, threshold, multi, granularity,
                       edge_merge, date_mode, materialize, lsh_options)
