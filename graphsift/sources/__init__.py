"""Graph sources: canonical node/edge tables from parquet, CSV, XML or a connector."""

from graphsift.sources.graph import (  # noqa: F401
    EDGE_COLUMNS, NODE_COLUMNS, NodeSpec, EdgeSpec, attach_endpoint_labels,
    props_map, read_edges, read_nodes,
)
from graphsift.sources.fixture import fixture_graph  # noqa: F401
