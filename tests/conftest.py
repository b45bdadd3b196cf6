import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphsift.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="graphsift-tests")
    yield s


NODE_SCHEMA = "node_id bigint, labels array<string>, props map<string,string>"
EDGE_SCHEMA = ("edge_id string, src_id bigint, dst_id bigint, rel_type string, "
               "src_labels array<string>, dst_labels array<string>, props map<string,string>")


@pytest.fixture(scope="session")
def make_graph(spark):
    def build(nodes, edges=()):
        n = spark.createDataFrame(list(nodes), NODE_SCHEMA)
        e = spark.createDataFrame(list(edges), EDGE_SCHEMA)
        return n, e
    return build
