"""Work that grows with the edges: what rides the label joins, what is compared, how values are tested."""

from collections import Counter

import pyspark.sql.functions as F
import pytest

from graphsift.functions import typing as ty
from graphsift.plans import rdf
from graphsift.plans.catalog import _compared
from graphsift.sources import graph
from graphsift.sources.graph import EdgeSpec, attach_endpoint_labels, read_edges


def test_literals_of_raw_edges_with_ids_used_twice(make_graph):
    nodes, _ = make_graph([(1, ["A"], {}), (1, ["B"], {}), (2, ["C"], {}), (2, ["C"], {}), (None, ["D"], {})])
    _, edges = make_graph([], [("e1", 1, 2, "R", [], [], {"p": "x", "q": " "}), ("e2", 2, 3, "R", [], [], {"p": "y"}),
                               ("e3", None, 3, "S", [], [], {"p": "z"})])
    for shape in ("link", "reified"):
        wide = rdf.edge_quads(attach_endpoint_labels(edges, nodes), shape)
        narrow = rdf.raw_edge_quads(edges, nodes, shape)
        assert Counter(map(tuple, narrow.collect())) == Counter(map(tuple, wide.collect()))


def test_names_ride_the_label_joins_as_numbers(spark, make_graph):
    nodes, _ = make_graph([(1, ["A"], {}), (2, ["B"], {})])
    src = spark.createDataFrame([(1, 2, "x", None), (2, 9, None, [1])], "a bigint, b bigint, p string, q array<int>")
    specs = [EdgeSpec(src, "R", "a", "b", {"p": "p", "q": "q"}), EdgeSpec(src, "S", "b", "a", {}, distinct=True),
             EdgeSpec(src, "T", F.col("a"), F.col("b"), {"q": F.col("q")}, edge_id="concat('t', a)")]
    named = read_edges(spark, specs, nodes, values=False)
    full = read_edges(spark, specs, nodes)
    plain = ["edge_id", "src_id", "dst_id", "rel_type", "src_labels", "dst_labels"]
    rows = lambda df: sorted(map(tuple, df.select(*plain, F.sort_array(F.map_keys("props"))).collect()), key=repr)
    assert rows(named) == rows(full)
    tree = named._jdf.queryExecution().optimizedPlan().toString()
    joins = tree.index("Join")
    assert "map(" in tree[:joins] and "map(" not in tree[joins:]


def test_compared_counts_every_mismatch(spark):
    same = [(h * 7919, -h, side) for h in range(2000) for side in (1, -1)]
    odd = [(5, 5, 1), (5, 5, 1), (6, 6, -1), (-(2 ** 63), 2 ** 63 - 1, 1)]
    both = spark.createDataFrame(same + odd, "h bigint, g bigint, side int")
    assert tuple(_compared(both, 16).first()) == (2003, 4)
    assert tuple(_compared(spark.createDataFrame(same, both.schema), 16).first()) == (2000, 0)


def test_quads_written_compressed(spark, tmp_path):
    quads = spark.createDataFrame([(None, "s", "p", f"v {i}", "literal", None) for i in range(20)],
                                  "graph string, subject string, predicate string, object string, object_kind string, datatype string")
    rdf.write_quads(quads, str(tmp_path / "q"), "nquads", 5, compression="gzip")
    assert sum(f.name.endswith(".txt.gz") for f in (tmp_path / "q").iterdir()) >= 4
    assert sorted(spark.read.text(str(tmp_path / "q")).collect()) == sorted(rdf.nquads_lines(quads).collect())


def test_value_bits_equal_the_single_tests(spark):
    values = ["", " 5 ", "5", "-5", "+7", "-", "--1", "2147483648", "00012", "5\x7f", "5 ", "1e3", ".5", "1.f", "NaN", " Infinity\t",
              "Nope", "0x1p3", "1996-03-13", " 1996/03", "01-02-2003", "TRUE", "yes ", "no" * 30, "10.0.0.1", " 10.0.0.1", "10.0.0.256",
              "1.2.3.4\n", "é", " 5", "9" * 30, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    for mode in ("lenient", "strict"):
        one = df.select("k", ty.is_ip("v"), ty.is_integer("v"), ty.is_double("v"), ty.is_date("v", mode), ty.is_boolean("v"))
        t = F.btrim("v", F.lit("".join(map(chr, range(0x21)))))
        strict = F.lit(False)
        for rx in ty.STRICT_DATE_REGEXES:
            strict = strict | t.rlike(rx)
        plain = df.select("k", F.col("v").rlike(ty.IP_OCTETS_REGEX),
                          F.coalesce(F.when(t.rlike(ty.INTEGER_REGEX), t.try_cast("bigint")).between(-2 ** 31, 2 ** 31 - 1), F.lit(False)),
                          t.rlike(ty.DOUBLE_REGEX), t.rlike(ty.LENIENT_DATE_REGEX) if mode == "lenient" else strict,
                          F.lower(t).isin(ty.BOOLEAN_WORDS)).where("k < %d" % (len(values) - 1))
        bits = ty.tested(df, "v", mode, ["k"]).select("k", *ty.TESTS).where("k < %d" % (len(values) - 1))
        expected = sorted(map(tuple, plain.collect()))
        assert sorted(map(tuple, bits.collect())) == expected
        assert sorted(map(tuple, one.where("v IS NOT NULL").collect())) == expected
    last = ty.tested(df, "v", "lenient", ["k"]).where("k = %d" % (len(values) - 1)).first()
    assert last["all_int"] is None and last["n_values"] == 0


@pytest.mark.parametrize("how", ["labels", "text"])
def test_usual_edge_ids_do_not_ride_the_label_joins(spark, how):
    from graphsift.functions.text import label_key
    nodes = spark.createDataFrame([(1, ["A"], {}), (1, ["B"], {}), (2, [], {}), (None, ["C"], {})],
                                  "node_id bigint, labels array<string>, props map<string,string>")
    rows = [("R_1_2", 1, 2, "R"), ("own", 1, 2, "R"), (None, 2, 9, "R"), ("-", 2, 1, "R"), ("=x", 2, 2, "R"), ("", 2, 2, "R"),
            ("R_1", 1, None, "R"), ("", None, None, None), ("S_2_2", 2, 2, "S"), ("R_2_2", 2, 2, None)]
    raw = spark.createDataFrame(rows, "edge_id string, src_id bigint, dst_id bigint, rel_type string")
    got = (attach_endpoint_labels(raw, nodes).withColumns({f"{e}_key": label_key(f"{e}_labels") for e in ("src", "dst")})
           if how == "labels" else graph.attach_to_ends(raw, nodes, label_key("labels"), "key", ""))
    keys = {1: ["A", "B"], 2: [""], 9: [""], None: [""]}
    want = [(*r, a, b) for r in rows for a in keys[r[1]] for b in keys[r[2]]]
    found = got.select("edge_id", "src_id", "dst_id", "rel_type", "src_key", "dst_key").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    packed = [r[0] for r in raw.select(graph._own_id()).collect()]
    assert [p is None for p in packed] == [True, False, False, False, False, False, True, True, True, False]
