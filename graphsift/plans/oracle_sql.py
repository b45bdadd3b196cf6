"""DuckDB SQL for the correctness oracle.

The fixture graph is rendered in long form from the driver's tables:
  gnodes(node_id, labels_key)            every node
  gprops(node_id, labels_key, key, value) non-null node properties
  gedges(edge_id, rel_type, src_id, dst_id, src_key, dst_key)
  geprops(edge_id, key, value)            non-null edge properties
Each query below is written independently from the Spark code, on these
views only, with the same output column names.
"""

from __future__ import annotations

# ---- fixed values, written out here: the oracle takes nothing from the code it checks ----
IP_PROPERTY = "locationIP"
BOOLEANS = "('true', 'false', 'yes', 'no', '1', '0')"
INTEGER = "^[+-]?[0-9]+$"
DECIMAL = "([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
HEXADECIMAL = "0[xX]([0-9a-fA-F]+[.]?[0-9a-fA-F]*|[.][0-9a-fA-F]+)[pP][+-]?[0-9]+"
DOUBLE = f"^[+-]?(NaN|Infinity|({DECIMAL}|{HEXADECIMAL})[fFdD]?)$"
QUAD = "^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$"
LENIENT_DATE = "^-?[0-9]"
STRICT_DATE = ("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}"
               "|[0-9]{4}|[0-9]{4}/[0-9]{2}|[0-9]{2}/[0-9]{4})$")
PG_NAMES = {"string": "STRING", "int": "INT", "int32": "INT32", "integer": "INTEGER", "date": "DATE", "double": "DOUBLE",
            "boolean": "BOOLEAN"}
XSD_NAMES = {"string": "xs:string", "int": "xs:integer", "integer": "xs:integer", "int32": "xs:integer",
             "double": "xs:decimal", "boolean": "xs:boolean", "date": "xs:date"}
# ------------------------------------------------------------------------------------------

MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS VARCHAR)"
DAY = "strftime({}, '%Y-%m-%d')"

# (table, kind, id column, labels_key SQL, {property: value SQL})
NODE_TABLES = [
    ("region", 1, "r_regionkey", "'Region'", {"name": "r_name"}),
    ("nation", 2, "n_nationkey", "'Nation'", {"name": "n_name"}),
    ("customer", 3, "c_custkey",
     "CASE WHEN c_custkey % 10 = 3 THEN '' WHEN c_acctbal > 9000 THEN 'Customer:Premium' ELSE 'Customer' END",
     {"name": "c_name", "acctbal": MONEY.format("c_acctbal"),
      "mktsegment": "CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END"}),
    ("supplier", 4, "s_suppkey", "'Supplier'",
     {"name": "s_name", "acctbal": MONEY.format("s_acctbal")}),
    ("part", 5, "p_partkey", "'Part'",
     {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "CAST(p_size AS VARCHAR)",
      "retailprice": MONEY.format("p_retailprice")}),
    ("orders", 6, "o_orderkey", "CASE WHEN o_orderkey % 20 = 7 THEN '' ELSE 'Order' END",
     {"status": "o_orderstatus", "totalprice": MONEY.format("o_totalprice"),
      "orderdate": DAY.format("o_orderdate"),
      "orderpriority": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"}),
    ("documents", 7, "doc_id", "'Document'",
     {"lang": "lang", "source": "source", "n_chars": "CAST(n_chars AS VARCHAR)", "text": "text"}),
    ("labels", 8, "doc_id", "'Grade'",
     {"quality": "CAST(quality AS VARCHAR)",
      "toxic": "CASE WHEN toxic = 1 THEN 'true' WHEN toxic IS NOT NULL THEN 'false' END"}),
]

LI_ID = ("'CONTAINS_' || concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
         + DAY.format("l_shipdate") + ")")

# (rel, select SQL producing edge_id, src_id, dst_id [+ props], {prop: value SQL})
EDGE_SOURCES = [
    ("IN_REGION", "SELECT n_nationkey * 16 + 2 AS src_id, n_regionkey * 16 + 1 AS dst_id FROM nation", {}),
    ("IN_NATION", "SELECT c_custkey * 16 + 3 AS src_id, c_nationkey * 16 + 2 AS dst_id FROM customer", {}),
    ("IN_NATION", "SELECT s_suppkey * 16 + 4 AS src_id, s_nationkey * 16 + 2 AS dst_id FROM supplier", {}),
    ("PLACED", "SELECT o_custkey * 16 + 3 AS src_id, o_orderkey * 16 + 6 AS dst_id, "
               + DAY.format("o_orderdate") + " AS p_orderdate FROM orders", {"orderdate": "p_orderdate"}),
    ("CONTAINS", "SELECT " + LI_ID + " AS eid, l_orderkey * 16 + 6 AS src_id, l_partkey * 16 + 5 AS dst_id, "
                 + MONEY.format("l_quantity") + " AS p_quantity, CAST(l_linenumber AS VARCHAR) AS p_linenumber, "
                 + DAY.format("l_shipdate") + " AS p_shipdate, "
                 "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS p_returnflag FROM lineitem",
     {"quantity": "p_quantity", "linenumber": "p_linenumber", "shipdate": "p_shipdate",
      "returnflag": "p_returnflag"}),
    ("SUPPLIES", "SELECT DISTINCT l_suppkey * 16 + 4 AS src_id, l_partkey * 16 + 5 AS dst_id FROM lineitem", {}),
    ("GRADED", "SELECT doc_id * 16 + 7 AS src_id, doc_id * 16 + 8 AS dst_id FROM labels", {}),
]


def _fixture_ctes() -> str:
    nodes, props = [], []
    for table, base, idc, lk, pmap in NODE_TABLES:
        nodes.append(f"SELECT {idc} * 16 + {base} AS node_id, {lk} AS labels_key FROM {table}")
        for k, v in pmap.items():
            props.append(f"SELECT {idc} * 16 + {base} AS node_id, {lk} AS labels_key, '{k}' AS key, "
                         f"{v} AS value FROM {table} WHERE ({v}) IS NOT NULL")
    raw, eprops = [], []
    for i, (rel, sel, pmap) in enumerate(EDGE_SOURCES):
        eid = "eid" if "eid" in sel else f"concat_ws('_', '{rel}', src_id, dst_id)"
        raw.append(f"SELECT {eid} AS edge_id, '{rel}' AS rel_type, src_id, dst_id FROM ({sel}) s{i}")
        for k, v in pmap.items():
            eprops.append(f"SELECT {eid} AS edge_id, '{k}' AS key, {v} AS value FROM ({sel}) s{i} "
                          f"WHERE {v} IS NOT NULL")
    return (
        "gnodes AS (" + " UNION ALL ".join(nodes) + "),\n"
        "gprops AS (" + " UNION ALL ".join(props) + "),\n"
        "graw AS (" + " UNION ALL ".join(raw) + "),\n"
        "gedges AS (SELECT r.edge_id, r.rel_type, r.src_id, r.dst_id, "
        "coalesce(s.labels_key, '') AS src_key, coalesce(d.labels_key, '') AS dst_key "
        "FROM graw r LEFT JOIN gnodes s ON r.src_id = s.node_id LEFT JOIN gnodes d ON r.dst_id = d.node_id),\n"
        "geprops AS (" + " UNION ALL ".join(eprops) + ")"
    )


FIXTURE = _fixture_ctes()

# Pattern and type derivations shared by several oracles.
PATTERN_CTES = """
npat AS (SELECT n.node_id, n.labels_key, coalesce(string_agg(p.key, ',' ORDER BY p.key), '') AS props_key
         FROM gnodes n LEFT JOIN gprops p ON n.node_id = p.node_id GROUP BY n.node_id, n.labels_key),
npatterns AS (SELECT labels_key, props_key, count(*) AS n FROM npat GROUP BY 1, 2),
ltype_props AS (SELECT DISTINCT labels_key AS type_id, key FROM gprops WHERE labels_key <> ''),
ltype_size AS (SELECT type_id, count(*) AS sz FROM ltype_props GROUP BY 1),
upat AS (SELECT props_key, n FROM npatterns WHERE labels_key = ''),
upat_keys AS (SELECT DISTINCT u.props_key, p.key FROM upat u JOIN npat q ON q.labels_key = '' AND q.props_key = u.props_key
              JOIN gprops p ON p.node_id = q.node_id),
upat_size AS (SELECT props_key, count(*) AS sz FROM upat_keys GROUP BY 1),
jac AS (SELECT k.props_key, t.type_id, count(*) AS inter FROM upat_keys k JOIN ltype_props t ON k.key = t.key GROUP BY 1, 2),
jac2 AS (SELECT j.props_key, j.type_id, j.inter * 1.0 / (us.sz + ts.sz - j.inter) AS jaccard
         FROM jac j JOIN upat_size us USING (props_key) JOIN ltype_size ts USING (type_id)),
best AS (SELECT props_key, type_id FROM (
           SELECT *, row_number() OVER (PARTITION BY props_key ORDER BY jaccard DESC, type_id) AS r
           FROM jac2 WHERE jaccard >= 0.9 - 1e-9) WHERE r = 1),
node_type AS (SELECT q.node_id, q.labels_key, q.props_key,
                     CASE WHEN q.labels_key <> '' THEN q.labels_key
                          ELSE coalesce(b.type_id, '?#' || q.props_key) END AS type_id
              FROM npat q LEFT JOIN best b ON q.labels_key = '' AND b.props_key = q.props_key),
tsize AS (SELECT type_id, count(*) AS n FROM node_type GROUP BY 1),
tprop AS (SELECT t.type_id, p.key, count(*) AS cnt FROM node_type t JOIN gprops p ON p.node_id = t.node_id GROUP BY 1, 2),
tsplit AS (SELECT s.type_id, s.n,
             coalesce(string_agg(CASE WHEN p.cnt = s.n THEN p.key END, ',' ORDER BY p.key), '') AS mandatory,
             coalesce(string_agg(CASE WHEN p.cnt < s.n THEN p.key END, ',' ORDER BY p.key), '') AS optional
           FROM tsize s LEFT JOIN tprop p USING (type_id) GROUP BY 1, 2),
epat AS (SELECT e.edge_id, e.rel_type, e.src_key, e.dst_key, e.src_id, e.dst_id,
                coalesce(string_agg(p.key, ',' ORDER BY p.key), '') AS props_key
         FROM gedges e LEFT JOIN geprops p ON e.edge_id = p.edge_id
         GROUP BY e.edge_id, e.rel_type, e.src_key, e.dst_key, e.src_id, e.dst_id),
edge_type AS (SELECT *, CASE WHEN src_key <> '' OR dst_key <> '' THEN rel_type
                         ELSE '?' || concat_ws('#', rel_type, src_key, dst_key, props_key) END AS type_id FROM epat),
esize AS (SELECT type_id, count(*) AS n FROM edge_type GROUP BY 1),
eprop AS (SELECT t.type_id, p.key, count(*) AS cnt FROM edge_type t JOIN geprops p ON p.edge_id = t.edge_id GROUP BY 1, 2),
esplit AS (SELECT s.type_id, s.n,
             coalesce(string_agg(CASE WHEN p.cnt = s.n THEN p.key END, ',' ORDER BY p.key), '') AS mandatory,
             coalesce(string_agg(CASE WHEN p.cnt < s.n THEN p.key END, ',' ORDER BY p.key), '') AS optional
           FROM esize s LEFT JOIN eprop p USING (type_id) GROUP BY 1, 2),
emeta AS (SELECT type_id, string_agg(DISTINCT rel_type, '|' ORDER BY rel_type) AS rel_types,
             coalesce(string_agg(DISTINCT CASE WHEN src_key <> '' THEN src_key END, '|' ORDER BY CASE WHEN src_key <> '' THEN src_key END), '') AS src_labels,
             coalesce(string_agg(DISTINCT CASE WHEN dst_key <> '' THEN dst_key END, '|' ORDER BY CASE WHEN dst_key <> '' THEN dst_key END), '') AS dst_labels
          FROM edge_type GROUP BY 1),
dpairs AS (SELECT DISTINCT rel_type, src_id, dst_id FROM gedges),
outd AS (SELECT rel_type, src_id, count(*) AS d FROM dpairs GROUP BY 1, 2),
ind AS (SELECT rel_type, dst_id, count(*) AS d FROM dpairs GROUP BY 1, 2),
card AS (SELECT o.rel_type, o.max_dst_per_src, o.min_dst_per_src, o.avg_dst_per_src,
                i.max_src_per_dst, i.min_src_per_dst, i.avg_src_per_dst,
                CASE WHEN o.max_dst_per_src = 1 AND i.max_src_per_dst = 1 THEN '1:1'
                     WHEN o.max_dst_per_src > 1 AND i.max_src_per_dst = 1 THEN '1:N'
                     WHEN o.max_dst_per_src = 1 AND i.max_src_per_dst > 1 THEN 'N:1'
                     WHEN o.max_dst_per_src > 1 AND i.max_src_per_dst > 1 THEN 'N:N'
                     ELSE 'Unknown' END AS cardinality
         FROM (SELECT rel_type, max(d) AS max_dst_per_src, min(d) AS min_dst_per_src, avg(d) AS avg_dst_per_src FROM outd GROUP BY 1) o
         JOIN (SELECT rel_type, max(d) AS max_src_per_dst, min(d) AS min_src_per_dst, avg(d) AS avg_src_per_dst FROM ind GROUP BY 1) i
         USING (rel_type)),
ecard AS (SELECT m.type_id, string_agg(c.cardinality, ',' ORDER BY c.rel_type) AS cardinality
          FROM (SELECT DISTINCT type_id, rel_type FROM edge_type) m JOIN card c USING (rel_type) GROUP BY 1)
"""


def _typing_cte(src: str, name: str, date: str = LENIENT_DATE) -> str:
    """Per-property type over a (key, value) relation, same rules as the Spark side."""
    t = "trim(value)"
    return f"""
{name} AS (SELECT key AS property,
  CASE WHEN key = '{IP_PROPERTY}' OR bool_and(ipok) THEN 'String'
       WHEN bool_and(intok) THEN 'Integer'
       WHEN bool_and(dblok) THEN 'Double'
       WHEN bool_and(dateok) THEN 'Date'
       WHEN bool_and(boolok) THEN 'Boolean'
       ELSE 'String' END AS type,
  count(*) AS n_values
FROM (SELECT key,
  coalesce(regexp_matches({t}, '{INTEGER}') AND TRY_CAST({t} AS BIGINT) BETWEEN -2147483648 AND 2147483647, false) AS intok,
  coalesce(regexp_matches({t}, '{DOUBLE}'), false) AS dblok,
  coalesce(regexp_matches({t}, '{date}'), false) AS dateok,
  coalesce(lower({t}) IN {BOOLEANS}, false) AS boolok,
  coalesce(regexp_matches({t}, '{QUAD}') AND regexp_matches(value, '{QUAD}')
           AND list_bool_and(list_transform(string_split(value, '.'), lambda x: TRY_CAST(x AS INTEGER) <= 255)), false) AS ipok
  FROM {src} WHERE key <> 'original_label') v
GROUP BY key)"""


STRICT_CTES = _typing_cte("gprops", "nptypes", STRICT_DATE) + "," + _typing_cte("geprops", "eptypes", STRICT_DATE)
TYPING_CTES = _typing_cte("gprops", "nptypes") + "," + _typing_cte("geprops", "eptypes")


def with_fixture(body: str, patterns: bool = False, typing: bool = False) -> str:
    parts = [FIXTURE]
    if patterns:
        parts.append(PATTERN_CTES)
    if typing:
        parts.append(TYPING_CTES)
    return "WITH " + ",\n".join(parts) + "\n" + body


def _pg(t: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PG_NAMES.items())
    return f"(CASE lower(trim({t})) {cases} ELSE 'STRING' END)"


def _xsd(t: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in XSD_NAMES.items())
    return f"(CASE lower(trim({t})) {cases} ELSE 'xs:string' END)"


SAFE = "regexp_replace({}, '[^A-Za-z0-9_.\\-]', '_', 'g')"

# Type-level derivations for schema text, XSD fields, rules, quads (need PATTERN + TYPING CTEs).
SINK_CTES = f"""
ntl AS (SELECT type_id, unnest(string_split(mandatory, ',')) AS property, true AS mand FROM tsplit WHERE mandatory <> ''
        UNION ALL SELECT type_id, unnest(string_split(optional, ',')) AS property, false AS mand FROM tsplit WHERE optional <> ''),
ntt AS (SELECT l.*, coalesce(t.type, 'Unknown') AS type FROM ntl l LEFT JOIN nptypes t USING (property)),
etl AS (SELECT type_id, unnest(string_split(mandatory, ',')) AS property, true AS mand FROM esplit WHERE mandatory <> ''
        UNION ALL SELECT type_id, unnest(string_split(optional, ',')) AS property, false AS mand FROM esplit WHERE optional <> ''),
ett AS (SELECT l.*, coalesce(t.type, 'Unknown') AS type FROM etl l LEFT JOIN eptypes t USING (property)),
nblock AS (SELECT type_id,
   string_agg(property || ' ' || {_pg('type')}, ', ' ORDER BY NOT mand, property) AS loose,
   string_agg(CASE WHEN mand THEN '' ELSE 'OPTIONAL ' END || property || ' ' || {_pg('type')}, ', ' ORDER BY NOT mand, property) AS strict
   FROM ntt WHERE property NOT LIKE '%:%' AND property NOT IN ('original_label','labelArray','labelVector','features','prop_original_label')
   GROUP BY 1),
eblock AS (SELECT type_id,
   string_agg(property || ' ' || {_pg('type')}, ', ' ORDER BY NOT mand, property) AS loose,
   string_agg(CASE WHEN mand THEN '' ELSE 'OPTIONAL ' END || property || ' ' || {_pg('type')}, ', ' ORDER BY NOT mand, property) AS strict
   FROM ett WHERE property NOT LIKE '%:%' AND property NOT IN ('original_label','labelArray','labelVector','features','prop_original_label')
   GROUP BY 1),
ntypes AS (SELECT s.type_id, s.type_id LIKE '?%' AS abst,
   CASE WHEN s.type_id LIKE '?%' THEN row_number() OVER (PARTITION BY s.type_id LIKE '?%' ORDER BY s.type_id) END AS abs_no,
   coalesce(' {{' || b.loose || '}}', '') AS lblock, coalesce(' {{' || b.strict || '}}', '') AS sblock
   FROM tsplit s LEFT JOIN nblock b USING (type_id)),
etypes AS (SELECT s.type_id, m.rel_types AS rel, m.src_labels, m.dst_labels, c.cardinality,
   coalesce(' {{' || b.loose || '}}', '') AS lblock, coalesce(' {{' || b.strict || '}}', '') AS sblock,
   CASE WHEN m.src_labels = '' THEN 'ABSTRACT_SRC' ELSE array_to_string(list_transform(string_split(m.src_labels, '|'), lambda x: x || 'Type'), '|') END AS src,
   CASE WHEN m.dst_labels = '' THEN 'ABSTRACT_DST' ELSE array_to_string(list_transform(string_split(m.dst_labels, '|'), lambda x: x || 'Type'), '|') END AS dst
   FROM esplit s JOIN emeta m USING (type_id) LEFT JOIN eblock b USING (type_id) LEFT JOIN ecard c USING (type_id)),
needs AS (SELECT coalesce(max(CASE WHEN src_labels = '' THEN 1 ELSE 0 END), 0) AS s,
                 coalesce(max(CASE WHEN dst_labels = '' THEN 1 ELSE 0 END), 0) AS d FROM etypes),
tnames AS (SELECT type_id, CASE WHEN abst THEN 'UNKNOWN_' || abs_no ELSE {SAFE.format('type_id')} END AS type_name FROM ntypes),
xnode AS (SELECT n.type_name, 'node' AS kind, 'property' AS role, t.property AS field, {_xsd('t.type')} AS xsd_type,
          CASE WHEN t.mand THEN 1 ELSE 0 END AS min_occurs
          FROM ntt t JOIN tnames n USING (type_id)
          WHERE t.property NOT LIKE '%:%' AND t.property NOT IN ('original_label', 'original_data')
            AND NOT contains(t.property, 'original_data')),
etn AS (SELECT *, {SAFE.format("split_part(rel, '|', 1)")} AS type_name FROM etypes),
xeprop AS (SELECT e.type_name, 'edge' AS kind, 'property' AS role, t.property AS field, min({_xsd('t.type')}) AS xsd_type,
           max(CASE WHEN t.mand THEN 1 ELSE 0 END) AS min_occurs
           FROM ett t JOIN etn e USING (type_id) WHERE t.property NOT LIKE '%:%' GROUP BY 1, 4),
xends AS (SELECT type_name, 'source' AS role, l FROM (SELECT type_name, unnest(string_split(src_labels, '|')) AS l FROM etn WHERE src_labels <> '')
          UNION ALL SELECT type_name, 'target' AS role, l FROM (SELECT type_name, unnest(string_split(dst_labels, '|')) AS l FROM etn WHERE dst_labels <> '')),
xend_names AS (SELECT DISTINCT type_name FROM etn),
xends2 AS (SELECT DISTINCT type_name, role, {SAFE.format('l')} AS xsd_type FROM xends
   UNION ALL
   SELECT type_name, r.role, CASE r.role WHEN 'source' THEN 'ABSTRACT_SRC' ELSE 'ABSTRACT_DST' END ||
          row_number() OVER (PARTITION BY r.role ORDER BY type_name)
   FROM xend_names, (VALUES ('source'), ('target')) r(role)
   WHERE NOT EXISTS (SELECT 1 FROM xends x WHERE x.type_name = xend_names.type_name AND x.role = r.role)),
sfields AS (SELECT * FROM xnode UNION ALL SELECT * FROM xeprop
            UNION ALL SELECT type_name, 'edge', role, role, xsd_type, 1 FROM xends2)
"""


def with_sinks(body: str) -> str:
    return "WITH " + ",\n".join([FIXTURE, PATTERN_CTES, TYPING_CTES, SINK_CTES]) + "\n" + body
