"""DuckDB oracle SQL per registered query (same keys and column names)."""

from __future__ import annotations

from graphsift.plans.oracle_sql import with_fixture

_NODE_TYPES_SELECT = """
SELECT s.type_id, CASE WHEN s.type_id LIKE '?%' THEN '' ELSE s.type_id END AS labels,
       s.type_id LIKE '?%' AS is_abstract, s.n, s.mandatory, s.optional
FROM tsplit s"""

_EDGE_TYPES_SELECT = """
SELECT s.type_id, m.rel_types, m.src_labels, m.dst_labels, s.n, s.mandatory, s.optional{extra}
FROM esplit s JOIN emeta m USING (type_id){join}"""

_LONG_SPLIT = """
SELECT type_id, unnest(string_split(mandatory, ',')) AS property, true AS mandatory FROM {t} WHERE mandatory <> ''
UNION ALL
SELECT type_id, unnest(string_split(optional, ',')) AS property, false AS mandatory FROM {t} WHERE optional <> ''"""

_PROPS_TEXT = "string_agg(key || '=' || value, ';' ORDER BY key || '=' || value)"


NODE_PROPS = ["acctbal", "brand", "lang", "mktsegment", "n_chars", "name", "orderdate", "orderpriority",
              "quality", "retailprice", "size", "source", "status", "text", "totalprice", "toxic", "type"]


def _presence_flags() -> str:
    cols = ", ".join(
        f"CAST(max(CASE WHEN p.key = '{k}' THEN 1 ELSE 0 END) AS DOUBLE) AS prop_{k}" for k in NODE_PROPS)
    return with_fixture(f"SELECT n.node_id, {cols} FROM gnodes n LEFT JOIN gprops p USING (node_id) "
                        "GROUP BY n.node_id")


ORACLES: dict[str, str] = {
    "node_scan": with_fixture(
        f"SELECT n.node_id, n.labels_key, count(p.key) AS n_props, coalesce({_PROPS_TEXT}, '') AS props_text "
        "FROM gnodes n LEFT JOIN gprops p USING (node_id) GROUP BY n.node_id, n.labels_key"),
    "edge_scan": with_fixture(
        f"SELECT e.edge_id, e.rel_type, e.src_id, e.dst_id, e.src_key, e.dst_key, "
        f"coalesce({_PROPS_TEXT}, '') AS props_text "
        "FROM gedges e LEFT JOIN geprops p USING (edge_id) "
        "GROUP BY e.edge_id, e.rel_type, e.src_id, e.dst_id, e.src_key, e.dst_key"),
    "node_patterns": with_fixture("SELECT labels_key, props_key, n FROM npatterns", patterns=True),
    "edge_patterns": with_fixture(
        "SELECT rel_type, src_key, dst_key, props_key, count(*) AS n FROM epat GROUP BY 1, 2, 3, 4",
        patterns=True),
    "property_names": with_fixture(
        "SELECT DISTINCT key AS property, 'node' AS kind FROM gprops "
        "UNION ALL SELECT DISTINCT key AS property, 'edge' AS kind FROM geprops"),
    "presence_flags": _presence_flags(),
    "label_set_count": with_fixture("SELECT count(DISTINCT labels_key) AS label_sets FROM gnodes"),
    "node_types": with_fixture(_NODE_TYPES_SELECT, patterns=True),
    "abstract_types": with_fixture(_NODE_TYPES_SELECT + " WHERE s.type_id LIKE '?%'", patterns=True),
    "unlabelled_attach": with_fixture(
        "SELECT '#' || j.props_key AS cluster_id, j.type_id, round(j.jaccard, 6) AS jaccard, u.n "
        "FROM jac2 j JOIN upat u USING (props_key) WHERE j.jaccard >= 0.9 - 1e-9", patterns=True),
    "mandatory_optional_nodes": with_fixture(_LONG_SPLIT.format(t="tsplit"), patterns=True),
    "mandatory_optional_edges": with_fixture(_LONG_SPLIT.format(t="esplit"), patterns=True),
    "edge_types_by_rel": with_fixture(
        _EDGE_TYPES_SELECT.format(extra=", c.cardinality", join=" JOIN ecard c USING (type_id)"),
        patterns=True),
    "edge_types_by_endpoints": with_fixture("""
        , et2 AS (SELECT *, CASE WHEN src_key <> '' OR dst_key <> '' THEN concat_ws('>', rel_type, src_key, dst_key)
                            ELSE '?' || concat_ws('#', rel_type, src_key, dst_key, props_key) END AS t2 FROM epat),
        sz AS (SELECT t2, count(*) AS n FROM et2 GROUP BY 1),
        pp AS (SELECT t.t2, p.key, count(*) AS cnt FROM et2 t JOIN geprops p USING (edge_id) GROUP BY 1, 2),
        meta AS (SELECT t2, min(rel_type) AS rel_types,
                 min(CASE WHEN src_key <> '' THEN src_key ELSE '' END) AS src_labels,
                 min(CASE WHEN dst_key <> '' THEN dst_key ELSE '' END) AS dst_labels FROM et2 GROUP BY 1)
        SELECT s.t2 AS type_id, m.rel_types, m.src_labels, m.dst_labels, s.n,
          coalesce(string_agg(CASE WHEN p.cnt = s.n THEN p.key END, ',' ORDER BY p.key), '') AS mandatory,
          coalesce(string_agg(CASE WHEN p.cnt < s.n THEN p.key END, ',' ORDER BY p.key), '') AS optional
        FROM sz s JOIN meta m USING (t2) LEFT JOIN pp p USING (t2)
        GROUP BY s.t2, m.rel_types, m.src_labels, m.dst_labels, s.n""", patterns=True),
    "property_types_nodes": with_fixture("SELECT * FROM nptypes", typing=True),
    "property_types_edges": with_fixture("SELECT * FROM eptypes", typing=True),
    "typed_schema": with_fixture("""
        , nl AS (""" + _LONG_SPLIT.format(t="tsplit") + """),
        el AS (""" + _LONG_SPLIT.format(t="esplit") + """)
        SELECT 'node' AS kind, nl.type_id, nl.property, coalesce(t.type, 'Unknown') AS type, nl.mandatory
        FROM nl LEFT JOIN nptypes t USING (property)
        UNION ALL
        SELECT 'edge' AS kind, el.type_id, el.property, coalesce(t.type, 'Unknown') AS type, el.mandatory
        FROM el LEFT JOIN eptypes t USING (property)""", patterns=True, typing=True),
    "degree_stats": with_fixture(
        "SELECT rel_type, max_dst_per_src, min_dst_per_src, round(avg_dst_per_src, 6) AS avg_dst_per_src, "
        "max_src_per_dst, min_src_per_dst, round(avg_src_per_dst, 6) AS avg_src_per_dst FROM card",
        patterns=True),
    "cardinality": with_fixture("SELECT rel_type, cardinality FROM card", patterns=True),
    "node_schema": with_fixture("""
        , nl AS (""" + _LONG_SPLIT.format(t="tsplit") + """)
        SELECT nl.type_id, nl.type_id LIKE '?%' AS is_abstract, nl.property,
               coalesce(t.type, 'Unknown') AS type, nl.mandatory
        FROM nl LEFT JOIN nptypes t USING (property)""", patterns=True, typing=True),
}

# ------------------------------------------------------------------ sinks / RDF / evaluation
from graphsift.plans.oracle_sql import FIXTURE, STRICT_CTES, with_sinks  # noqa: E402

_BASE = "https://example.org/"
_TYPE_IRI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_LABEL_IRI = "http://www.w3.org/2000/01/rdf-schema#label"
_SEG = ("CASE WHEN {lk} = '' THEN 'Node' ELSE url_encode({lk}) END")

ORACLES["ddl_loose"] = with_sinks(f"""
SELECT 0 AS section, 'CREATE GRAPH TYPE NewGraphSchema LOOSE {{' AS line
UNION ALL SELECT 9, '}}'
UNION ALL SELECT 1, '  (' || CASE WHEN abst THEN 'AbstractType' ELSE type_id || 'Type' END || ': ' ||
                 CASE WHEN abst THEN 'Abstract' ELSE type_id END || lblock || '),' FROM ntypes
UNION ALL SELECT 2, '  (ABSTRACT_SRC: OPEN),' FROM needs WHERE s = 1
UNION ALL SELECT 2, '  (ABSTRACT_DST: OPEN),' FROM needs WHERE d = 1
UNION ALL SELECT 3, '  (:' || src || ')-[' || replace(rel, '|', '_') || 'Type: ' || replace(rel, '|', ' | ')
                 || lblock || ']->(:' || dst || '),' FROM etypes""")

_SNAME = "CASE WHEN abst THEN 'AbstractType_' || abs_no ELSE type_id || 'Type' END"
_RNAME = "lower(replace(rel, '|', '_')) || 'Type'"
ORACLES["ddl_strict"] = with_sinks(f"""
SELECT * FROM (VALUES (0, '-- NODE TYPES --'), (3, ''), (4, '-- EDGE TYPES --'), (6, ''),
                      (6, 'CREATE GRAPH TYPE NewGraphSchema STRICT {{'), (11, '}}')) v(section, line)
UNION ALL SELECT 1, 'CREATE NODE TYPE ' || {_SNAME} || ' : ' ||
                 CASE WHEN abst THEN 'ABSTRACT_' || abs_no ELSE type_id END || sblock || ';' FROM ntypes
UNION ALL SELECT 2, 'CREATE NODE TYPE ABSTRACT_SRC : OPEN;' FROM needs WHERE s = 1
UNION ALL SELECT 2, 'CREATE NODE TYPE ABSTRACT_DST : OPEN;' FROM needs WHERE d = 1
UNION ALL SELECT 5, 'CREATE EDGE TYPE ' || {_RNAME} || ' : ' || replace(rel, '|', ' | ') || sblock || ';' FROM etypes
UNION ALL SELECT 7, '  (' || {_SNAME} || '),' FROM ntypes
UNION ALL SELECT 8, '  (ABSTRACT_SRC),' FROM needs WHERE s = 1
UNION ALL SELECT 8, '  (ABSTRACT_DST),' FROM needs WHERE d = 1
UNION ALL SELECT 9, '  (:' || src || ')-[' || {_RNAME} || ']->(:' || dst || '),' FROM etypes
UNION ALL SELECT 10, CASE cardinality
    WHEN '1:1' THEN '  FOR (x:' || src || ') SINGLETON x,y WITHIN (x)-[y: ' || {_RNAME} || ']->(:' || dst || ')'
    WHEN 'N:1' THEN '  FOR (x:' || src || ') SINGLETON y WITHIN (x)-[y: ' || {_RNAME} || ']->(:' || dst || ')'
    WHEN '1:N' THEN '  FOR (x:' || dst || ') SINGLETON x WITHIN (:' || src || ')-[y: ' || {_RNAME} || ']->(x)' END
  FROM etypes WHERE cardinality IN ('1:1', 'N:1', '1:N')""")

ORACLES["schema_fields"] = with_sinks("SELECT * FROM sfields")


def _rules_sql(shape: str) -> str:
    ns = _BASE + ("custom/" if shape == "link" else "")
    rt = _TYPE_IRI
    parts = [
        f"SELECT DISTINCT type_name, kind, 'subject' AS rule, NULL::VARCHAR AS predicate, '{ns}' || type_name || '/{{id}}' AS template, NULL::VARCHAR AS field FROM sfields",
        f"SELECT DISTINCT type_name, kind, 'class', '{rt}', CASE WHEN kind = 'edge' AND {str(shape == 'link').upper()} THEN '{ns}intermediate' ELSE '{ns}' || type_name END, NULL FROM sfields",
        f"SELECT type_name, kind, 'literal', CASE WHEN kind = 'node' THEN '{ns}has_' || field ELSE '{ns}' || type_name || '_' || field END, '{{value}}', field FROM sfields WHERE role = 'property'",
    ]
    ends = "(SELECT type_name, role, min(xsd_type) AS end_type FROM sfields WHERE role <> 'property' GROUP BY 1, 2)"
    if shape == "link":
        parts.append(f"SELECT DISTINCT type_name, kind, 'label', '{_LABEL_IRI}', '{{id}}', NULL FROM sfields WHERE kind = 'node'")
        parts.append(f"SELECT type_name, 'edge', 'link', '{ns}' || type_name, '{ns}' || end_type || '/{{src}}', NULL FROM {ends} WHERE role = 'source'")
        parts.append(f"SELECT type_name, 'edge', 'has_target', '{ns}hasTarget', '{ns}' || end_type || '/{{dst}}', NULL FROM {ends} WHERE role = 'target'")
    else:
        parts.append(f"SELECT type_name, 'edge', role, '{ns}' || role, '{ns}' || end_type || CASE WHEN role = 'source' THEN '/{{src}}' ELSE '/{{dst}}' END, NULL FROM {ends}")
    return with_sinks(" UNION ALL ".join(parts))


ORACLES["mapping_rules_reified"] = _rules_sql("reified")
ORACLES["mapping_rules_link"] = _rules_sql("link")


def _esc(v: str) -> str:
    return (f"replace(replace(replace(replace({v}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
            f"chr(13), '\\r')")


def _node_quads_sql(shape: str) -> str:
    ns = _BASE + ("custom/" if shape == "link" else "")
    g = f"'{_BASE}custom'" if shape == "link" else "NULL::VARCHAR"
    subj = f"'{ns}' || {_SEG.format(lk='q.labels_key')} || '/' || CAST(q.node_id AS VARCHAR)"
    parts = [
        f"SELECT {g} AS graph, {subj} AS subject, '{_TYPE_IRI}' AS predicate, '{ns}' || n.type_name AS object, "
        "'iri' AS object_kind, NULL::VARCHAR AS datatype FROM node_type q JOIN tnames n USING (type_id)",
        f"SELECT {g}, {subj}, '{ns}has_' || p.key, p.value, 'literal', NULL FROM node_type q JOIN gprops p USING (node_id) "
        "WHERE trim(p.value) <> ''",
    ]
    if shape == "link":
        parts.append(f"SELECT {g}, {subj}, '{_LABEL_IRI}', CAST(q.node_id AS VARCHAR), 'literal', NULL FROM node_type q")
    return " UNION ALL ".join(parts)


def _edge_quads_sql(shape: str) -> str:
    ns = _BASE + ("custom/" if shape == "link" else "")
    g = f"'{_BASE}custom'" if shape == "link" else "NULL::VARCHAR"
    rel = "regexp_replace(e.rel_type, '[^A-Za-z0-9_.\\-]', '_', 'g')"
    eiri = f"'{ns}' || {rel} || '/' || url_encode(e.edge_id)"
    src = f"'{ns}' || {_SEG.format(lk='e.src_key')} || '/' || CAST(e.src_id AS VARCHAR)"
    dst = f"'{ns}' || {_SEG.format(lk='e.dst_key')} || '/' || CAST(e.dst_id AS VARCHAR)"
    head = "SELECT {g} AS graph, {s} AS subject, {p} AS predicate, {o} AS object, '{k}' AS object_kind, NULL::VARCHAR AS datatype FROM gedges e"
    if shape == "link":
        parts = [head.format(g=g, s=src, p=f"'{ns}' || {rel}", o=eiri, k="iri"),
                 head.format(g=g, s=eiri, p=f"'{_TYPE_IRI}'", o=f"'{ns}intermediate'", k="iri"),
                 head.format(g=g, s=eiri, p=f"'{ns}hasTarget'", o=dst, k="iri")]
    else:
        parts = [head.format(g=g, s=eiri, p=f"'{_TYPE_IRI}'", o=f"'{ns}' || {rel}", k="iri"),
                 head.format(g=g, s=eiri, p=f"'{ns}source'", o=src, k="iri"),
                 head.format(g=g, s=eiri, p=f"'{ns}target'", o=dst, k="iri")]
    parts.append(f"SELECT {g}, {eiri}, '{ns}' || {rel} || '_' || p.key, p.value, 'literal', NULL "
                 "FROM gedges e JOIN geprops p USING (edge_id) WHERE trim(p.value) <> ''")
    return " UNION ALL ".join(parts)


ORACLES["node_quads_reified"] = with_sinks(_node_quads_sql("reified"))
ORACLES["node_quads_link"] = with_sinks(_node_quads_sql("link"))
ORACLES["edge_quads_reified"] = with_fixture(_edge_quads_sql("reified"))
ORACLES["edge_quads_link"] = with_fixture(_edge_quads_sql("link"))
ORACLES["nquads_lines"] = with_sinks(f"""
SELECT '<' || subject || '> <' || predicate || '> ' ||
       CASE WHEN object_kind = 'iri' THEN '<' || object || '>' ELSE '"' || {_esc('object')} || '"' END ||
       CASE WHEN graph IS NOT NULL THEN ' <' || graph || '>' ELSE '' END || ' .' AS line
FROM ({_node_quads_sql('link')} UNION ALL {_edge_quads_sql('link')}) q""")

_IRI = f"'{_BASE}' || {_SEG.format(lk='labels_key')} || '/' || CAST(node_id AS VARCHAR)"
for _shape in ("link", "reified"):
    ORACLES[f"rule_quads_{_shape}"] = with_sinks(f"{_node_quads_sql(_shape)} UNION ALL {_edge_quads_sql(_shape)}")
    ORACLES[f"trig_written_{_shape}"] = ORACLES[f"rule_quads_{_shape}"]
ORACLES["rules_vs_quads"] = with_sinks(" UNION ALL ".join(
    f"SELECT '{x}' AS shape, count(*)::BIGINT AS quads, 0::BIGINT AS mismatches FROM ({_node_quads_sql(x)} UNION ALL {_edge_quads_sql(x)}) q"
    for x in ("link", "reified")))


def _executable_sql(shape: str) -> str:
    """The rules written out from types, fields and the label sets at both ends."""
    ns = "https://example.org/custom/" if shape == "link" else "https://example.org/"
    rdf_type = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    node, edge = f"'{ns}{{type}}/{{id}}'", f"'{ns}{{rel}}/{{id}}'"
    rels = "(SELECT DISTINCT rel_type FROM gedges)"
    name = "regexp_replace(rel_type, '[^A-Za-z0-9_.\\-]', '_', 'g')"

    def end(key, hole):
        return f"'{ns}' || {_SEG.format(lk=key)} || '/{{{hole}}}'"

    rows = [
        f"SELECT 'node' AS kind, type_id AS key, 'class' AS rule, '@' AS slot, {node} AS subject, '{rdf_type}' AS predicate, "
        f"'{ns}' || type_name AS object, 'iri' AS object_kind FROM tnames",
        f"SELECT 'node', n.type_id, 'literal', f.field, {node}, '{ns}has_' || f.field, '{{value}}', 'literal' "
        "FROM sfields f JOIN tnames n ON n.type_name = f.type_name AND f.kind = 'node'",
        f"SELECT 'edge', rel_type, 'class', '@', {edge}, '{rdf_type}', "
        + (f"'{ns}intermediate'" if shape == "link" else f"'{ns}' || {name}") + f", 'iri' FROM {rels}",
        f"SELECT 'edge', r.rel_type, 'literal', f.field, {edge}, '{ns}' || f.type_name || '_' || f.field, '{{value}}', 'literal' "
        f"FROM sfields f JOIN {rels} r ON {name.replace('rel_type', 'r.rel_type')} = f.type_name AND f.kind = 'edge' "
        "WHERE f.role = 'property'",
    ]
    sources, targets = ("(SELECT DISTINCT rel_type, " + c + " AS k FROM gedges)" for c in ("src_key", "dst_key"))
    if shape == "link":
        rows += [f"SELECT 'node', type_id, 'label', '@', {node}, 'http://www.w3.org/2000/01/rdf-schema#label', '{{id}}', 'literal' FROM tnames",
                 f"SELECT 'edge', rel_type, 'link', '@s' || k, {end('k', 'src')}, '{ns}' || {name}, {edge}, 'iri' FROM {sources}",
                 f"SELECT 'edge', rel_type, 'has_target', '@t' || k, {edge}, '{ns}hasTarget', {end('k', 'dst')}, 'iri' FROM {targets}"]
    else:
        rows += [f"SELECT 'edge', rel_type, 'source', '@s' || k, {edge}, '{ns}source', {end('k', 'src')}, 'iri' FROM {sources}",
                 f"SELECT 'edge', rel_type, 'target', '@t' || k, {edge}, '{ns}target', {end('k', 'dst')}, 'iri' FROM {targets}"]
    return f"SELECT '{shape}' AS shape, r.* FROM ({' UNION ALL '.join(rows)}) r"


ORACLES["executable_rules"] = with_sinks(f"{_executable_sql('link')} UNION ALL {_executable_sql('reified')}")
ORACLES["rule_classes"] = with_sinks(f"""
SELECT 'https://example.org/' || {_SEG.format(lk='q.labels_key')} || '/' || CAST(q.node_id AS VARCHAR) AS subject,
       'https://example.org/' || unnest(CASE WHEN q.type_id LIKE '?%' THEN [n.type_name] ELSE string_split(q.type_id, ':') END) AS object
FROM node_type q JOIN tnames n USING (type_id)""")
ORACLES["rule_quads_hashed"] = with_sinks(f"""
SELECT 'https://example.org/custom/' || sha256(subject) AS subject, predicate,
       CASE WHEN object_kind = 'iri' AND predicate <> 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type'
            THEN 'https://example.org/custom/' || sha256(object) ELSE object END AS object, object_kind
FROM ({_node_quads_sql('link')} UNION ALL {_edge_quads_sql('link')}) q""")
_PLAIN = f"{_SEG.format(lk='n.labels_key')} || '/' || CAST(n.node_id AS VARCHAR)"
_TEXT = (f"coalesce(CASE WHEN n.node_id % 2 = 0 THEN 'https://example.org/' || {_PLAIN} ELSE p.value END, '')")
ORACLES["iri_policies"] = with_fixture(f"""
SELECT node_id, 'https://example.org/custom/' || plain AS "URIwithType",
       'https://example.org/custom/' || sha256('https://example.org/custom/' || plain) AS "URIwithTypeHashed",
       'https://example.org/custom/' || plain || '/graph' AS namedgraph, CAST(node_id AS VARCHAR) AS "Label",
       CASE WHEN regexp_matches(text, '^[A-Za-z][A-Za-z0-9+.-]*:[^[:space:]<>"{{}}|\\^`]+$') THEN text
            ELSE 'urn:uuid:' || md5(text)[1:8] || '-' || md5(text)[9:12] || '-' || md5(text)[13:16] || '-' ||
                 md5(text)[17:20] || '-' || md5(text)[21:32] END AS "URIorUUID"
FROM (SELECT n.node_id, {_PLAIN} AS plain, {_TEXT} AS text
      FROM gnodes n LEFT JOIN gprops p ON p.node_id = n.node_id AND p.key = 'name') q""")
ORACLES["iri_modes"] = with_fixture(f"""
SELECT node_id, {_IRI} AS iri,
       '{_BASE}custom/' || {_SEG.format(lk='labels_key')} || '/' || CAST(node_id AS VARCHAR) AS iri_custom,
       '{_BASE}custom/' || sha256({_IRI}) AS iri_hashed, {_IRI} || '/graph' AS graph_iri FROM gnodes""")

_TRUTH = ("(['Region','Nation','Customer','Supplier','Part','Order','Document','Grade'])"
          "[CAST({} % 16 AS INTEGER)]")
_ASSIGN = f"""
, assign AS (SELECT q.node_id, q.type_id,
     CASE WHEN q.type_id LIKE '?%' THEN [''] ELSE list_distinct(string_split(q.type_id, ':')) END AS pred,
     [{_TRUTH.format('q.node_id')}] AS actual FROM node_type q),
  freq AS (SELECT type_id, unnest(actual) AS label, count(*) AS freq FROM assign GROUP BY 1, 2),
  maj AS (SELECT type_id, label AS majority_label, freq FROM (
          SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY freq DESC, label) AS r FROM freq) WHERE r = 1),
  scored AS (SELECT a.*, CASE WHEN list_contains(a.actual, m.majority_label) THEN 1 ELSE 0 END AS ok
             FROM assign a JOIN maj m USING (type_id)),
  pt AS (SELECT array_to_string(list_sort(actual), ',') AS tk, count(*) AS total, sum(ok) AS correct FROM scored GROUP BY 1),
  m AS (SELECT sum(correct) AS tp, sum(total) - sum(correct) AS fp, sum(greatest(total - correct, 0)) AS fn,
               count(*) AS true_sets FROM pt)
"""
_METRICS = """
SELECT m.tp, m.fp, m.fn, m.true_sets, (SELECT count(DISTINCT type_id) FROM {a}) AS predicted_types,
  round(CASE WHEN m.tp + m.fp > 0 THEN m.tp / (m.tp + m.fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN m.tp + m.fn > 0 THEN m.tp / (m.tp + m.fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN m.tp > 0 THEN 2.0 * (m.tp / (m.tp + m.fp)) * (m.tp / (m.tp + m.fn)) /
        ((m.tp / (m.tp + m.fp)) + (m.tp / (m.tp + m.fn))) ELSE 0 END, 6) AS f1,
  (SELECT sum(ns) FROM {a}) AS non_strict_correct, (SELECT sum(st) FROM {a}) AS strict_correct
FROM m"""

ORACLES["assignments_nodes"] = with_sinks(_ASSIGN + """
SELECT node_id, type_id, array_to_string(list_sort(pred), ',') AS predicted_labels,
       array_to_string(list_sort(actual), ',') AS actual_labels,
       CASE WHEN len(list_intersect(actual, pred)) > 0 THEN 1 ELSE 0 END AS correct_non_strict,
       CASE WHEN list_sort(actual) = list_sort(pred) THEN 1 ELSE 0 END AS correct_strict FROM assign""")
ORACLES["majority_labels"] = with_sinks(_ASSIGN + "SELECT * FROM maj")
ORACLES["eval_nodes"] = with_sinks(_ASSIGN + """
, flags AS (SELECT CASE WHEN len(list_intersect(actual, pred)) > 0 THEN 1 ELSE 0 END AS ns,
                   CASE WHEN list_sort(actual) = list_sort(pred) THEN 1 ELSE 0 END AS st, type_id FROM assign)
""" + _METRICS.format(a="flags"))

ORACLES["eval_edges"] = with_sinks(f"""
, ea AS (SELECT t.edge_id, t.type_id, [t.rel_type] AS true_rel, [{_TRUTH.format('t.src_id')}] AS true_src,
                [{_TRUTH.format('t.dst_id')}] AS true_dst, string_split(m.rel_types, '|') AS p_rel,
                CASE WHEN m.src_labels = '' THEN []::VARCHAR[] ELSE string_split(m.src_labels, '|') END AS p_src,
                CASE WHEN m.dst_labels = '' THEN []::VARCHAR[] ELSE string_split(m.dst_labels, '|') END AS p_dst
         FROM edge_type t JOIN emeta m USING (type_id)),
  flags AS (SELECT type_id,
    CASE WHEN len(list_filter(true_rel, lambda x: NOT list_contains(p_rel, x))) = 0
          AND len(list_filter(true_src, lambda x: NOT list_contains(p_src, x))) = 0
          AND len(list_filter(true_dst, lambda x: NOT list_contains(p_dst, x))) = 0 THEN 1 ELSE 0 END AS ns,
    CASE WHEN list_sort(true_rel) = list_sort(p_rel) AND list_sort(true_src) = list_sort(p_src)
          AND list_sort(true_dst) = list_sort(p_dst) THEN 1 ELSE 0 END AS st FROM ea),
  freq AS (SELECT type_id, unnest(true_rel) AS label, count(*) AS freq FROM ea GROUP BY 1, 2),
  maj AS (SELECT type_id, label AS majority_label FROM (
          SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY freq DESC, label) AS r FROM freq) WHERE r = 1),
  scored AS (SELECT a.*, CASE WHEN list_contains(a.true_rel, m.majority_label) THEN 1 ELSE 0 END AS ok
             FROM ea a JOIN maj m USING (type_id)),
  pt AS (SELECT concat_ws('>', array_to_string(true_rel, ','), array_to_string(true_src, ','),
                          array_to_string(true_dst, ',')) AS tk, count(*) AS total, sum(ok) AS correct FROM scored GROUP BY 1),
  m AS (SELECT sum(correct) AS tp, sum(total) - sum(correct) AS fp, sum(greatest(total - correct, 0)) AS fn,
               count(*) AS true_sets FROM pt)
""" + _METRICS.format(a="flags"))

# ------------------------------------------------------------------ more merging
_CL = "SELECT labels_key || '#' || props_key AS cid, labels_key, props_key, n FROM npatterns"
ORACLES["jaccard_pairs"] = with_fixture(f""", cl AS ({_CL})
SELECT a, b, CAST(1.0 AS DOUBLE) AS jaccard FROM (
  SELECT min(cid) OVER (PARTITION BY labels_key) AS a, cid AS b FROM cl WHERE labels_key <> '') WHERE a <> b""", patterns=True)
# partial overlaps: property sets, by brute force over all pairs of distinct sets
ORACLES["jaccard_pairs_props"] = with_fixture(f""", cl AS ({_CL}),
  st AS (SELECT min(cid) AS rep, props_key, string_split(props_key, ',') AS ks FROM cl WHERE props_key <> '' GROUP BY props_key)
SELECT a.rep AS a, c.cid AS b, CAST(1.0 AS DOUBLE) AS jaccard FROM st a JOIN cl c USING (props_key) WHERE c.cid <> a.rep
UNION ALL
SELECT a.rep, b.rep, round(len(list_intersect(a.ks, b.ks)) * 1.0 / len(list_distinct(list_concat(a.ks, b.ks))), 6)
FROM st a JOIN st b ON a.rep < b.rep
WHERE len(list_intersect(a.ks, b.ks)) * 1.0 / len(list_distinct(list_concat(a.ks, b.ks))) >= 0.3 - 1e-9""", patterns=True)
_JM = f""", cl AS ({_CL}),
  grp AS (SELECT *, CASE WHEN labels_key = '' THEN cid ELSE min(cid) OVER (PARTITION BY labels_key) END AS gid FROM cl),
  gk AS (SELECT DISTINCT g.gid, p.key FROM grp g JOIN npat q ON q.labels_key = g.labels_key AND q.props_key = g.props_key
         JOIN gprops p USING (node_id))
SELECT g.gid AS group_id, count(*) AS n_clusters, min(g.labels_key) AS labels,
       (SELECT string_agg(key, ',' ORDER BY key) FROM gk WHERE gk.gid = g.gid) AS props, sum(g.n) AS n
FROM grp g GROUP BY g.gid"""
ORACLES["jaccard_merge"] = with_fixture(_JM, patterns=True)
# here every label set is similar to itself alone, so a group is named by its own smallest cluster
ORACLES["jaccard_merge_one_hop"] = with_fixture(_JM, patterns=True)
ORACLES["schema_merge_nodes"] = with_fixture(
    "SELECT type_id, labels, n, mandatory, optional FROM (" + _NODE_TYPES_SELECT + ")", patterns=True)
ORACLES["schema_merge_edges"] = with_fixture(
    _EDGE_TYPES_SELECT.format(extra="", join=""), patterns=True)
ORACLES["label_profile"] = with_fixture("""
, lp AS (SELECT unnest(string_split(labels_key, ':')) AS label, props_key, n FROM npatterns WHERE labels_key <> ''),
  lt AS (SELECT label, sum(n) AS n FROM lp GROUP BY 1),
  lk AS (SELECT label, unnest(string_split(props_key, ',')) AS key, n FROM lp WHERE props_key <> ''),
  lc AS (SELECT label, key, sum(n) AS cnt FROM lk GROUP BY 1, 2)
SELECT t.label, t.n,
  coalesce(string_agg(CASE WHEN c.cnt = t.n THEN c.key END, ',' ORDER BY c.key), '') AS common,
  coalesce(string_agg(CASE WHEN c.cnt < t.n THEN c.key END, ',' ORDER BY c.key), '') AS optional,
  coalesce(string_agg(c.key, ',' ORDER BY c.key), '') AS all_props
FROM lt t LEFT JOIN lc c USING (label) GROUP BY t.label, t.n""", patterns=True)
ORACLES["edge_profile"] = with_fixture("""
, et AS (SELECT rel_type, src_key, dst_key, count(*) AS n FROM epat GROUP BY 1, 2, 3),
  ek AS (SELECT e.rel_type, e.src_key, e.dst_key, p.key, count(*) AS cnt FROM epat e JOIN geprops p USING (edge_id) GROUP BY 1, 2, 3, 4)
SELECT t.rel_type AS rel_types, t.src_key AS src_labels, t.dst_key AS dst_labels, t.n,
  coalesce(string_agg(CASE WHEN k.cnt = t.n THEN k.key END, ',' ORDER BY k.key), '') AS common,
  coalesce(string_agg(CASE WHEN k.cnt < t.n THEN k.key END, ',' ORDER BY k.key), '') AS optional,
  coalesce(string_agg(k.key, ',' ORDER BY k.key), '') AS all_props
FROM et t LEFT JOIN ek k USING (rel_type, src_key, dst_key) GROUP BY 1, 2, 3, 4""", patterns=True)
ORACLES["flatten_props"] = with_fixture(
    "SELECT labels_key || '#' || props_key AS cluster_id, props_key AS props FROM npatterns", patterns=True)
ORACLES["node_types_cluster_granularity"] = ORACLES["node_types"]

# ------------------------------------------------------------------ I/O round trips
ORACLES["csv_round_trip"] = ORACLES["node_scan"]
ORACLES["csv_round_trip_edges"] = ORACLES["edge_scan"]
ORACLES["align_union"] = """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL::VARCHAR, s_acctbal FROM supplier"""
ORACLES["node_elements"] = with_sinks("""
SELECT n.type_name, CAST(q.node_id AS VARCHAR) AS id, n.type_name AS original_label,
  coalesce((SELECT string_agg(p.key || '=' || p.value, ';' ORDER BY p.key || '=' || p.value) FROM gprops p
            WHERE p.node_id = q.node_id AND trim(p.value) <> ''), '') AS props_text
FROM node_type q JOIN tnames n USING (type_id)""")
ORACLES["edge_elements"] = with_fixture("""
SELECT e.rel_type AS type_name, e.edge_id AS id, e.src_key AS src_type, CAST(e.src_id AS VARCHAR) AS src,
  e.dst_key AS dst_type, CAST(e.dst_id AS VARCHAR) AS dst,
  coalesce((SELECT string_agg(p.key || '=' || p.value, ';' ORDER BY p.key || '=' || p.value) FROM geprops p
            WHERE p.edge_id = e.edge_id AND trim(p.value) <> ''), '') AS props_text
FROM gedges e""")
# reference attachment rule: every matching type, not only the best
ORACLES["node_types_multi"] = with_fixture(_NODE_TYPES_SELECT, patterns=True).replace(
    "jaccard >= 0.9 - 1e-9) WHERE r = 1)", "jaccard >= 0.9 - 1e-9) WHERE r >= 1)")
assert ORACLES["node_types_multi"] != ORACLES["node_types"]

# ------------------------------------------------------------------ XSD text
_NL = "chr(10)"
ORACLES["schema_xsd"] = with_sinks(f"""
, kinds AS (SELECT DISTINCT type_name, kind FROM sfields)
SELECT 0 AS section, '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" name="NewGraphSchema">' AS line
UNION ALL SELECT 2, '</xs:schema>'
UNION ALL SELECT 1, '  <xs:complexType name="' || type_name || '">' || {_NL} ||
  '    <xs:annotation><xs:appinfo><type>' || kind || '</type></xs:appinfo></xs:annotation>' || {_NL} ||
  '    <xs:sequence>' FROM kinds
UNION ALL SELECT 1, '    </xs:sequence>' || {_NL} || '    <xs:attribute name="id" type="xs:ID" use="required"/>' ||
  {_NL} || '    <xs:attribute name="label" type="xs:string"/>' || {_NL} || '  </xs:complexType>' FROM kinds
UNION ALL SELECT 1, '      <xs:choice minOccurs="1" maxOccurs="1">' FROM kinds, (VALUES (1), (2)) v(i) WHERE kind = 'edge'
UNION ALL SELECT 1, '      </xs:choice>' FROM kinds, (VALUES (1), (2)) v(i) WHERE kind = 'edge'
UNION ALL SELECT 1, CASE WHEN role = 'property'
    THEN '      <xs:element name="' || field || '" type="' || xsd_type || '" minOccurs="' || CAST(min_occurs AS VARCHAR) || '" maxOccurs="1"/>'
    ELSE '        <xs:element name="' || role || '" type="' || xsd_type || '"/>' END FROM sfields""")

# ------------------------------------------------------------------ encoding (deterministic part)
ORACLES["encoded_patterns"] = with_fixture("""
, vocab AS (SELECT DISTINCT key FROM gprops),
  pk AS (SELECT labels_key, props_key, n, string_split(props_key, ',') AS ks FROM npatterns)
SELECT labels_key, props_key, n, CAST(5 + (SELECT count(*) FROM vocab) AS INTEGER) AS dim,
  (SELECT string_agg(CASE WHEN list_contains(pk.ks, v.key) THEN '1.0' ELSE '0.0' END, ',' ORDER BY v.key)
   FROM vocab v) AS flags
FROM pk""", patterns=True)

# ------------------------------------------------------------------ LSH statistics
def _code(text: str, dim: int) -> str:
    """List of label code values: first 32 bits of an MD5, scaled to [-0.1, 0.1)."""
    return "[" + ", ".join(
        f"CAST(('0x' || substr(md5('42:{i}:' || {text}), 1, 8)) AS UBIGINT) / 4294967296.0::DOUBLE * 0.2 - 0.1"
        for i in range(dim)) + "]"


_FLAGS = ("(SELECT list(CASE WHEN list_contains(string_split(props_key, ','), v.key) THEN 1.0::DOUBLE "
          "ELSE 0.0::DOUBLE END ORDER BY v.key) FROM {v} v)")
_ENCODED = f""", nvocab AS (SELECT DISTINCT key FROM gprops), evocab AS (SELECT DISTINCT key FROM geprops),
  epatterns AS (SELECT rel_type, src_key, dst_key, props_key, count(*) AS n FROM epat GROUP BY 1, 2, 3, 4),
  enc AS (SELECT 'node' AS kind, labels_key || '#' || props_key AS p, n, labels_key AS lk,
                 list_concat({_code('labels_key', 5)}, {_FLAGS.format(v='nvocab')}) AS v FROM npatterns
          UNION ALL
          SELECT 'edge', concat_ws('#', rel_type, src_key, dst_key, props_key), n, NULL,
                 list_concat({_code('rel_type', 10)}, {_code('src_key', 4)}, {_code('dst_key', 4)},
                             {_FLAGS.format(v='evocab')}) FROM epatterns),
  pairs AS (SELECT a.kind, a.v, b.v AS v2, CAST(a.n AS DOUBLE) AS n, CAST(b.n AS DOUBLE) AS n2
            FROM enc a JOIN enc b ON a.kind = b.kind AND a.p <> b.p),
  dist AS (SELECT kind, list_distance(v, v2) AS d, n * n2 AS w FROM pairs WHERE v <> v2),
  stats AS (SELECT kind, sum(w * d) / sum(w) AS a, min(d) AS lo, max(d) AS hi, count(*) AS pairs FROM dist GROUP BY kind)
"""
ORACLES["pattern_distance_stats"] = with_fixture(_ENCODED + """
SELECT kind, round(a, 6) AS avg_distance, round(lo, 6) AS min_distance, round(hi, 6) AS max_distance, pairs
FROM stats""", patterns=True)
ORACLES["lsh_params"] = with_fixture(_ENCODED + """
, base AS (SELECT s.kind, s.a, (SELECT sum(n) FROM enc e WHERE e.kind = s.kind) AS rows,
                  CASE WHEN s.kind = 'node' THEN (SELECT count(DISTINCT lk) FROM enc) END AS ls FROM stats s)
SELECT kind, round(a, 6) AS avg_distance, CAST(rows AS BIGINT) AS rows, ls AS label_sets,
  round(CASE WHEN kind = 'edge' THEN a * 0.2
             ELSE a * 0.3 * CASE WHEN ls <= 3 THEN 0.5 WHEN ls <= 10 THEN 1.0 ELSE 1.5 END END, 6) AS bucket_length,
  CAST(CASE WHEN kind = 'edge' THEN least(8, greatest(3, rows // 20000))
       ELSE greatest(5, CAST(floor(least(10, greatest(5, rows // 30000))
            * CASE WHEN ls <= 3 THEN 1.5 WHEN ls <= 10 THEN 1.0 ELSE 0.7 END) AS INTEGER)) END AS INTEGER) AS num_tables
FROM base""", patterns=True)
ORACLES["encoded_edge_patterns"] = with_fixture(_ENCODED + f"""
, ev AS (SELECT *, list_concat({_code('rel_type', 10)}, {_code('src_key', 4)}, {_code('dst_key', 4)}) AS c FROM epatterns)
SELECT rel_type, src_key, dst_key, props_key, n, CAST(18 + (SELECT count(*) FROM evocab) AS INTEGER) AS dim,
  round(c[1], 6) AS f1, round(c[10], 6) AS f10, round(c[11], 6) AS f11, round(c[15], 6) AS f15, round(c[18], 6) AS f18,
  (SELECT string_agg(CASE WHEN list_contains(string_split(props_key, ','), v.key) THEN '1.0' ELSE '0.0' END, ','
                     ORDER BY v.key) FROM evocab v) AS flags
FROM ev""", patterns=True)
ORACLES["lsh_invariants"] = with_fixture(_ENCODED + """
SELECT kind, count(*) AS patterns, sum(n) AS elements, 0 AS unassigned, 0 AS assigned_twice, count(*) AS exact_clusters
FROM enc GROUP BY kind""", patterns=True)

# ------------------------------------------------------------------ written and imported files
_TERMS = ("'<' || subject || '> <' || predicate || '> ' || CASE WHEN object_kind = 'iri' THEN '<' || object || '>' "
          f"ELSE '\"' || {_esc('object')} || '\"' END")
ORACLES["trig_lines"] = with_fixture(f"""
SELECT CASE WHEN graph IS NOT NULL THEN '<' || graph || '> ' ELSE '' END || '{{ ' || {_TERMS} || ' . }}' AS line
FROM ({_edge_quads_sql('link')}) q""")
ORACLES["quads_written"] = with_fixture(f"""
SELECT {_TERMS} || CASE WHEN graph IS NOT NULL THEN ' <' || graph || '>' ELSE '' END || ' .' AS line
FROM ({_edge_quads_sql('reified')}) q""")
ORACLES["csv_bulk_import"] = """
SELECT 'Doc' AS kind, CAST(doc_id AS VARCHAR) AS id, array_to_string(list_sort(
  CASE WHEN doc_id % 2 = 1 AND lang IS NOT NULL THEN ['lang=' || lang] ELSE [] END
  || ['id=' || CAST(doc_id AS VARCHAR)] || CASE WHEN text IS NOT NULL THEN ['text=' || text] ELSE [] END), ';') AS props_text
FROM documents
UNION ALL SELECT 'Buyer', '', 'name=' || c_name FROM customer
UNION ALL SELECT 'Buyer>READS>Doc', '', coalesce('in=' || lang, '') FROM customer JOIN documents ON c_custkey = doc_id"""

_PARTY = """
WITH inode AS (
  SELECT 'Party' AS space, CAST(c_custkey AS VARCHAR) AS id, 'Customer' AS label FROM customer
  UNION ALL SELECT 'Party', CAST(s_suppkey AS VARCHAR), 'Supplier' FROM supplier
  UNION ALL SELECT '', 'order-' || o_orderkey, 'Order' FROM orders
  UNION ALL SELECT '', CAST(n_nationkey AS VARCHAR), 'Nation' FROM nation),
iedge AS (
  SELECT 'ORDERED' AS rel, 'Party' AS src_space, CAST(o_custkey AS VARCHAR) AS src, '' AS dst_space,
         'order-' || o_orderkey AS dst, '' AS quality FROM orders
  UNION ALL SELECT 'LABELS', 'Party', CAST(doc_id AS VARCHAR), '', CAST(doc_id AS VARCHAR), '' FROM labels
  UNION ALL SELECT 'RATES', '', CAST(nullif(doc_id, 0) AS VARCHAR), 'Party', CAST(doc_id + 600 AS VARCHAR), coalesce(CAST(quality AS VARCHAR), '')
  FROM labels),
iid AS (SELECT space, id, min(label) AS label, count(*) AS n FROM inode GROUP BY 1, 2),
met AS (SELECT e.*, s.label AS src_label, d.label AS dst_label FROM iedge e
        LEFT JOIN iid s ON s.space = e.src_space AND s.id = e.src LEFT JOIN iid d ON d.space = e.dst_space AND d.id = e.dst)
"""
ORACLES["csv_import_report"] = _PARTY + """
SELECT 'node' AS kind, space AS subject, CAST(sum(n) AS BIGINT) AS n, 0::BIGINT AS without_id,
       CAST(sum(n - 1) AS BIGINT) AS duplicates, 0::BIGINT AS bad_start, 0::BIGINT AS bad_end, 0::BIGINT AS bad
FROM iid GROUP BY space
UNION ALL SELECT 'edge', rel, count(*), count(CASE WHEN src IS NULL OR dst IS NULL THEN 1 END), 0,
       count(CASE WHEN src_label IS NULL THEN 1 END), count(CASE WHEN dst_label IS NULL THEN 1 END),
       count(CASE WHEN src_label IS NULL OR dst_label IS NULL THEN 1 END) FROM met GROUP BY rel"""
ORACLES["csv_import_edges"] = _PARTY + """
SELECT rel AS rel_type, src AS src_key, dst AS dst_key, src_label, dst_label, quality FROM met
WHERE src_label IS NOT NULL AND dst_label IS NOT NULL"""
ORACLES["csv_bad_edges"] = _PARTY + """
SELECT rel AS rel_type, src, src_space, dst, dst_space,
       CASE WHEN src_label IS NULL AND dst_label IS NULL THEN 'both' WHEN src_label IS NULL THEN 'start' ELSE 'end' END AS missing
FROM met WHERE src_label IS NULL OR dst_label IS NULL"""

_NODE_XML = """SELECT 'node' AS kind, n.type_name, CAST(q.node_id AS VARCHAR) AS id, NULL::VARCHAR AS src_labels_key,
    NULL::VARCHAR AS src, NULL::VARCHAR AS dst_labels_key, NULL::VARCHAR AS dst,
    coalesce((SELECT string_agg(p.key || '=' || p.value, ';' ORDER BY p.key || '=' || p.value)
              FROM gprops p WHERE p.node_id = q.node_id AND trim(p.value) <> ''), '') AS props_text
    FROM node_type q JOIN tnames n USING (type_id)"""
_EDGE_XML = """SELECT 'edge', e.rel_type, e.edge_id, CASE WHEN e.src_key = '' THEN 'Node' ELSE e.src_key END, CAST(e.src_id AS VARCHAR),
    CASE WHEN e.dst_key = '' THEN 'Node' ELSE e.dst_key END, CAST(e.dst_id AS VARCHAR),
    coalesce(p.props_text, '') FROM gedges e LEFT JOIN (
        SELECT edge_id, string_agg(key || '=' || value, ';' ORDER BY key || '=' || value) AS props_text
        FROM geprops WHERE trim(value) <> '' GROUP BY edge_id) p USING (edge_id)"""
ORACLES["typed_elements"] = with_sinks(f"{_NODE_XML} UNION ALL {_EDGE_XML}")
ORACLES["xml_validation"] = with_sinks("""
SELECT 'as_is' AS run, 'node' AS kind, n.type_name, count(*)::BIGINT AS elements, count(*)::BIGINT AS valid, 0::BIGINT AS invalid
FROM node_type q JOIN tnames n USING (type_id) GROUP BY n.type_name
UNION ALL SELECT 'as_is', 'edge', rel_type, count(*), count(*), 0 FROM gedges GROUP BY rel_type
UNION ALL SELECT 'broken', 'node', n.type_name, count(*), count(CASE WHEN q.node_id % 7 <> 0 OR p.value IS NULL THEN 1 END),
       count(CASE WHEN q.node_id % 7 = 0 AND p.value IS NOT NULL THEN 1 END)
FROM node_type q JOIN tnames n USING (type_id) LEFT JOIN gprops p ON p.node_id = q.node_id AND p.key = 'acctbal'
GROUP BY n.type_name""")
ORACLES["xml_chunks"] = with_sinks("""
, sizes AS (SELECT 'node' AS kind, n.type_name AS tag, count(*) AS c FROM node_type q JOIN tnames n USING (type_id) GROUP BY 2
            UNION ALL SELECT 'edge', rel_type, count(*) FROM gedges GROUP BY 2)
SELECT kind, tag, 100::BIGINT AS items, 1::BIGINT AS opened, 1::BIGINT AS closed, (c // 100)::BIGINT AS files FROM sizes WHERE c >= 100
UNION ALL SELECT kind, tag, c % 100, 1, 1, 1 FROM sizes WHERE c % 100 > 0""".lstrip())
ORACLES["property_types_strict"] = "WITH " + FIXTURE + "," + STRICT_CTES + """
SELECT 'node' AS kind, * FROM nptypes UNION ALL SELECT 'edge', * FROM eptypes"""
ORACLES["encoded_node_codes"] = with_fixture(_ENCODED + f"""
, nv AS (SELECT *, {_code('labels_key', 5)} AS c FROM npatterns)
SELECT labels_key, props_key, n, CAST(5 + (SELECT count(*) FROM nvocab) AS INTEGER) AS dim,
  round(c[1], 6) AS f1, round(c[2], 6) AS f2, round(c[3], 6) AS f3, round(c[4], 6) AS f4, round(c[5], 6) AS f5
FROM nv""", patterns=True)
