"""DuckDB SQL for the corpus queries that SQL can express.

Written from the contracts alone; nothing is taken from the operators.
"""

from __future__ import annotations


def crc32(codes: str) -> str:
    """Unsigned CRC-32 (reflected polynomial EDB88320) of a list of byte values."""
    bits = """list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END,
                          xor(c, b))"""
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(col: str) -> str:
    return f"coalesce(strlen({col}::VARCHAR)::VARCHAR || ':' || {col}::VARCHAR, '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ID_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"

#: Levels by recursion over whole levels, proofs by a join of every document with its runs.
MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, sha256({_HEAD} || {_field("text")}) AS leaf,
           CASE WHEN {crc32(_ID_BYTES)} % 3 = 0
                THEN sha256({_HEAD} || {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS tampered
    FROM documents),
base AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS size
    FROM leaves),
nodes(lvl, lang, pos, size, h) AS (
    SELECT 0, lang, pos, size, leaf FROM base
    UNION ALL
    SELECT lvl + 1, lang, pos // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
    FROM nodes WHERE size > 1 GROUP BY lvl, lang, pos // 8),
tops AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
    FROM nodes WHERE size = 1),
upper_nodes(lvl, pos, size, h) AS (
    SELECT 0, pos, size, subroot FROM tops
    UNION ALL
    SELECT lvl + 1, pos // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY pos))
    FROM upper_nodes WHERE size > 1 GROUP BY lvl, pos // 8),
steps AS (
    SELECT b.doc_id, 0 AS stage, n.lvl,
           coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < b.pos // (8 ** n.lvl)::BIGINT), '') AS l,
           coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > b.pos // (8 ** n.lvl)::BIGINT), '') AS r
    FROM base b JOIN nodes n ON n.lang IS NOT DISTINCT FROM b.lang AND n.size > 1
                            AND n.pos // 8 = b.pos // (8 ** (n.lvl + 1))::BIGINT
    GROUP BY ALL
    UNION ALL
    SELECT b.doc_id, 1, n.lvl,
           coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < t.pos // (8 ** n.lvl)::BIGINT), ''),
           coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > t.pos // (8 ** n.lvl)::BIGINT), '')
    FROM base b JOIN tops t ON t.lang IS NOT DISTINCT FROM b.lang
         JOIN upper_nodes n ON n.size > 1 AND n.pos // 8 = t.pos // (8 ** (n.lvl + 1))::BIGINT
    GROUP BY ALL),
proofs AS (
    SELECT doc_id, list(l || '|' || r ORDER BY stage, lvl) AS path, string_agg(l || r, '' ORDER BY stage, lvl) AS siblings
    FROM steps GROUP BY doc_id),
folded AS (
    SELECT b.doc_id, b.leaf, t.subroot, (SELECT h FROM upper_nodes WHERE size = 1) AS root,
           sha256(coalesce(p.siblings, '')) AS proof_sha256,
           list_reduce(coalesce(p.path, []::VARCHAR[]),
                       lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)),
                       coalesce(b.tampered, b.leaf)) AS folded_root
    FROM base b JOIN tops t ON t.lang IS NOT DISTINCT FROM b.lang LEFT JOIN proofs p ON p.doc_id = b.doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


_RUN_BYTES = """list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda x: ascii(x)::BIGINT) ||
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                           ELSE [(192 + unicode(x) // 64)::BIGINT, (128 + unicode(x) % 64)::BIGINT] END))"""

#: Near words by what is left of a word without one character; roots by recursion over forms.
SPELLING = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]{{7,}}')) AS run
    FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT *, {crc32(_RUN_BYTES)} AS h FROM counted),
changed AS (
    SELECT times, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
    FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
rests AS (
    SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn
    FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
    UNION
    SELECT a.word, a.n, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word),
near AS (SELECT a AS word, an AS n, b AS other, bn AS m FROM pairs UNION ALL SELECT b, bn, a, an FROM pairs),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m
    FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form,
           CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (
    SELECT word, word AS at, 0 AS step FROM forms
    UNION ALL
    SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(walk.at, walk.step) AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word GROUP BY ALL"""
