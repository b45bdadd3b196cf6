"""Merkle manifest of a table: digests, proofs and their verification.

A row's leaf is the SHA-256 of its fields, each written as its UTF-8 length,
``:`` and its value, or ``-`` if null. The leaves of a group (a language, say)
are numbered by id; every ``fanout`` consecutive nodes become their parent's
digest, the last run with fewer, until one node is left: the group's subroot.
The subroots, ordered by group, become the root in the same way. Digests are
concatenated as lowercase hex.

Each level is one window over runs of at most ``fanout`` nodes: columns of lag
and lead at fixed offsets, masked by the node's slot and its run's length, are
the siblings; the row of a run's first child hashes its own digest and its
leads to the parent, which is a row of the next level. On the way back every
node joins its parent's path by (group, parent's place), a key with one row on
one side and at most ``fanout`` on the other, so no group is ever gathered,
whatever its share of the rows. Texts are read once and never shuffled: behind
the leaves only digests move. The number of levels is the logarithm of the
largest group; each level is cut into a table of the shared folder.

Only DataFrame functions run on the data.

Edge cases: null and empty values have different leaves; null ids come first
in their group; rows that repeat an id are ordered by leaf, and rows that
repeat everything have equal leaves and proofs of their own; a null group is a
group and comes first; a group of one row has its leaf as subroot, a table of
one group its subroot as root, and both together a proof of no siblings (the
digest of the empty text); an empty table gives an empty manifest; very long
texts are hashed where they are read; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphsift.operators.numbering import dense_number
from graphsift.session import cut_lineage, drop_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields of a row."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]), 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def lower_a_to_z(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (g, pos, size, h, ...) with the digests ``left`` and ``right``
    of each node in its run; nodes that are alone in their group have none."""
    run = Window.partitionBy("g", F.floor(F.col("pos") / fanout)).orderBy("pos")
    slot = F.col("pos") % fanout
    length = F.least(F.lit(fanout), F.col("size") - (F.col("pos") - slot))
    none = F.lit(b"")
    left = [F.when(slot >= j, F.lag("h", j).over(run)).otherwise(none) for j in range(fanout - 1, 0, -1)]
    right = [F.when(slot + j < length, F.lead("h", j).over(run)).otherwise(none) for j in range(1, fanout)]
    return nodes.select("*", F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels from the given nodes (g, pos, size, h, ...) up to where every
    group has one node; each is a table with ``left`` and ``right``."""
    levels = []
    while True:
        level = cut_lineage(_siblings(nodes, fanout))
        levels.append(level)
        if level.where("size > 1").isEmpty():
            return levels
        parent = F.unhex(F.sha2(hex_of(F.concat("h", "right")), 256))
        nodes = (level.where((F.col("size") > 1) & (F.col("pos") % fanout == 0))
                 .select("g", F.floor(F.col("pos") / fanout).alias("pos"),
                         F.ceil(F.col("size") / fanout).alias("size"), parent.alias("h")))


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest level with its paths: ``lefts`` and ``rights`` (siblings per
    level, the lowest first) and all that ``tops`` says of each group.

    ``tops`` has a row per group: (top_g, lefts, rights, ...); a group's last
    node takes it over, the nodes below take their parent's and add their own.
    """
    said = [c for c in tops.columns if c not in ("top_g", "lefts", "rights")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        last = level.where("size = 1").join(tops, F.col("g") == F.col("top_g")).drop("top_g")
        paths = last
        if above is not None:
            up = above.select(F.col("g").alias("up_g"), F.col("pos").alias("up_pos"), "lefts", "rights", *said)
            own = (level.where("size > 1")
                   .join(up, (F.col("g") == F.col("up_g")) & (F.floor(F.col("pos") / fanout) == F.col("up_pos")))
                   .withColumn("lefts", F.concat(F.array("left"), "lefts"))
                   .withColumn("rights", F.concat(F.array("right"), "rights")).drop("up_g", "up_pos"))
            paths = own.unionByName(last)
        if depth == 0:
            return paths
        above = cut_lineage(paths.select("g", "pos", "lefts", "rights", *said))
    raise ValueError("no levels")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", fanout: int = 8,
             claim: Column | None = None) -> DataFrame:
    """(id, group, leaf, subroot, root, lefts, rights, claim) per row of ``docs``.

    ``lefts`` and ``rights`` hold the proof: per level, the concatenated
    digests before and after the node. ``claim`` is any expression over
    ``docs`` that is carried along, a leaf digest to be verified, say.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    group = F.coalesce(F.concat(F.lit("v"), _col(group_col).cast("string")), F.lit("n"))  # null sorts first
    claim = F.lit(None).cast("binary") if claim is None else claim
    leaves = cut_lineage(docs.select(group.alias("g"), _col(id_col).alias("id"),
                                     leaf_digest([_col(f) for f in fields]).alias("h"), claim.alias("claim")))
    levels = _climb(dense_number(leaves, ["id", "h"], "g", "pos", "size"), fanout)
    drop_table(leaves)
    tops = reduce(DataFrame.unionByName, [x.where("size = 1").select("g", "h") for x in levels])
    named = dense_number(tops.select(F.lit("").alias("all"), F.col("g").alias("name"), "h"), ["name"], "all", "pos", "size")
    upper = _climb(named.select(F.col("all").alias("g"), "name", "pos", "size", "h"), fanout)
    no_path = F.array().cast("array<binary>")
    roots = upper[-1].where("size = 1").select(F.col("g").alias("top_g"), no_path.alias("lefts"),
                                               no_path.alias("rights"), F.col("h").alias("root"))
    of_group = cut_lineage(_descend(upper, roots, fanout).select(
        F.col("name").alias("top_g"), "lefts", "rights", F.col("h").alias("subroot"), "root"))
    out = _descend(levels, of_group, fanout)
    return out.select(F.col("id").alias(id_col), F.when(F.col("g") != "n", F.substring("g", 2, 1 << 30)).alias(group_col),
                      F.col("h").alias("leaf"), "subroot", "root", "lefts", "rights", "claim")


def proof_digest(lefts: str = "lefts", rights: str = "rights") -> Column:
    """Hex SHA-256 of all siblings, level by level, left to right."""
    parts = F.zip_with(lefts, rights, lambda a, b: hex_of(F.concat(a, b)))
    return F.sha2(F.array_join(parts, ""), 256)


def fold(leaf: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """Hex root that follows from a leaf digest (binary) and a proof."""
    steps = F.zip_with(lefts, rights, lambda a, b: F.struct(hex_of(a).alias("a"), hex_of(b).alias("b")))
    return F.aggregate(steps, hex_of(leaf), lambda h, s: F.sha2(F.concat(s["a"], h, s["b"]), 256))
