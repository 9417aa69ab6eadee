"""Merkle manifest of a dataset: a tree for each group of rows, and a tree over the groups' roots.

A row's leaf is a hash of its fields. Leaves of a group are ordered and numbered,
and every ``fanout`` consecutive nodes make the next level until one is left, the
group's subroot; subroots in the order of their groups make the root the same way.

A level is a slot pivot: nodes are grouped by (group, number div fanout), and a
conditional aggregate for each slot puts a parent's children into fanout columns.
Concatenating the columns hashes the parent; leaving a child's own column out
gives its siblings. Going down again, each run hands its path (siblings before
and after, a level an entry) to its children with an equi-join on (group, number).

Everything is built-in functions. Rows are numbered by a range partitioning on
(group, id) with row counts per partition, so a group of any size is spread over
partitions at every step; a run has at most ``fanout`` nodes. Only the number of
levels and the root reach the driver. Levels are written to the shared folder.

Cases: a null field is hashed as ``-``, an empty one as ``0:``; a null group is a
group and comes first, null ids come first in their group; rows of equal id are
ordered by leaf, and equal rows are leaves of their own; a run of one node is
hashed like any other; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT = 3
#: ``monotonically_increasing_id`` holds the partition above this many bits.
_PART_BITS = 33


def field_text(field: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    """sha256 of ``text`` as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def as_text(digests: Column) -> Column:
    """Digests (bytes, one or several after another) as lower-case hex."""
    return F.lower(F.hex(digests))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field_text, fields)))


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column ``grp``) with ``idx``, a row's place in its group from 0, and the group's size ``n``.

    The place is that in the order of the columns ``order``, nulls first. Rows are
    range-partitioned by group and order; a group's earlier partitions add their
    counts, a row for each group and partition that meet.
    """
    rows = rows.withColumn("at_row", F.monotonically_increasing_id())  # equal rows can be dealt apart
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "at_row")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at_row").withColumn("place", F.monotonically_increasing_id())
    dealt = written(dealt, "merkle-order").withColumn("part", F.shiftright("place", _PART_BITS))
    counts = dealt.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (F.col("first") - F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("base"),
                           F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    joined = dealt.join(counts, dealt["grp"].eqNullSafe(counts["g"]) & (dealt["part"] == counts["p"]))
    return joined.withColumn("idx", F.col("place") - F.col("base")).drop("g", "p", "base", "part", "place")


def pivoted(nodes: DataFrame, fanout: int) -> DataFrame:
    """Runs of ``fanout`` consecutive ``nodes`` (grp, idx, n, child): columns c0, c1, ... hold the children, ``digest`` their hash."""
    slot = F.col("idx") % fanout
    runs = nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n")).agg(
        *(F.max(F.when(slot == i, F.col("child"))).alias(f"c{i}") for i in range(fanout)))
    return runs.withColumn("digest", digest(as_text(_joined(F.col(f"c{i}.digest") for i in range(fanout)))))


def _joined(digests) -> Column:
    digests = [F.coalesce(d, _nothing()) for d in digests]
    return F.concat(*digests) if digests else _nothing()


class Tree:
    """Levels of runs over ``leaves`` (grp, idx, n, child), child a struct that starts with ``digest``; all groups at once."""

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("a run must hold at least 2 nodes")
        self.fanout, self.leaves, self.levels = fanout, leaves, []
        left = leaves.agg(F.max("n")).first()[0] or 0
        nodes = leaves
        while left > 1:
            runs = written(pivoted(nodes.filter("n > 1"), fanout), "merkle-level")
            self.levels.append(runs)
            nodes = runs.select("grp", "idx", "n", F.struct("digest").alias("child"))
            left = -(-left // fanout)

    def tops(self) -> DataFrame:
        """(grp, depth, digest): each group's last node and the number of levels below it."""
        out = self.leaves.filter("n = 1").select("grp", F.lit(0).alias("depth"), "child.digest")
        for depth, runs in enumerate(self.levels, start=1):
            out = out.unionByName(runs.filter("n = 1").select("grp", F.lit(depth).alias("depth"), "digest"))
        return out

    def paths(self, tops: DataFrame) -> DataFrame:
        """(child, path, any other columns of ``tops``) for each leaf.

        ``tops`` has (grp, depth, path, others): what follows above a group's last
        node. A path is an array of (before, after), the siblings' digests, from
        the leaf's level up.
        """
        others = [c for c in tops.columns if c not in ("grp", "depth", "path")]

        def from_top(depth: int) -> DataFrame:
            return tops.filter(F.col("depth") == depth).select("grp", F.lit(0).cast("long").alias("idx"), "path", *others)

        above = from_top(len(self.levels))
        for level in reversed(range(len(self.levels))):
            ups = above.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "path", *others)
            runs = self.levels[level]
            runs = runs.join(ups, runs["grp"].eqNullSafe(ups["g"]) & (runs["idx"] == ups["i"]))
            entry = [F.struct(_joined(F.col(f"c{j}.digest") for j in range(i)).alias("before"),
                              _joined(F.col(f"c{j}.digest") for j in range(i + 1, self.fanout)).alias("after")) for i in range(self.fanout)]
            kids = F.array(*(F.struct(F.lit(i).alias("slot"), F.col(f"c{i}").alias("child"), entry[i].alias("entry")) for i in range(self.fanout)))
            kids = F.filter(kids, lambda k: k["child"].isNotNull())
            below = runs.select("grp", "idx", "path", *others, F.explode(kids).alias("kid")).select(
                "grp", (F.col("idx") * self.fanout + F.col("kid.slot")).alias("idx"), F.concat(F.array("kid.entry"), "path").alias("path"), "kid.child", *others)
            if level:
                above = below.drop("child").unionByName(from_top(level))
            else:
                above = below.select("child", "path", *others)
        own, alone = from_top(0), self.leaves.filter("n = 1").select(F.col("grp").alias("g"), "child")
        alone = alone.join(own, alone["g"].eqNullSafe(own["grp"])).select("child", "path", *others)
        return above.unionByName(alone) if self.levels else alone


def folded(start: Column, path: Column) -> Column:
    """The root that the digest ``start`` leads to along ``path``."""
    return F.aggregate(path, start, lambda own, e: digest(as_text(F.concat(e["before"], own, e["after"]))))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings on ``path``, lower-case hex."""
    return F.sha2(F.array_join(F.transform(path, lambda e: as_text(F.concat(e["before"], e["after"]))), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str], group_col: str, id_col: str, fanout: int = FANOUT, changed: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: grp, id, leaf, now, subroot, root (digests as bytes) and path.

    ``changed`` gives, by field, what the row holds now where that may differ from
    what the manifest is made of; ``now`` is the leaf of those values, so
    ``folded(now, path) = root`` tells whether the row is as it was.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    now = leaf_digest([(changed or {}).get(c, F.col(c)) for c in fields]) if changed else leaf
    rows = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), now.alias("now"))
    rows = numbered(written(rows, "merkle-leaves"), ["id", "leaf"])
    tree = Tree(written(rows.select("grp", "idx", "n", F.struct(F.col("leaf").alias("digest"), "now", "id").alias("child")), "merkle-nodes"), fanout)
    subroots = written(tree.tops(), "merkle-subroots")
    named = subroots.select(F.lit(0).alias("grp"), F.struct("digest", F.col("grp").alias("name"), "depth").alias("child"), F.col("grp").alias("name"))
    upper = Tree(written(numbered(named, ["name"]).select("grp", "idx", "n", "child"), "merkle-groups"), fanout)
    no_path = F.array().cast("array<struct<before:binary,after:binary>>")
    tops = upper.paths(upper.tops().select("grp", "depth", no_path.alias("path"), F.col("digest").alias("root")))
    tops = written(tops.select(F.col("child.name").alias("grp"), "child.depth", "path", F.col("child.digest").alias("subroot"), "root", F.col("child.name").alias("name")), "merkle-tops")
    return tree.paths(tops).select(F.col("name").alias("grp"), "child.id", F.col("child.digest").alias("leaf"), "child.now", "subroot", "root", "path")
