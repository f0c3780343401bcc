"""A Merkle manifest of a table by nested-interval labels.

A row's digest is a leaf. Within a group leaves have ranks, and a node of the tree carries the interval [lo, hi) of leaf
ranks that it covers: runs of ``fan_out`` neighbouring nodes become a parent until one is left, the group's subroot.
Subroots are the leaves of a last tree, whose top is the root. Ancestors are attached from the top down by containment
joins: a node lies in the parent whose interval holds its own, and both are found by the level's bucket, lo over the
level's width. What a parent covers besides a child - its interval less the child's, to the left and to the right - is
the child's siblings.

Only digests move. Ranks come from a range partitioning and the rows that the partitions before hold, so that no group,
however large, is one task; all later keys are ranks divided by a width, which no hot group can crowd.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyseq.llm._shared import partitions_for, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range, about.
RANGE_ROWS = 500_000
_PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as text, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values encoded and put end to end."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _ranked(df: DataFrame, order: list[str], what: str) -> DataFrame:
    """``df`` with lo, hi (the rank within column g and the next one) and n (the rows of g); ``order`` begins with g and has no ties.

    Rows are dealt out by ranges of ``order`` and staged, numbered within each range. A row's rank is its number less
    that of the first row of its group in the range, and the rows that the group has in the ranges before.
    """
    spark = df.sparkSession
    parts = partitions_for(spark, df.count(), RANGE_ROWS)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stage(rows, what).withColumn("part", F.shiftright("at", 33))
    firsts = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))  # a row for each range and each group at most
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("k").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("g", "part", "first", before.alias("before"), F.sum("k").over(own).alias("n"))
    lo = F.col("at") - F.col("first") + F.col("before")
    return rows.join(firsts, ["g", "part"]).withColumn("lo", lo).withColumn("hi", lo + 1).drop("at", "part", "first", "before")


@dataclass(frozen=True)
class Tree:
    """lone: leaves that are their group's only one. levels[k]: the parents of level k + 1, with g, n, lo, hi, digest and their children in order."""

    lone: DataFrame
    levels: list[DataFrame]
    fan_out: int

    def roots(self) -> DataFrame:
        """g, digest of the top node of each group."""
        out = self.lone.select("g", "digest")
        for x in self.levels:
            out = out.unionByName(x.filter("hi - lo = n").select("g", "digest"))
        return out

    def attach(self, tops: DataFrame) -> DataFrame:
        """The leaves with the columns of ``tops`` (g, subroot, path above it), their own path put in front of that."""
        down, width = None, self.fan_out ** len(self.levels)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k].withColumn("bucket", F.expr(f"lo div {width}L"))
            at = level.filter("hi - lo = n").join(tops, "g")
            if down is not None:
                above = down.select("g", F.col("node.lo").alias("c_lo"), F.col("node.hi").alias("c_hi"), "subroot", "path", F.expr(f"node.lo div {width}L").alias("bucket"))
                inner = level.join(above, ["g", "bucket"]).filter("c_lo <= lo and hi <= c_hi").drop("c_lo", "c_hi")
                at = at.unionByName(inner)
            node = at.select("g", "n", "subroot", "path", "children", F.explode("children").alias("node"))
            side = lambda test: F.array_join(F.transform(F.filter("children", test), lambda c: c["digest"]), "")
            siblings = F.struct(side(lambda c: c["hi"] <= F.col("node.lo")).alias("left"), side(lambda c: c["lo"] >= F.col("node.hi")).alias("right"))
            down = node.select("g", "node", "subroot", F.concat(F.array(siblings), F.col("path")).alias("path"))
            width //= self.fan_out
        carried = [c for c in self.lone.columns if c not in ("g", "n")]
        out = self.lone.join(tops, "g").select(*carried, "subroot", "path")
        return out if down is None else out.unionByName(down.select(*[F.col(f"node.{c}").alias(c) for c in carried], "subroot", "path"))


def tree(leaves: DataFrame, order: list[str], what: str, fan_out: int = 16) -> Tree:
    """The trees over ``leaves`` (g, digest and what is carried along), a tree for each g, leaves in ``order``."""
    ranked = _ranked(leaves, order, f"{what}-leaves")
    carried = [c for c in leaves.columns if c not in ("g", "digest")]
    width, levels = fan_out, []
    nodes = ranked.select("g", "n", "lo", "hi", "digest", *carried)
    most = nodes.agg(F.max("n")).first()[0] or 0
    own = ["lo", "hi", "digest", *carried]
    while most > 1:
        kin = F.array_sort(F.collect_list(F.struct(*own)))  # fan_out nodes at most, by lo
        parents = nodes.filter("n > 1" if not levels else "hi - lo < n").groupBy("g", "n", F.expr(f"lo div {width}L").alias("bucket")).agg(kin.alias("children"))
        digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
        parents = parents.select("g", "n", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), digest.alias("digest"), "children")
        levels.append(stage(parents, f"{what}-level{len(levels) + 1}"))
        nodes, own, width, most = levels[-1].select("g", "n", "lo", "hi", "digest"), ["lo", "hi", "digest"], width * fan_out, -(-most // fan_out)
    return Tree(ranked.filter("n = 1").select("g", "n", "lo", "hi", "digest", *carried), levels, fan_out)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give: at each level left siblings, own digest, right siblings."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id", found: dict[str, Column] | None = None, fan_out: int = 16) -> DataFrame:
    """One row for each row of ``df``: doc_id, leaf, subroot, root, path (array of left and right siblings, from the leaf up), folded_root, verified.

    fields: the columns that a leaf covers, in this order. Groups are the values of ``group_col``, null first and then
    by the bytes of the value; within a group rows ascend by ``id_col``, null first, then by leaf. found: fields as they
    are met when the row is verified, as columns of ``df``; folded_root is made from these and from the siblings of the
    manifest, and verified says whether it is the root.

    Null in any field is told apart from the empty text. Rows alike in all fields have equal leaves and places next to
    each other, whichever of them has which. A text of any length is one leaf. Columns of other names are not read. An
    empty table gives an empty result.
    """
    spark, met = df.sparkSession, [(found or {}).get(c, df[c]) for c in fields]
    leaf = leaf_digest([df[c] for c in fields])
    same = [df[c].eqNullSafe(v) for c, v in zip(fields, met, strict=True) if found and c in found]
    altered = F.when(F.forall(F.array(*same), lambda x: x), F.lit(None)).otherwise(leaf_digest(met)) if same else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("1"), df[group_col].cast("string")), F.lit("0"))  # keeps the order, and null is a group
    leaves = df.select(group.alias("g"), leaf.alias("digest"), df[id_col].alias("id"), altered.alias("met")).withColumn("rid", F.monotonically_increasing_id())
    leaves = stage(leaves, "leaves")
    parts = tree(leaves, ["g", "id", "digest", "rid"], "group", fan_out)
    whole = tree(stage(parts.roots().select(F.lit("").alias("g"), "digest", F.col("g").alias("of")), "subroots"), ["g", "of"], "top", fan_out)
    root = [r[0] for r in whole.roots().select("digest").collect()]  # one at most
    empty = spark.createDataFrame([("", "", [])], f"g string, subroot string, path {_PATH}")
    tops = stage(whole.attach(empty).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "path"), "tops")
    out = parts.attach(tops).withColumn("root", F.lit(root[0] if root else None).cast("string"))
    out = out.withColumn("folded_root", folded(F.coalesce("met", "digest"), F.col("path")))
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
