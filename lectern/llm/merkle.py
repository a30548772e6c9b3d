"""Merkle manifest of a dataset: one tree per group of rows, one tree over the groups, and a proof for every row.

A row's leaf is the digest of its columns. A group's leaves in order are joined in runs of `fanout` to their parents, these to theirs, until one
node is left, the group's subroot; subroots in the order of groups are joined likewise to the root. Every level is a table in the
shared folder. Bottom up, a level is one aggregate of the level below by (tree, place div fanout). Top down, a level's rows meet
their parents by that same key: each child puts its siblings before the proof that its parent inherited. So no task sees more than a run at a time, whatever the
sizes of groups; rows shuffled over all levels are twice the leaves, once each way.

Places in a group come from one sort by ranges of (group, order) with the counts of its ranges, so that a group of any size is spread over many tasks.

Defined results: a null column is `-` in a leaf; a null group is a group of its own, before all others; a null order value comes first; rows that tie are
ordered by their leaves (rows that tie in both are equal, and share no place); a lone leaf is its group's subroot and its proof is empty; an empty
table gives no row; further columns don't matter. Digests are sha256 as lower-case hex text, and are joined as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import FEW_TASKS, FILE_ROWS, fold, new_folder, small

#: Hex digits of a digest.
HEX = 64


def field(value: Column) -> Column:
    """A column's part of a leaf: `-`, or its length in bytes, a colon and it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _written(df: DataFrame, kind: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder. rows: how many it has, if known; files of fewer than FILE_ROWS are then avoided."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, kind)
    most = max(-(-rows // FILE_ROWS), min(FEW_TASKS, spark.sparkContext.defaultParallelism)) if rows is not None else None
    (df if most is None else df.coalesce(most)).write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int, int]:
    """(rows (tree, digest, ...) with pos, their place in the tree from 0, and n, the tree's size; rows in all; most in a tree).
    Rows of one tree are sorted by ranges: equal ones too are dealt over several."""
    ordered = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "digest", "__row")
    placed = _written(ordered.sortWithinPartitions("tree", *order, "digest").withColumn("__at", F.monotonically_increasing_id()).drop("__row"), "merkle-leaves")
    # __at is the range's number and the place in it: of each tree in each range, the first place and the count tell where it goes on.
    range_of = F.shiftright("__at", 33).alias("__range")
    counts = placed.groupBy("tree", range_of).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # A tree has at most a row a range here.
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = _written(counts.select("tree", "__range", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("n")), "merkle-offsets")
    size = offsets.groupBy("tree").agg(F.first("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    named = placed.withColumn("__range", range_of).join(small(offsets), ["tree", "__range"])
    return named.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift"), size["all"], size["most"]


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """tree, pos, n, digest, kids (the run's digests in order) of the level above; trees of one node are done and leave no row."""
    runs = level.where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"))
    kid = F.struct((F.col("pos") % fanout).alias("i"), F.col("digest").alias("digest"))
    kids = F.transform(F.array_sort(F.collect_list(kid)), lambda k: k["digest"])
    above = runs.agg(F.first(F.floor((F.col("n") + (fanout - 1)) / fanout)).alias("n"), kids.alias("kids"))
    return above.select("tree", "pos", "n", F.unhex(F.sha2(F.array_join(F.transform("kids", lambda k: F.lower(F.hex(k))), ""), 256)).alias("digest"), "kids")


@dataclass
class Forest:
    """Persisted levels of trees; levels[0] has the leaves, all levels (tree, pos, n, digest), and from the second on kids. rows: about how many each has."""

    levels: list[DataFrame]
    rows: list[int]
    fanout: int

    def tops(self) -> DataFrame:
        """tree, digest of each tree's last node."""
        found = [level.where("n = 1").select("tree", "digest") for level in self.levels]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def proofs(self, inherited: DataFrame) -> DataFrame:
        """The leaves with proof (their siblings up to the tree's top, then what the tree inherits) and the other columns of inherited (tree, proof, ...)."""
        extra = [c for c in inherited.columns if c not in ("tree", "proof")]
        inherited, here = small(inherited), None
        for at in range(len(self.levels) - 1, -1, -1):
            level = self.levels[at]
            # A tree's last node takes what the tree inherits, every other what its parent has.
            ends = level.where("n = 1").join(inherited, "tree")
            if here is None:
                here = ends
            else:
                family = here.select("tree", F.col("pos").alias("__run"), F.col("kids").alias("__kin"), "proof", *extra)
                met = level.where("n > 1").withColumn("__run", F.floor(F.col("pos") / self.fanout)).join(family, ["tree", "__run"])
                i = F.col("pos") % self.fanout
                siblings = [F.coalesce(F.when(i != j, F.get("__kin", F.lit(j))), F.lit(b"")) for j in range(self.fanout)]
                here = met.withColumn("proof", F.concat(*siblings, "proof")).drop("__run", "__kin").unionByName(ends)
            if at:
                here = _written(here.select("tree", "pos", "kids", "proof", *extra), "merkle-proofs", self.rows[at])
        return here


def grow(leaves: DataFrame, order: list[str], fanout: int = 2) -> Forest:
    """leaves: tree (a string), digest (binary), the columns of order, and more that stay with the leaves."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    first, rows, most = numbered(leaves, order)
    levels, counts = [first], [rows]
    while most > 1:
        counts.append(-(-counts[-1] // fanout))
        levels.append(_written(parents(levels[-1], fanout), "merkle-level", counts[-1]))
        most = -(-most // fanout)
    return Forest(levels, counts, fanout)


def height(n: Column, fanout: int) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(float(fanout)), i) < n))


def folded(node: Column, proof: Column, used: Column, pos: Column, n: Column, fanout: int) -> Column:
    """(node, used): the top that a leaf's digest and its siblings give, and the digests of the hex text proof used so far."""
    start = F.struct(node.alias("node"), used.cast("long").alias("used"), pos.cast("long").alias("pos"), n.cast("long").alias("n"))

    def up(at: Column, _: Column) -> Column:
        i = at["pos"] % fanout
        more = F.least(F.lit(fanout).cast("long"), at["n"] - (at["pos"] - i)) - 1
        siblings = proof.substr(at["used"] * HEX + 1, more * HEX)
        joined = F.concat(siblings.substr(F.lit(1), i * HEX), at["node"], siblings.substr(i * HEX + 1, (more - i) * HEX))
        return F.struct(F.sha2(joined, 256).alias("node"), (at["used"] + more).alias("used"), F.floor(at["pos"] / fanout).alias("pos"), F.floor((at["n"] + (fanout - 1)) / fanout).alias("n"))

    steps = height(n, fanout)
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, up)).otherwise(start)


def prove(rows: DataFrame, group: Column, order: Column, columns: list[Column], fanout: int = 2, keep: dict[str, Column] | None = None) -> DataFrame:
    """Every row's leaf, subroot, root, proof (hex text) with pos, n (in its group) and group_pos, groups; and the columns of keep."""
    keep = keep or {}
    # Groups as text whose order is null first, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    # Whole rows are read once; what follows works on digests.
    leaves = _written(rows.select(tree.alias("tree"), order.alias("__order"), F.unhex(leaf(*columns)).alias("digest"), *[c.alias(k) for k, c in keep.items()]), "merkle-rows")
    low = grow(leaves, ["__order"], fanout)
    high = grow(low.tops().select(F.lit("").alias("tree"), "digest", F.col("tree").alias("__group")), ["__group"], fanout)
    root = high.tops().select(F.col("digest").alias("root"))
    top = high.proofs(root.select(F.lit("").alias("tree"), F.lit(b"").alias("proof"), "root"))
    inherited = _written(top.select(F.col("__group").alias("tree"), "proof", F.col("digest").alias("subroot"), "root", F.col("pos").alias("group_pos"), F.col("n").alias("groups")), "merkle-groups")
    text = {c: F.lower(F.hex(c)) for c in ("subroot", "root", "proof")}
    return low.proofs(inherited).select(*keep, F.lower(F.hex("digest")).alias("leaf"), *[c.alias(k) for k, c in text.items()], "pos", "n", "group_pos", "groups")


def verified(proofs: DataFrame, claimed: Column, fanout: int = 2) -> DataFrame:
    """proofs with folded_root, which the leaf claimed gives with the row's siblings."""
    low = proofs.withColumn("__low", folded(claimed, F.col("proof"), F.lit(0), F.col("pos"), F.col("n"), fanout))
    high = folded(F.col("__low")["node"], F.col("proof"), F.col("__low")["used"], F.col("group_pos"), F.col("groups"), fanout)
    return low.withColumn("folded_root", high["node"]).drop("__low")


def manifest(docs: DataFrame, tampered_one_in: int = 7, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents: a tree for each lang, in the order of doc_id.
    To prove that the check tells changed rows, n_chars of rows whose crc32 of doc_id is divisible by tampered_one_in counts one more when roots are folded."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    columns = [F.col(c) for c in names]
    changed = leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    claimed = F.when(fold("doc_id", tampered_one_in) == 0, changed).otherwise(leaf(*columns))
    proofs = prove(docs, F.col("lang"), F.col("doc_id"), columns, fanout, {"doc_id": F.col("doc_id"), "__claimed": F.unhex(claimed)})
    out = verified(proofs, F.lower(F.hex("__claimed")), fanout)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
