"""Merkle fixity audit of WARC replicas.

Records are hashed with their byte range in their file; ordered ranges are hashed in groups into a tree per file, and
files into one tree of the collection, a level at a time. Two replicas are compared from the roots down: only children
of nodes that differ are looked at, so a clean replica costs one comparison and damage is found in as many steps as the
tree has levels. Each level is a table; the leaves below the last differing nodes are compared by record, so a record
that is missing or added isn't taken for damage of all that follow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.llm.common import Scratch

#: Records a WARC file, and children a node.
RECORDS, FANOUT = 512, 16


def record(url: Column, key: Column, html: Column) -> Column:
    """The bytes of a response record; a null part is empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """page_id, file, place, start, length, sha of each record; a file holds the ids of one range of ``per_file``."""
    one = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"), record(F.col("url"), F.col("page_id"), F.col("html")).cast("binary").alias("bytes"))
    one = one.select("page_id", "file", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("sha"))
    order = Window.partitionBy("file").orderBy("page_id", "sha")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("place"), before.cast("long").alias("start"), "length", "sha")


class Tree:
    """Levels of node tables (file, node, parent, hash), leaves first; the last has one row for the collection."""

    def __init__(self, leaves: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT):
        self.leaves = scratch.save(leaves, f"{name}-records")
        span = F.concat_ws(":", "start", "length", "sha")
        level = self.leaves.select("file", F.col("place").alias("node"), F.sha2(span.cast("binary"), 256).alias("hash"))
        self.levels = [level.withColumn("parent", F.floor(F.col("node") / fanout).cast("long"))]
        tops = self.leaves.agg(F.max("place").alias("p"), F.max("file").alias("f")).first()
        places, files = tops["p"] or 0, tops["f"] or 0
        while places > 0:
            places //= fanout
            self._up(scratch, f"{name}-{len(self.levels)}", fanout)
        self.per_file = len(self.levels)
        # files become the nodes of one more tree, kept under file 0
        top = self.levels[-1].select(F.lit(0).cast("long").alias("file"), F.col("file").alias("node"), "hash")
        self.levels.append(scratch.save(top.withColumn("parent", F.floor((F.col("node") + 1) / fanout).cast("long")), f"{name}-files"))
        files += 1
        while True:
            files //= fanout
            self._up(scratch, f"{name}-{len(self.levels)}", fanout)
            if files == 0:
                break

    def _up(self, scratch: Scratch, name: str, fanout: int) -> None:
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))  # at most ``fanout``
        made = self.levels[-1].groupBy("file", F.col("parent").alias("node")).agg(children.alias("c"))
        text = F.concat_ws(",", F.transform("c", lambda x: F.concat_ws("=", x["node"].cast("string"), x["hash"])))
        made = made.select("file", "node", F.sha2(text.cast("binary"), 256).alias("hash"))
        self.levels.append(scratch.save(made.withColumn("parent", F.floor(F.col("node") / fanout).cast("long")), name))


def audit(good: Tree, other: Tree, scratch: Scratch) -> DataFrame:
    """file, place of the leaves that differ or that one replica lacks, by descent from the root."""
    if len(good.levels) != len(other.levels) or good.per_file != other.per_file:
        suspects = None  # trees of different height share no nodes: compare all leaves
        steps = [(good.levels[0], other.levels[0], 0)]
    else:
        suspects = None
        steps = [(a, b, k) for k, (a, b) in reversed(list(enumerate(zip(good.levels, other.levels))))]
    for a, b, k in steps:
        if suspects is not None:
            on = [F.col("file") == F.col("pf"), F.col("parent") == F.col("pn")]
            a, b = (x.join(suspects, on, "left_semi") for x in (a, b))
        both = a.select("file", "node", F.col("hash").alias("x")).join(b.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full")
        bad = both.where(~F.col("x").eqNullSafe(F.col("y")))
        # a file of the collection's tree stands for the root of its own tree
        if k == good.per_file:
            pairs = bad.select(F.col("node").alias("pf"), F.lit(0).cast("long").alias("pn"))
            suspects = None if k == 0 else scratch.save(pairs, f"suspects{k}")
            top = good.levels[k - 1], other.levels[k - 1]
            on = [F.col("file") == F.col("pf"), F.col("node") == F.col("pn")]
            bad = top[0].select("file", "node").unionByName(top[1].select("file", "node")).distinct().join(suspects, on, "left_semi")
            suspects = scratch.save(bad.select(F.col("file").alias("pf"), F.col("node").alias("pn")), f"roots{k}")
            continue
        if k == good.per_file - 1 and k > 0:
            continue  # these are the files' roots, already compared
        suspects = scratch.save(bad.select(F.col("file").alias("pf"), F.col("node").alias("pn")), f"suspects{k}")
    return suspects.select(F.col("pf").alias("file"), F.col("pn").alias("place"))


def fixity_audit(pages: DataFrame, replica: DataFrame, per_file: int = RECORDS, fanout: int = FANOUT) -> DataFrame:
    """page_id, file_id, record_offset, record_length, record_sha256, status for every record of ``pages``.

    ``status``: ok, corrupt if the replica (page_id, url, html) has the id in that file with other bytes, missing if it
    lacks the record there (or has it fewer times). Records that only the replica has, or has more often, are returned
    as well, as they are there, with the status extra. A record that only moved is ok. Null parts are empty; records
    with a null id are in file -1; records that repeat an id follow one another; an empty table gives nothing; other
    columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    good, other = Tree(records(pages, per_file), scratch, "good", fanout), Tree(records(replica, per_file), scratch, "replica", fanout)
    bad, place = scratch.save(audit(good, other, scratch), "bad"), ["file", "place"]
    mine, theirs = (x.leaves.join(bad, place, "left_semi") for x in (good, other))
    one = mine.groupBy("file", "page_id", "sha").agg(F.count(F.lit(1)).alias("n"))
    two = theirs.groupBy("file", "page_id", "sha").agg(F.count(F.lit(1)).alias("m"))
    # equal records are counted; what has no equal is corrupt if its id has other bytes there, else missing or extra
    on = lambda x, y, names: [x[c].eqNullSafe(y[c]) for c in names]
    lone = one.join(two, on(one, two, ["file", "page_id", "sha"]), "left").where("m is null or m < n").select(one["file"], one["page_id"], one["sha"], F.coalesce("m", F.lit(0)).alias("m"))
    over = two.join(one, on(two, one, ["file", "page_id", "sha"]), "left").where("n is null or n < m").select(two["file"], two["page_id"], two["sha"], F.coalesce("n", F.lit(0)).alias("n"))
    lone, over = scratch.save(lone, "lone"), scratch.save(over, "over")
    changed = over.where("n = 0").select("file", "page_id").distinct()
    marks = lone.join(changed.withColumn("other", F.lit(True)).alias("c"), on(lone, changed, ["file", "page_id"]), "left")
    marks = marks.select(lone["file"], lone["page_id"], lone["sha"], F.when(F.col("other") & (F.col("m") == 0), "corrupt").otherwise("missing").alias("status"))
    known = lone.where("m = 0").select("file", "page_id").distinct()
    added = over.join(known, on(over, known, ["file", "page_id"]), "left_anti")
    extra = theirs.join(added.drop("n"), on(theirs, added, ["file", "page_id", "sha"]), "left_semi").withColumn("status", F.lit("extra"))
    suspect = mine.join(marks, on(mine, marks, ["file", "page_id", "sha"])).select(good.leaves["file"], good.leaves["place"], marks["status"])
    found = good.leaves.join(suspect, place, "left").unionByName(extra)
    return found.select(
        "page_id", F.col("file").alias("file_id"), F.col("start").alias("record_offset"), F.col("length").alias("record_length"),
        F.col("sha").alias("record_sha256"), F.coalesce("status", F.lit("ok")).alias("status"),
    )
