"""Operator 5: fixity audit of record replicas by Merkle trees.

Method: every record has a SHA-256 leaf over its place and bytes.  Leaves are
summed up by ordered ranges of record numbers: a node of level l covers
FANOUT**l numbers and hashes its children in order.  Replicas are compared from
the roots down; only children of nodes that differ are looked at, so the work
below the leaves follows the damage.  The differing leaves say which records,
at which offsets of which file, differ, are missing or are extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import written

FANOUT = 64


def warc_record(url: Column, kind: Column, body: Column) -> Column:
    """Bytes of one record in WARC/1.1 form; null parts count as empty."""
    payload = F.coalesce(body.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.coalesce(kind, F.lit("resource")), F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(payload, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), payload, F.lit(b"\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """``file``, ``number``, ``offset``, ``size``, ``hash`` of records with ``file``, ``number``, ``offset``, ``data``.

    Null data counts as empty.  A number that a file has several times is one
    leaf over all its records, ordered by hash, so repeated rows are told from
    single ones.
    """
    data = F.coalesce(F.col("data").cast("binary"), F.lit(b""))
    each = records.select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.col("number").cast("long").alias("number"), F.col("offset").cast("long").alias("offset"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("own"))
    own = F.sha2(F.concat_ws(":", F.lit("leaf"), F.coalesce("offset", F.lit(-1)), "size", "own"), 256)
    same = each.withColumn("hash", own).groupBy("file", "number", "offset", "size", "hash").agg(F.count(F.lit(1)).alias("times"))
    many = F.concat_ws(":", F.transform(F.array_sort(F.collect_list(F.struct("hash", "times"))), lambda x: F.concat_ws("x", x["hash"], x["times"].cast("string"))))
    rows = same.where("number is not null").groupBy("file", "number").agg(F.min("offset").alias("offset"), F.sum(F.col("size") * F.col("times")).alias("size"), many.alias("all"))
    return rows.select("file", "number", "offset", "size", F.sha2(F.concat_ws(":", F.lit("record"), "all"), 256).alias("hash"))


def levels_up(below: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes over ``file``, ``node``, ``hash``: each hashes its at most ``fanout`` children in order."""
    child = F.struct(F.col("node").alias("node"), F.col("hash").alias("hash"))
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws("=", x["node"].cast("string"), x["hash"])))
    return below.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(F.sha2(F.concat_ws(":", F.lit("node"), text), 256).alias("hash")).select("file", F.col("up").alias("node"), "hash")


def tree(leaf_rows: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a replica's trees from leaves to roots, each written once."""
    out = [leaf_rows.select("file", F.col("number").alias("node"), "hash")]
    for _ in range(height):
        out.append(written(levels_up(out[-1], fanout), "tree"))
    return out


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ: ``file``, ``number``, ``offset``, ``size``, ``fault``.

    Both: ``file``, ``number`` (order of the record in its file, from 0 or
    more), ``offset``, ``data``.  ``fault``: ``missing`` (not in the second),
    ``extra`` (not in the first), ``length`` or ``content``; offset and size
    are those of the first, of the second for extra records.  A null file is
    the file ''; records without number cannot be placed and take no part.  An
    empty replica lacks all records of the other.  Other columns are left out.
    """
    replicas = [written(leaves(r), "leaves") for r in (first, second)]
    top = max((r.agg(F.max("number")).first()[0] or 0) for r in replicas)
    height = 1
    while fanout**height <= top:
        height += 1
    trees = [tree(r, height, fanout) for r in replicas]
    # roots that differ, then level by level the children of nodes that differ
    suspects = None
    for level in range(height, 0, -1):
        a, b = trees[0][level], trees[1][level]
        if suspects is not None:
            a, b = (t.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(suspects, ["file", "up"], "left_semi").select("file", "node", "hash") for t in (a, b))
        both = a.withColumnRenamed("hash", "one").join(b.withColumnRenamed("hash", "two"), ["file", "node"], "full_outer")
        suspects = written(both.where("not (one <=> two)").select("file", F.col("node").alias("up")), "suspects")
    held = [r.withColumn("up", F.floor(F.col("number") / fanout).cast("long")).join(suspects, ["file", "up"], "left_semi") for r in replicas]
    one = held[0].select("file", "number", F.col("offset").alias("offset_1"), F.col("size").alias("size_1"), F.col("hash").alias("hash_1"))
    two = held[1].select("file", "number", F.col("offset").alias("offset_2"), F.col("size").alias("size_2"), F.col("hash").alias("hash_2"))
    both = one.join(two, ["file", "number"], "full_outer").where("not (hash_1 <=> hash_2)")
    fault = F.when(F.col("hash_2").isNull(), "missing").when(F.col("hash_1").isNull(), "extra").when(F.col("size_1") != F.col("size_2"), "length").otherwise("content")
    return both.select("file", "number", F.when(F.col("hash_1").isNull(), F.col("offset_2")).otherwise(F.col("offset_1")).alias("offset"), F.when(F.col("hash_1").isNull(), F.col("size_2")).otherwise(F.col("size_1")).alias("size"), fault.alias("fault"))
