"""Operator 2: near-duplicates by SimHash fingerprints and multi-index hashing.

Method: a fingerprint holds 64 bits, cut into two segments of 32.  Two
fingerprints that differ in at most 3 bits differ in at most 1 bit in one of
the segments, so each distinct fingerprint looks up, in the table of each
segment, its own segment value and the values one bit away (a Hamming ball of
radius 1), and the complete distance of every match is verified.  Of two values
one bit apart exactly one has the bit unset; only that one looks up the other,
which halves the ball and loses no pair.

Copies of one fingerprint are grouped first, so a group of copies of any size
is one entry of the tables.  Links are grouped to components with labels that
move along links and along each other until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import give_back
from tablewise.llm.shared import row_key, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Shingles hashed and added up at a time.
STEP = 65_536
#: Texts of a batch that are Python objects at a time.
TEXTS = 256


def fingerprint_of(text: str | bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one whole text; 0 where it has no word."""
    raw = text.encode() if isinstance(text, str) else text or b""
    tokens = raw.lower().split()  # bytes: lower-cases A-Z, splits at blank and \t to \r
    if not tokens:
        return 0
    shingles = map(b" ".join, zip(*(islice(tokens, k, None) for k in range(words)))) if len(tokens) >= words else iter((b" ".join(tokens),))
    total, counts = 0, np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while True:
        part = np.fromiter(islice(hashes, STEP), np.uint64)
        if not len(part):
            break
        total += len(part)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, key: str = "doc_id") -> DataFrame:
    """``key`` (any type; a doc_id as long), ``fingerprint`` (long with the 64 bits) for every row; a null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            parts = (texts.slice(k, TEXTS).to_pylist() for k in range(0, len(texts), TEXTS))
            prints = np.fromiter((fingerprint_of(t, words) for part in parts for t in part), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=[key, "fingerprint"])
        give_back()

    rows = docs.select((F.col(key).cast("long") if key == "doc_id" else F.col(key)).alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(hashed, f"`{key}` {rows.schema[key].dataType.simpleString()}, fingerprint long")


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _segment(fingerprint: Column, number: int) -> Column:
    return F.shiftrightunsigned(fingerprint, 32 * number).bitwiseAND(0xFFFFFFFF)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at most ``max_bits`` (0 to 3) apart, each once.

    ``prints``: one ``fingerprint`` column without repeats.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius 1 find pairs up to 3 bits apart")
    fingerprint = F.col("fingerprint")
    table = prints.select(fingerprint.alias("b"), F.posexplode(F.array(*[_segment(fingerprint, n) for n in (0, 1)])).alias("segment", "value"))
    probes = (
        prints.select(fingerprint.alias("a"), F.posexplode(F.array(*[_segment(fingerprint, n) for n in (0, 1)])).alias("segment", "own"))
        .withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(31))))
        .withColumn("value", F.when(F.col("bit") < 0, F.col("own")).otherwise(F.expr("own + shiftleft(1L, greatest(bit, 0))")))
        .where("bit < 0 or (shiftright(own, greatest(bit, 0)) & 1) = 0")
        .select("a", "segment", "value", (F.col("bit") < 0).alias("same"))
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # some thirty rows come of a fingerprint, but Spark takes them for as small as the file of fingerprints and would send all to every executor
    found = probes.hint("merge").join(table.hint("merge"), ["segment", "value"]).where(near & (~F.col("same") | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest ``label`` that each node reaches over ``edges`` (a, b).

    ``nodes``: ``node``, ``label`` with distinct labels.  Each round every root
    hooks onto the smallest label beside its tree, then all pointers jump; the
    rows of each round are written to the shared folder.  Only nodes with links
    take part in the rounds.
    """
    n = 2 * edges.count()
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other")
    pairs = written(
        both.join(nodes.withColumnRenamed("label", "from"), "node").join(nodes.toDF("other", "to"), "other").select("from", "to"), "links", n
    )
    # parent: label -> smaller label of its component; pairs: links between labels that are not yet one
    parent = written(pairs.groupBy("from").agg(F.min(F.least("from", "to")).alias("parent")).select(F.col("from").alias("label"), "parent"), "labels", n)
    n_labels = parent.count()
    while True:  # every round lowers a label or joins two trees, so the rounds end
        up = parent.select(F.col("label").alias("parent"), F.col("parent").alias("up"))
        jumped = written(parent.join(up, "parent").select("label", F.col("up").alias("parent")), "labels", n_labels)
        moved = jumped.join(parent.withColumnRenamed("parent", "old"), "label").where("parent <> old").limit(1).count()
        if moved:  # flatten the trees before looking beside them
            parent = jumped
            continue
        root = parent.select(F.col("label").alias("from"), F.col("parent").alias("from_root"))
        other = parent.select(F.col("label").alias("to"), F.col("parent").alias("to_root"))
        beside = pairs.join(root, "from").join(other, "to").where("from_root <> to_root").select(F.col("from_root").alias("from"), F.col("to_root").alias("to"))
        pairs = written(beside.distinct(), "links", n)
        hooks = pairs.groupBy("from").agg(F.min("to").alias("hook")).where("hook < from")
        if not hooks.limit(1).count():
            break
        parent = written(
            parent.join(hooks, parent["label"] == hooks["from"], "left").select("label", F.coalesce("hook", "parent").alias("parent")), "labels", n_labels
        )
    return nodes.join(parent, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))


def _labelled(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and for each distinct one the label of its component."""
    prints = written(fingerprints(docs, words), "fingerprints")
    n = prints.count()
    # a distinct fingerprint stands for all its copies; labels sort by (without id, id, fingerprint), so the
    # smallest label of a component holds its smallest doc_id
    classes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "classes", n)
    edges = written(links(classes.select("fingerprint"), max_bits), "edges")
    no_id = F.col("doc_id").isNull()
    label = F.struct(no_id.alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.when(no_id, F.col("fingerprint")).alias("fingerprint"))
    found = components(classes.select(F.col("fingerprint").alias("node"), label.alias("label")), edges)
    return prints, written(found.select(F.col("node").alias("fingerprint"), "label"), "components", n)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links of at
    most ``max_bits`` bits, the document itself included.  A null or empty text
    has fingerprint zero and links like any other.  Repeated rows stay.  A row
    whose doc_id is null keeps it and belongs to the component of its
    fingerprint; where all of a component's ids are null, so is component_id.
    An empty table gives an empty result; other columns are left out.
    """
    prints, labels = _labelled(docs, words, max_bits)
    component = F.when(~F.col("label.no_id"), F.col("label.doc_id")).alias("component_id")
    return prints.join(labels.select("fingerprint", component), "fingerprint").select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, key: str | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row with its smallest doc_id.

    Rows are told apart by ``key``, a column that differs where rows differ (by
    default 128 bits of all columns), not by doc_id: different texts under one
    doc_id, or without one, are different documents.  Rows without a doc_id
    come behind those with one; of rows with the smallest doc_id that with the
    smallest key stays, and of equal rows one.
    """
    names = docs.columns
    rows = docs.withColumn("__row", F.col(key) if key else row_key(docs))
    prints = written(fingerprints(rows, words, "__row").withColumnRenamed("__row", "row"), "fingerprints")
    n = prints.count()
    id_of = written(rows.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("id")).distinct(), "rows", n)
    label = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("doc_id"), F.col("row"))
    # a row's text follows from its key, so that no two fingerprints share a label
    classes = written(prints.distinct().join(id_of, "row").groupBy("fingerprint").agg(F.min(label).alias("label")), "classes", n)
    edges = written(links(classes.select("fingerprint"), max_bits), "edges")
    kept = components(classes.select(F.col("fingerprint").alias("node"), "label"), edges).select(F.col("label.row").alias("__row")).distinct()
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*names)
