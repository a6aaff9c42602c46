"""Interpolated Kneser-Ney character models over the words of documents.

A text is a sequence of words, and a word is a string of characters behind a
start mark, so contexts never reach over what stands before the mark.  Each
block of documents looks at its distinct words once.  The models are estimated
with DataFrame operations from n-gram counts of all blocks; every distinct
n-gram of the corpus then gets its log10 probability under every model, kept
in hash-range shards as sorted hash arrays.  Blocks ask the shards for their
distinct n-grams and add up the answers for each document, so no task holds a
whole model and a frequent n-gram is one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import BLOCK_BYTES, by_frequency, each_block, gaps_in_runs, give_back, hash_ranges, pack, pack_sorted, runs_of_gaps, starts_of, sums_of_runs, take_runs, unpack, unpack_sorted
from tablewise.llm.shared import written

#: Stands before every word; no text character is taken for it.
START = "\x02"
SEED = 42
#: n-grams of a row: a block's go on in several rows.
ROW_GRAMS = 8_192
#: n-grams that all blocks together ask of a shard at most, on average; shards grow in number with the corpus.
SHARD_GRAMS = 4_000_000
#: Class of the documents told by their ids.
LEARNED = "learned"


class Coded(NamedTuple):
    """The texts of a block: distinct strings, which begin with START; the strings of each unit one after the
    other with their number; the unit at every position; the number of positions of each text."""

    strings: list[str]
    parts: np.ndarray
    n_parts: np.ndarray
    at: np.ndarray
    lengths: np.ndarray


Cut = Callable[[list], Coded]


def grams_of(strings: list[str], lead: int, order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct n-grams that end at the predicted characters, the n-gram at each, and how many each string has.

    The first ``lead`` characters of a string are context only.
    """
    joined = "".join(strings)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32) + np.uint32(1)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    place = np.arange(len(points), dtype=np.int32) - np.repeat(starts_of(lengths)[:-1].astype(np.int32), lengths)
    own = points.astype(np.uint64)
    for back in range(1, order):
        own *= np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
        own[back:] ^= points[:-back] * (place[back:] >= back)
    del points
    own *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(place >= lead)
    own = own[at]
    by_hash = np.argsort(own)
    own, fresh = own[by_hash], np.ones(len(at), bool)
    fresh[1:] = own[1:] != own[:-1]
    del own
    inverse = np.empty(len(at), np.int32)
    inverse[by_hash] = np.cumsum(fresh, dtype=np.int32) - 1
    first = by_hash[fresh]
    ends = at[first]
    sizes = np.minimum(place[ends] + 1, order)
    grams = [joined[e - n : e] for e, n in zip((ends + 1).tolist(), sizes.tolist())]
    return grams, inverse, np.maximum(lengths - lead, 0)


def gram_hash(gram: Column) -> Column:
    return F.xxhash64(gram)


def _key_of(table: pa.Table, coded: Coded) -> int:
    key = xxhash.xxh64("\n".join(coded.strings).encode())
    for numbers in (coded.parts, coded.n_parts, coded.at, coded.lengths):
        key.update(np.ascontiguousarray(numbers).tobytes())
    for name in table.column_names:
        if name != "text":
            key.update(str(table.column(name).to_pylist()).encode())
    return key.intdigest() - 2**63


def _ids_key(table: pa.Table) -> int:
    return xxhash.xxh64(str(table.column("doc_id").to_pylist()).encode()).intdigest() - 2**63


def learning_places(rows: DataFrame, learned: DataFrame, block_bytes: int = BLOCK_BYTES) -> dict[int, bytes]:
    """For the doc_ids of each block a bit for each document, set where its id is among ``learned`` (``doc_id``, none twice).

    Only ids are shuffled, and a bit a document comes to the driver and goes to
    the tasks, so neither texts are moved nor ids held in one place.
    """

    def list_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc_id").combine_chunks()
        full = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False)).astype(np.int32)
        # the first row stands for the block itself, which may have no ids
        at = np.concatenate([np.array([-1], np.int32), full])
        yield pa.record_batch([pa.array(np.full(len(at), _ids_key(table))), pa.array(at), pa.concat_arrays([pa.nulls(1, pa.int64()), ids.drop_null()])], names=["block", "at", "doc_id"])

    def list_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, list_block, block_bytes)

    def as_bits(found: pa.Table) -> pa.Table:
        at = found.filter(found.column("learned")).column("at").to_numpy()
        bits = np.zeros(int(at.max()) + 1 if len(at) else 0, np.uint8)
        bits[at] = 1
        return pa.table({"block": found.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    # no texts: their lengths cut the same blocks
    places = rows.select("doc_id", F.octet_length("text").alias("text")).mapInArrow(list_ids, "block long, at int, doc_id long")
    found = places.join(learned.select("doc_id", F.lit(True).alias("learned")), "doc_id", "left").select("block", "at", F.coalesce("learned", F.lit(False)).alias("learned"))
    return {r["block"]: bytes(r["bits"]) for r in found.groupBy("block").applyInArrow(as_bits, "block long, bits binary").collect()}  # one row per block


def block_grams(rows: DataFrame, cut: Cut, lead: int, order: int, block_bytes: int = BLOCK_BYTES, learning: dict[int, bytes] | None = None) -> DataFrame:
    """For each block its distinct n-grams in order of their hashes (``class`` null, no counts) and, for each class
    of its learning documents, the n-grams they hold with counts; ``part`` numbers the rows of each.

    ``rows``: ``text``, ``class`` (null: not learned from) and what else tells documents apart.  ``learning`` (from
    :func:`learning_places`) takes the place of ``class``; what it marks is of class ``LEARNED``.
    """

    def classes_of(table: pa.Table) -> list[str | None]:
        if learning is None:
            return table.column("class").to_pylist()
        bits = learning.get(_ids_key(table))
        if bits is None:
            raise ValueError("a block of documents was read in two different orders")
        return [LEARNED if x else None for x in np.unpackbits(np.frombuffer(bits, np.uint8), count=table.num_rows).tolist()]

    def count_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = cut(table.column("text").to_pylist())
        grams, inverse, sizes = grams_of(coded.strings, lead, order)
        block = _key_of(table, coded)

        def in_rows(name: str | None, own: list[str], n: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for part, k in enumerate(range(0, max(len(own), 1), ROW_GRAMS)):
                some = slice(k, k + ROW_GRAMS)
                yield pa.record_batch(
                    [[block], pa.array([part], pa.int32()), pa.array([name], pa.string()), pa.array([own[some]], pa.list_(pa.string())), pa.array([[] if n is None else n[some]], pa.list_(pa.int64()))],
                    names=["block", "part", "class", "grams", "n"],
                )

        yield from in_rows(None, [grams[i] for i in np.argsort(_keys(grams)).tolist()], None)
        classes = classes_of(table)
        unit = np.repeat(np.arange(len(coded.n_parts)), coded.n_parts)
        for name in sorted({c for c in classes if c is not None}):
            mine = np.repeat(np.array([c == name for c in classes], bool), coded.lengths)
            by_unit = np.bincount(coded.at[mine], minlength=len(coded.n_parts))
            by_string = np.bincount(coded.parts, by_unit[unit], len(coded.strings))
            n = np.bincount(inverse, np.repeat(by_string, sizes), len(grams)).astype(np.int64)
            full = np.flatnonzero(n)
            yield from in_rows(name, [grams[i] for i in full.tolist()], n[full])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, count_block, block_bytes)

    return rows.mapInArrow(count, "block long, part int, class string, grams array<string>, n array<long>")


def counts_of(blocks: DataFrame) -> DataFrame:
    """``class``, ``gram``, ``n`` over all blocks."""
    pairs = blocks.where("class is not null").select("class", F.explode(F.arrays_zip("grams", "n")).alias("g"))
    return pairs.select("class", F.col("g.grams").alias("gram"), F.col("g.n").alias("n")).groupBy("class", "gram").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, order: int, modified: bool) -> tuple[DataFrame, DataFrame]:
    """Kneser-Ney parts of every n-gram and context.

    Result: (``class``, ``gram``, ``own``): the discounted share of a character
    in its context; (``class``, ``context``, ``rest``): what a context leaves to
    the next shorter one.  N-grams of the full order and those behind the start
    mark have their counts, shorter ones the number of different characters
    before them.  ``modified``: three discounts by count, else one.
    """
    full = counts.select("class", "gram", F.col("n").cast("double").alias("c"))
    suffix = F.expr("filter(transform(sequence(1, greatest(length(gram) - 1, 1)), i -> substr(gram, i + 1)), s -> s <> '')")
    shorter = counts.select("class", "gram", F.explode(suffix).alias("s"))
    # the n-grams of each length that occur: those counted, and every suffix of one
    present = counts.select("class", "gram").union(shorter.select("class", F.col("s").alias("gram"))).distinct()
    extended = present.where(F.length("gram") > 1).select("class", F.expr("substr(gram, 2)").alias("gram")).groupBy("class", "gram").agg(F.count(F.lit(1)).cast("double").alias("c"))
    grams = full.union(extended).withColumn("k", F.length("gram")).withColumn("context", F.expr("left(gram, k - 1)"))
    tallies = grams.groupBy("class", "k").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    y = F.least(F.greatest(y, F.lit(0.05)), F.lit(0.95))
    steps = [F.greatest(F.lit(0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), y)) if modified else y for i in (1, 2, 3)]
    discounts = tallies.select("class", "k", *[F.least(s, F.lit(0.95 * i)).alias(f"d{i}") for i, s in zip((1, 2, 3), steps)])
    cut = grams.join(F.broadcast(discounts), ["class", "k"]).withColumn("d", F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") >= 2, F.col("d2")).otherwise(F.col("d1")))
    contexts = cut.groupBy("class", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("cut"))
    own = cut.join(contexts, ["class", "context"]).select("class", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"))
    return own, contexts.select("class", "context", (F.col("cut") / F.col("total")).alias("rest"))


def _by_class(table: DataFrame, key: str, value: str, classes: list[str], missing: float) -> DataFrame:
    held = [F.coalesce(F.max(F.when(F.col("class") == c, F.col(value))), F.lit(missing)) for c in classes]
    return table.groupBy(key).agg(F.array(*held).alias(value))


def log_probabilities(grams: DataFrame, counts: DataFrame, classes: list[str], order: int, modified: bool) -> DataFrame:
    """``gram``, ``logs`` (array of float, one per class): log10 probability of its last character.

    Level by level from single characters up: an n-gram takes its own share and
    what its context leaves to the n-gram without its first character.
    """
    own, rest = estimate(counts, order, modified)
    n = counts.count()
    own = written(_by_class(own, "gram", "own", classes, 0.0), "own", n)
    rest = written(_by_class(rest, "context", "rest", classes, 1.0), "rest", n)
    letters = counts.select("class", F.expr("right(gram, 1)").alias("ch")).distinct().groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    uniform = {r["class"]: 1.0 / (r["n"] + 1) for r in letters}
    each = grams.select(F.explode(F.expr("transform(sequence(1, length(gram)), k -> struct(right(gram, k) as gram, k = length(gram) as asked))")).alias("s")).select("s.*")
    present = written(each.groupBy("gram").agg(F.max("asked").alias("asked")), "suffixes")
    of_length = dict(present.groupBy(F.length("gram")).count().collect())  # one row per length
    below = F.array(*[F.lit(uniform.get(c, 1.0)) for c in classes])
    missing = {"own": F.array(*[F.lit(0.0)] * len(classes)), "rest": F.array(*[F.lit(1.0)] * len(classes))}
    first = rest.where("context = ''").first()  # one row
    levels, lower = [], None
    for k in range(1, order + 1):
        rows = present.where(F.length("gram") == k).join(own.where(F.length("gram") == k), "gram", "left").withColumn("own", F.coalesce("own", missing["own"]))
        if k == 1:
            rows = rows.withColumn("rest", F.array(*[F.lit(x) for x in first["rest"]]) if first else missing["rest"]).withColumn("p_below", below)
        else:
            rows = rows.withColumn("context", F.expr(f"left(gram, {k - 1})")).join(rest.where(F.length("context") == k - 1), "context", "left").withColumn("rest", F.coalesce("rest", missing["rest"]))
            shorter = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            rows = rows.withColumn("suffix", F.expr(f"right(gram, {k - 1})")).join(shorter, "suffix")
        p = F.zip_with(F.col("own"), F.zip_with("rest", "p_below", lambda x, y: x * y), lambda x, y: x + y)
        lower = written(rows.select("gram", "asked", p.alias("p")), "level", of_length.get(k, 0))
        levels.append(lower.where("asked").select("gram", F.transform("p", lambda x: F.log10(x).cast("float")).alias("logs")))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def _answers(model: pa.Table, asked: pa.Table) -> pa.Table:
    """Look the hashes that each block asks for up in the sorted hash array of one shard."""
    keys = model.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    logs = np.array(model.column("logs").combine_chunks().flatten(), np.float32).reshape(len(keys), -1)[order]
    values = []
    for data in asked.column("keys").to_pylist():
        own = unpack_sorted(data)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        if not np.array_equal(keys[at], own):
            raise ValueError("an n-gram has no entry in its shard")
        values.append(logs[at].tobytes())
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "part": asked.column("part"), "logs": pa.array(values, pa.binary())})


def scores(rows: DataFrame, cut: Cut, lead: int, order: int, modified: bool, block_bytes: int = BLOCK_BYTES, learned: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Log10 probability of each whole text under the model of each class, and the classes.

    ``rows``: ``doc_id``, ``text``, ``class`` (string, null: not learned from)
    and further columns, which are kept.  The result has them without ``text``,
    ``class``, with ``logs`` (array of double by class) and ``chars`` (predicted characters).
    ``learned`` (``doc_id``, none twice), instead of ``class``: the ids of all documents of the one class.
    """
    spark = rows.sparkSession
    learning = learning_places(rows, learned, block_bytes) if learned is not None else None
    blocks = written(block_grams(rows, cut, lead, order, block_bytes, learning), "grams")
    counts = written(counts_of(blocks), "counts")
    classes = sorted(r["class"] for r in counts.select("class").distinct().collect())  # one row per language or kind
    every = blocks.where("class is null")
    n_shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(every.count() * ROW_GRAMS / SHARD_GRAMS))
    grams = every.select(F.explode("grams").alias("gram")).distinct()
    model = log_probabilities(grams, counts, classes, order, modified).select(gram_hash(F.col("gram")).alias("key"), "logs")
    model = model.withColumn("shard", F.shiftright(F.shiftrightunsigned("key", 32) * n_shards, 32).cast("int"))  # equal ranges of hashes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, own in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "grams"))):
                keys = np.sort(_keys(own))
                cuts = hash_ranges(keys, n_shards)
                yield pa.record_batch(
                    [pa.array([block] * len(cuts), pa.int64()), pa.array([c for c, _, _ in cuts], pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([pack_sorted(keys[a:b]) for _, a, b in cuts], pa.binary())],
                    names=["block", "shard", "part", "keys"],
                )

    asked = every.select("block", "part", "grams").mapInArrow(ask, "block long, shard int, part int, keys binary").dropDuplicates(["block", "shard", "part"])  # equal blocks ask once
    answers = model.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_answers, "block long, shard int, part int, logs binary")
    kept = [f for f in rows.schema.fields if f.name not in ("text", "class")]
    names = [f.name for f in kept]

    def place_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        coded = cut(table.column("text").to_pylist())
        used, at = by_frequency(coded.at, len(coded.n_parts))
        parts = take_runs(coded.parts, starts_of(coded.n_parts)[:-1][used], coded.n_parts[used])
        # strings in order of first use: then their numbers mostly count up
        held, firsts = np.unique(parts, return_index=True)
        order_ = held[np.argsort(firsts)]
        number = np.zeros(len(coded.strings), np.uint32)
        number[order_] = np.arange(len(order_), dtype=np.uint32)
        parts = number[parts]
        text = zstandard.ZstdCompressor(level=3).compress("".join([coded.strings[i] for i in order_.tolist()]).encode())
        # a sum needs no order of a text's units
        packed = [parts.astype(np.uint32), coded.n_parts[used].astype(np.uint32), gaps_in_runs(at, coded.lengths), coded.lengths.astype(np.int64)]
        yield pa.record_batch(
            [pa.array([_key_of(table, coded)], pa.int64()), pa.array([text], pa.binary()), *[pa.array([pack(x)], pa.binary()) for x in packed], *[pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in names]],
            names=["block", "strings", "parts", "n_parts", "at", "lengths", *[f"c_{c}" for c in names]],
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, place_block, block_bytes)

    n_classes = len(classes)

    def add_up(places: pa.Table, answered: pa.Table) -> pa.Table:
        # parts and shards both follow the order of the hashes
        replies = sorted(zip(*(answered.column(c).to_pylist() for c in ("shard", "part", "logs"))))
        flat = np.frombuffer(b"".join(x for *_, x in replies), np.float32).reshape(-1, max(n_classes, 1)).astype(np.float64)
        # in steps of 2^-24 sums are exact below 2^29, so equal texts have equal sums in every block
        flat = np.rint(flat * 2.0**24) / 2.0**24
        out = []
        for place_ in places.to_pylist():
            strings = [START + x for x in zstandard.ZstdDecompressor().decompress(place_["strings"]).decode().split(START)[1:]]
            grams, inverse, sizes = grams_of(strings, lead, order)
            if n_classes and len(grams) != len(flat):
                raise ValueError("a block of documents was read in two different orders")
            number = np.empty(len(grams), np.int64)
            number[np.argsort(_keys(grams))] = np.arange(len(grams))
            chars, string_starts = number[inverse], starts_of(sizes)
            parts, unit_starts = unpack(place_["parts"], np.uint32), starts_of(unpack(place_["n_parts"], np.uint32))
            lengths = unpack(place_["lengths"], np.int64)
            at, starts = runs_of_gaps(unpack(place_["at"], np.uint32), lengths), starts_of(lengths)
            per_unit = sums_of_runs(sizes[parts], unit_starts)
            logs = [sums_of_runs(sums_of_runs(sums_of_runs(flat[chars, c], string_starts)[parts], unit_starts)[at], starts) for c in range(n_classes)]
            stacked = np.stack(logs, axis=1).ravel() if n_classes else np.zeros(0)
            out.append(
                pa.table(
                    {
                        **{c: pa.array(place_[f"c_{c}"], places.schema.field(f"c_{c}").type.value_type) for c in names},
                        "logs": pa.ListArray.from_arrays(np.arange(len(starts), dtype=np.int32) * n_classes, stacked),
                        "chars": sums_of_runs(per_unit[at], starts),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({**{c: pa.array([], places.schema.field(f"c_{c}").type.value_type) for c in names}, "logs": pa.array([], pa.list_(pa.float64())), "chars": pa.array([], pa.int64())})

    def added(places: pa.Table, answered: pa.Table) -> pa.Table:
        out = add_up(places, answered)
        give_back()
        return out

    places = rows.mapInArrow(place, "block long, strings binary, parts binary, n_parts binary, at binary, lengths binary, " + ", ".join(f"c_{f.name} array<{f.dataType.simpleString()}>" for f in kept))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", logs array<double>, chars long"
    return places.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(added, schema), classes


def _keys(grams: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams), np.uint64, len(grams))
