"""Operator 3: language-model scoring by deleted interpolation.

Method: n-gram maximum-likelihood estimates of all orders are mixed from the
longest down, p_k = l_k * c(context, word) / c(context) + (1 - l_k) * p_(k-1),
ending in a uniform share for every known word and one for the unknown.  Each
l_k depends on the frequency bucket of its context.  The weights are learned by
expectation-maximisation on a part of the learning documents, against counts
from which that part is deleted; scoring uses the counts of all of them.

Words and n-grams are known by 64-bit hashes.  Each block of documents sends
the sorted hashes of its distinct n-grams, with its own counts, to the range
bucket of each hash; a bucket adds up the counts of all blocks and returns the
sums to the blocks that asked.  An n-gram that every document holds is one
entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import BLOCK_BYTES, by_frequency, code_words, each_block, hash_ranges, pack, pack_sorted, starts_of, sums_of_runs, unpack, unpack_sorted
from tablewise.llm.shared import written

#: Text bytes for each bucket of an order; a bucket is merged in one task.
BUCKET_BYTES = 8_000_000
#: One learning document in this many is deleted from the counts to learn the weights.
HELD_EVERY = 10
ROUNDS = 12
#: Context frequencies 0, 1, 2-3, 4-7, ...: the last bucket takes all above.
FREQUENCY_BUCKETS = 24


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


END, BEGIN = _hash(b" end"), _hash(b" begin")  # words hold no blank, so no word has these keys


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a longer n-gram from that of its context and its last word."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, each with its end, and where each text starts."""
    words, codes, lengths = code_words(t.lower() if t else None for t in table.column("text").cast(pa.binary()).to_pylist())
    hashes = np.fromiter(map(_hash, words), np.uint64, len(words))
    starts = starts_of(lengths + 1)
    out = np.full(int(starts[-1]), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts[1:] - 1] = False
    out[inner] = hashes[codes]
    return out, starts


def grams_of(sequence: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order up to ``order`` the hash of the n-gram that ends at every position."""
    out = [sequence]
    for k in range(2, order + 1):
        before = np.empty_like(sequence)
        before[1:] = out[-1][:-1]
        # the context of a first word holds begin marks only
        mark = np.uint64(BEGIN)
        for _ in range(k - 2):
            mark = _mixed(np.array([mark], np.uint64), np.array([BEGIN], np.uint64))[0]
        before[starts[:-1]] = mark
        out.append(_mixed(before, sequence))
    return out


def _block_key(table: pa.Table, sequence: np.ndarray, starts: np.ndarray) -> int:
    key = xxhash.xxh64(sequence.tobytes())
    key.update(starts.tobytes())
    for name in ("doc_id", "learns", "held"):
        key.update(str(table.column(name).to_pylist()).encode())
    return key.intdigest() - 2**63


def frequency_bucket(count: Column) -> Column:
    """0 for an unseen context, then one bucket for each power of two."""
    return F.when(count > 0, F.least(F.floor(F.log2(count + F.lit(0.5))) + 1, F.lit(FREQUENCY_BUCKETS - 1))).otherwise(0).cast("int")


def _bucket_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.floor(np.log2(count + 0.5)) + 1, FREQUENCY_BUCKETS - 1), 0).astype(np.int64)


ASKED = "block long, grams int, bucket int, keys binary, counts binary, held_counts binary"
REPLY = "block long, grams int, bucket int, counts binary, held_counts binary, types long, tokens long, held_tokens long"
PLACES = "block long, doc_id array<long>, held_out array<boolean>, words binary, starts binary"


def _asked(rows: DataFrame, order: int, n_buckets: int, block_bytes: int, counting: bool) -> DataFrame:
    """Distinct n-grams of each block by bucket, with their counts if ``counting``, else only asking for them."""

    def ask_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sequence, starts = sequence_of(table)
        block = _block_key(table, sequence, starts)
        lengths = np.diff(starts)
        learns = np.repeat(np.array(table.column("learns").to_pylist(), bool), lengths)
        held = np.repeat(np.array(table.column("held").to_pylist(), bool), lengths)
        for k, grams in enumerate(grams_of(sequence, starts, order), 1):
            keys, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(at[learns] if counting else at[:0], minlength=len(keys)).astype(np.uint32)
            held_counts = np.bincount(at[held] if counting else at[:0], minlength=len(keys)).astype(np.uint32)
            cuts = hash_ranges(keys, n_buckets)
            yield pa.record_batch(
                [
                    pa.array([block] * len(cuts), pa.int64()), pa.array([k] * len(cuts), pa.int32()), pa.array([c for c, _, _ in cuts], pa.int32()),
                    pa.array([pack_sorted(keys[a:b]) for _, a, b in cuts], pa.binary()), pa.array([pack(counts[a:b]) for _, a, b in cuts], pa.binary()),
                    pa.array([pack(held_counts[a:b]) for _, a, b in cuts], pa.binary()),
                ],
                names=["block", "grams", "bucket", "keys", "counts", "held_counts"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, ask_block, block_bytes)

    return rows.mapInArrow(ask, ASKED)


def _summed(asked: pa.Table) -> pa.Table:
    """Sums over all blocks of one bucket, for the n-grams of each block; and one row with the bucket's totals."""
    keys = [unpack_sorted(x) for x in asked.column("keys").to_pylist()]
    ends = np.cumsum([len(x) for x in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = {}
    for name in ("counts", "held_counts"):
        own = np.concatenate([unpack(x, np.uint32) for x in asked.column(name).to_pylist()])
        out[name] = np.bincount(at, own, len(distinct)).astype(np.uint64)
    grams, bucket = asked.column("grams")[0].as_py(), asked.column("bucket")[0].as_py()
    n = asked.num_rows
    spread = {name: [pack(out[name][at[b - len(x):b]]) for x, b in zip(keys, ends)] for name in out}
    return pa.table(
        {
            "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()), "grams": pa.array([grams] * (n + 1), pa.int32()), "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "counts": pa.array([*spread["counts"], None], pa.binary()), "held_counts": pa.array([*spread["held_counts"], None], pa.binary()),
            "types": pa.array([None] * n + [int((out["counts"] > 0).sum())], pa.int64()), "tokens": pa.array([None] * n + [int(out["counts"].sum())], pa.int64()),
            "held_tokens": pa.array([None] * n + [int(out["held_counts"].sum())], pa.int64()),
        }
    )


def _placed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: its documents and the hashes of their words in order."""

    def place_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        sequence, starts = sequence_of(table)
        words, codes = np.unique(sequence, return_inverse=True)
        order, codes = by_frequency(codes, len(words))
        packed = len(words).to_bytes(8, "little") + words[order].tobytes() + pack(codes)
        yield pa.record_batch(
            [
                pa.array([_block_key(table, sequence, starts)], pa.int64()), pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([table.column("held_out").to_pylist()], pa.list_(pa.bool_())), pa.array([packed], pa.binary()), pa.array([pack(starts)], pa.binary()),
            ],
            names=["block", "doc_id", "held_out", "words", "starts"],
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, place_block, block_bytes)

    return rows.mapInArrow(place, PLACES)


def _counts_at(place: dict, replies: list[dict], order: int, name: str):
    """Start of each text and, for each order, the count of the n-gram at every position."""
    n = int.from_bytes(place["words"][:8], "little")
    words = np.frombuffer(place["words"], np.uint64, n, 8)
    sequence, starts = words[unpack(place["words"][8 + 8 * n:], np.uint32)], unpack(place["starts"], np.int64)
    out = []
    for k, grams in enumerate(grams_of(sequence, starts, order), 1):
        keys, at = np.unique(grams, return_inverse=True)
        own = sorted((r for r in replies if r["grams"] == k), key=lambda r: r["bucket"])
        counts = {r["bucket"]: r for r in own}  # equal blocks get equal replies
        flat = np.concatenate([unpack(r[name], np.uint64) for r in counts.values()])
        if len(flat) != len(keys):
            raise ValueError("a block of documents was read in two different orders")
        out.append(flat[at].astype(np.int64))
    return starts, out


def _contexts(counts: list[np.ndarray], starts: np.ndarray, tokens: int, texts: int) -> list[np.ndarray]:
    """How often the context of each order was seen, at every position."""
    out = [np.full(len(counts[0]), tokens, np.int64)]
    for before in counts[:-1]:
        seen = np.empty_like(before)
        seen[1:] = before[:-1]
        seen[starts[:-1]] = texts
        out.append(seen)
    return out


def learn_weights(tuples: DataFrame, order: int, types: int, rounds: int = ROUNDS) -> dict[tuple[int, int], float]:
    """Weight of each (order, context bucket) by expectation-maximisation.

    ``tuples``: ``c_k`` and ``x_k`` (counts of n-gram and context with the
    held-out part deleted) for each order k, and ``n`` held-out tokens that have them.
    """
    weights = {(k, b): 0.5 if b else 0.0 for k in range(1, order + 1) for b in range(FREQUENCY_BUCKETS)}
    for k in range(1, order + 1):
        tuples = tuples.withColumn(f"b_{k}", frequency_bucket(F.col(f"x_{k}")))
    columns = [c for k in range(1, order + 1) for c in (f"c_{k}", f"x_{k}", f"b_{k}")]
    tuples = written(tuples.groupBy(*columns).agg(F.sum("n").alias("n")), "held")
    for _ in range(rounds):
        parts, rest = {}, F.lit(1.0)
        for k in range(order, 0, -1):
            weight = F.element_at(F.array(*[F.lit(weights[k, b]) for b in range(FREQUENCY_BUCKETS)]), F.col(f"b_{k}") + 1)
            parts[k] = rest * weight * F.coalesce(F.try_divide(F.col(f"c_{k}").cast("double"), F.col(f"x_{k}")), F.lit(0.0))
            rest = rest * (1 - weight)
        parts[0] = rest * F.lit(1.0 / (types + 1))
        total = sum((parts[k] for k in range(1, order + 1)), parts[0])
        shares = tuples.select("n", *[f"b_{k}" for k in range(1, order + 1)], total.alias("p"), *[parts[k].alias(f"r_{k}") for k in range(order + 1)]).where("p > 0")
        lower = {k: sum((F.col(f"r_{j}") for j in range(1, k + 1)), F.col("r_0")) for k in range(1, order + 1)}
        rows = shares.select(F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), F.col(f"b_{k}").alias("b"), (F.col("n") * F.col(f"r_{k}") / F.col("p")).alias("own"), (F.col("n") * lower[k] / F.col("p")).alias("both"))
            for k in range(1, order + 1)
        ])).alias("s")).select("s.*")
        for r in rows.groupBy("k", "b").agg(F.sum("own").alias("own"), F.sum("both").alias("both")).collect():  # order x buckets rows
            if r["both"]:
                weights[r["k"], r["b"]] = r["own"] / r["both"] if r["b"] else 0.0
    return weights


def score(docs: DataFrame, learns: Column, held_out: Column, order: int = 2, held_every: int = HELD_EVERY, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score all whole texts of ``docs`` by a model of those for which ``learns`` holds.

    Result, one row per input row: ``doc_id``, ``held_out`` (as given),
    ``n_tokens``, ``n_known`` (tokens seen in learning), ``train_tokens``,
    ``base_score`` (log10 by add-half word counts) and ``score`` (log10 by the
    mixture).  A null text counts as empty: it has its end as only token.
    Repeated rows stay and count as often.  Without anything to learn every
    token has the uniform probability 1.  An empty table gives an empty result.
    """
    if order < 1:
        raise ValueError("order is at least 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"), learns.alias("learns"))
    is_held = F.col("learns") & (F.pmod(F.xxhash64("doc_id"), F.lit(held_every)) == 0)
    rows = rows.withColumn("held", is_held)
    size, texts, held_texts = rows.agg(F.sum(F.octet_length("text") + 1), F.count_if("learns"), F.count_if("held")).first()
    n_buckets = max(4, ceil((size or 0) / BUCKET_BYTES))
    held_rows = rows.where("held")
    asked = _asked(rows, order, n_buckets, block_bytes, True).union(_asked(held_rows, order, n_buckets, block_bytes, False))
    replies = written(asked.groupBy("grams", "bucket").applyInArrow(_summed, REPLY), "counts")
    types, tokens, held_tokens = replies.where("grams = 1 and block is null").agg(F.sum("types"), F.sum("tokens"), F.sum("held_tokens")).first()
    types, tokens, held_tokens = types or 0, tokens or 0, held_tokens or 0
    counts = replies.where("block is not null").select("block", "grams", "bucket", "counts", "held_counts")
    kept_tokens, kept_texts = tokens - held_tokens, texts - held_texts

    def tuples_of(places: pa.Table, replied: pa.Table) -> pa.Table:
        seen = []
        fetched = replied.to_pylist() if places.num_rows else []
        for place in places.to_pylist():
            starts, full = _counts_at(place, fetched, order, "counts")
            _, held = _counts_at(place, fetched, order, "held_counts")
            kept = [a - b for a, b in zip(full, held)]
            seen.append(np.stack([*kept, *_contexts(kept, starts, kept_tokens, kept_texts)], axis=1))
        distinct, n = np.unique(np.concatenate(seen), axis=0, return_counts=True) if seen else (np.zeros((0, 2 * order), np.int64), np.zeros(0, np.int64))
        names = [f"c_{k + 1}" for k in range(order)] + [f"x_{k + 1}" for k in range(order)]
        return pa.table({**{name: distinct[:, i] for i, name in enumerate(names)}, "n": n.astype(np.int64)})

    schema = ", ".join([f"c_{k} long" for k in range(1, order + 1)] + [f"x_{k} long" for k in range(1, order + 1)] + ["n long"])
    tuples = _placed(held_rows, block_bytes).groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(tuples_of, schema)
    weights = learn_weights(tuples, order, types, rounds)
    table = np.array([[weights[k, b] for b in range(FREQUENCY_BUCKETS)] for k in range(1, order + 1)])

    def scored(places: pa.Table, replied: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        fetched = replied.to_pylist() if places.num_rows else []
        for place in places.to_pylist():
            starts, full = _counts_at(place, fetched, order, "counts")
            p = np.full(len(full[0]), 1.0 / (types + 1))
            for k, (own, seen) in enumerate(zip(full, _contexts(full, starts, tokens, texts))):
                weight = table[k][_bucket_of(seen)]
                p = weight * own / np.maximum(seen, 1) + (1 - weight) * p
            base = np.log10((full[0] + 0.5) / (tokens + 0.5 * (types + 1)))
            for name, values in (("doc_id", place["doc_id"]), ("held_out", place["held_out"]), ("n_tokens", np.diff(starts).tolist()), ("n_known", sums_of_runs((full[0] > 0).astype(np.int64), starts).tolist()), ("base_score", sums_of_runs(base, starts).tolist()), ("score", sums_of_runs(np.log10(p), starts).tolist())):
                out[name] += values
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    result = _placed(rows, block_bytes).groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
