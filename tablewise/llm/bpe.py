"""Operator 9: byte-level BPE encoding and decoding.

Method: a global shuffle of distinct pre-tokens.  Each block of documents is
cut into pre-tokens with their positions; the distinct pre-tokens of the block
go to the partition of their hash, where each distinct one is encoded once; the
ids join back by block and the documents are reassembled by position.  Decoding
looks the ids up in the token-byte table, which has one row per rank.

Only distinct pre-tokens and packed positions are shuffled, one row per block
and hash bucket, so a pre-token that every document holds costs one entry per
block.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import by_frequency, Codes, each_block, pack, split_at_blanks, starts_of, strings, sums_of_runs, take_runs, unpack

#: Text bytes of a block; encoding and decoding run side by side, so blocks are small.
BLOCK_BYTES = 4_000_000
#: Buckets per shuffle partition; several even out the partitions.
BUCKETS_PER_PARTITION = 4
#: Texts up to so many characters are cut in one call; longer ones match by match.
LONG_TEXT = 1_000_000
#: Segments matched as one string.
SEGMENTS = 2_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file (base64 bytes, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def cut(texts: pa.ChunkedArray, find) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct segments of the texts, whether each is a blank and characters without white space, their code at every place and the number of each text.

    A blank between two characters that are not white space always begins a
    new pre-token (every alternative with an optional blank takes it along), so
    a text may be cut there first and only its distinct segments need the
    pattern.  Texts with any other white space beside a blank are matched
    whole, and their matches are the segments.
    """
    pieces, plain, at, lengths = split_at_blanks(texts)
    n, starts = len(pieces), starts_of(lengths)
    odd = np.zeros(n, bool)
    for k in np.flatnonzero(~plain).tolist():
        odd[k] = not pieces[k] or pieces[k][0].isspace() or pieces[k][-1].isspace()
    segments = [" " + p for p in pieces]
    first = starts[:-1][lengths > 0]  # no blank before the first piece of a text
    leads, number = np.unique(at[first], return_inverse=True)
    whole = np.flatnonzero(sums_of_runs(odd[at].astype(np.int64), starts)) if odd.any() else ()
    at[first] = n + number
    segments += [pieces[k] for k in leads.tolist()]
    if len(whole):
        parts, done = [], 0
        matches = Codes()
        for k in whole.tolist():
            text = texts[k].as_py()
            found = find.findall(text) if len(text) <= LONG_TEXT else (m[0] for m in find.finditer(text))
            own = np.array(array("I", map(matches.__getitem__, found)), np.uint32) + np.uint32(len(segments))
            parts += [at[done : starts[k]], own]
            done, lengths[k] = starts[k + 1], len(own)
        at = np.concatenate([*parts, at[done:]])
        segments += matches
    return segments, np.concatenate([plain, np.zeros(len(segments) - n, bool)]), at, lengths


def _pre_tokens(segments: list[str], plain: np.ndarray, find) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pre-tokens of the segments, the order in which the segments were taken and the number of pre-tokens of each; the ``plain`` ones, a blank and characters without white space, are matched joined."""
    together, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
    parts: list[str] = []
    sizes = np.zeros(len(segments), np.int64)
    for start in range(0, len(together), SEGMENTS):
        own = together[start : start + SEGMENTS]
        found = find.findall("".join([segments[k] for k in own.tolist()]))
        begins = np.flatnonzero(np.fromiter(map(str.startswith, found, repeat(" ")), bool, len(found)))
        if len(begins) != len(own):
            raise ValueError("a pre-token goes on over the end of a segment")
        sizes[own] = np.diff(begins, append=len(found))
        parts += found
    for k in alone.tolist():
        found = find.findall(segments[k])
        sizes[k] = len(found)
        parts += found
    return parts, np.concatenate([together, alone]), sizes


def _coded(table: pa.Table, pattern: str, n_buckets: int):
    """Segments and pre-tokens of a block; pre-tokens are numbered by bucket, then by first sight."""
    find = regex.compile(pattern)
    segments, plain, codes, lengths = cut(table.column("text"), find)
    used, at = by_frequency(codes, len(segments))
    parts, order, part_lengths = _pre_tokens([segments[k] for k in used.tolist()], plain[used], find)
    coded = pa.array(parts, pa.large_string()).dictionary_encode()
    sizes = part_lengths[order]
    place = np.argsort(order, kind="stable")  # back to the order of the segments
    parts = take_runs(coded.indices.to_numpy().astype(np.uint32), starts_of(sizes)[:-1][place], sizes[place])
    words = strings(coded.dictionary.cast(pa.large_binary()))
    bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % n_buckets
    order = np.argsort(bucket, kind="stable")
    number = np.zeros(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    flat = number[parts]
    words = [words[i] for i in order.tolist()]
    lengths = lengths.astype(np.uint64)
    key = xxhash.xxh64(b"\xff".join(words))
    key.update(b"\xff")
    key.update(at.tobytes())
    key.update(lengths.tobytes())
    key.update(str(table.column("doc_id").to_pylist()).encode())
    return key.intdigest() - 2**63, words, bucket[order], at, lengths, flat, part_lengths.astype(np.uint32)


WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("word_lengths", pa.binary())])
PLACES = pa.schema([("block", pa.int64()), ("rows", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("codes", pa.binary()), ("lengths", pa.binary()), ("parts", pa.binary()), ("part_lengths", pa.binary()), ("buckets", pa.list_(pa.int32()))])
IDS = "block long, bucket int, ids binary, id_lengths binary"


def _ranges(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(bucket)])]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of every whole text as the named library would give them without special tokens.

    ``docs``: ``doc_id`` (long), ``text``; other columns are left out.  Result:
    ``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit), one row per
    input row, repeated rows included.  A null or empty text has no ids; a null
    doc_id stays null; an empty table gives an empty result.

    Blocks are known by a hash of all they hold, so both reads of ``docs`` must
    give rows in the same order within a split, as file scans do; if a read
    differs, the query fails and never mixes blocks.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = BUCKETS_PER_PARTITION * n_parts
    vocabulary = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def words_of_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, words, bucket, *_ = _coded(table, pattern, n_buckets)
        cuts, sizes = _ranges(bucket), np.array([len(w) for w in words], np.uint32)
        if cuts:
            yield pa.record_batch([[block] * len(cuts), [k for k, _, _ in cuts], [zstandard.ZstdCompressor(level=1).compress(b"".join(words[a:b])) for _, a, b in cuts], [pack(sizes[a:b]) for _, a, b in cuts]], schema=WORDS)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, words_of_block, block_bytes)

    def places_of_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, _, bucket, at, lengths, flat, part_lengths = _coded(table, pattern, n_buckets)
        yield pa.record_batch([[block], [table.num_rows], [table.column("doc_id").to_pylist()], [pack(at)], [pack(lengths)], [pack(flat)], [pack(part_lengths)], [[v for k, a, b in _ranges(bucket) for v in (k, b - a)]]], schema=PLACES)

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, places_of_block, block_bytes)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        once: dict[bytes, bytes] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for block, bucket, words, lengths in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words", "word_lengths"))):
                ids, sizes = array("I"), array("I")
                words, cuts = zstandard.ZstdDecompressor().decompress(words), starts_of(unpack(lengths, np.uint32)).tolist()
                for start, stop in pairwise(cuts):
                    word = words[start:stop]
                    found = once.get(word)
                    if found is None:
                        found = once[word] = array("I", encoder._encode_single_piece(word)).tobytes()
                    ids.frombytes(found)
                    sizes.append(len(found) // 4)
                for column, value in zip(out, (block, bucket, pack(np.frombuffer(ids, np.uint32)), pack(np.frombuffer(sizes, np.uint32)))):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["block", "bucket", "ids", "id_lengths"])

    def reassembled(places: pa.Table, fetched: pa.Table) -> pa.Table:
        by_bucket = {k: (ids, sizes) for k, ids, sizes in zip(*(fetched.column(c).to_pylist() for c in ("bucket", "ids", "id_lengths")))}
        out_ids: list[pa.Array] = []
        doc_ids: list = []
        for place in places.to_pylist():
            wanted = list(zip(place["buckets"][::2], place["buckets"][1::2]))
            ids = [unpack(by_bucket[k][0], np.uint32) for k, _ in wanted]
            sizes = [unpack(by_bucket[k][1], np.uint32) for k, _ in wanted]
            if [len(s) for s in sizes] != [n for _, n in wanted]:
                raise ValueError("a block of documents was read in two different orders")
            none = [np.zeros(0, np.uint32)]
            flat_ids, size = np.concatenate(none + ids), np.concatenate(none + sizes).astype(np.int64)
            parts, part_lengths = unpack(place["parts"], np.uint32), unpack(place["part_lengths"], np.uint32).astype(np.int64)
            seg_ids = take_runs(flat_ids, starts_of(size)[:-1][parts], size[parts])
            ends = starts_of(size[parts])
            cut = starts_of(part_lengths)
            seg_start, seg_size = ends[cut[:-1]], ends[cut[1:]] - ends[cut[:-1]]
            at, lengths = unpack(place["codes"], np.uint32), unpack(place["lengths"], np.uint64).astype(np.int64)
            doc_cut = starts_of(lengths)
            texts = []
            for a, b in zip(doc_cut[:-1], doc_cut[1:]):
                own = at[a:b]
                texts.append(take_runs(seg_ids, seg_start[own], seg_size[own]).astype("<u4").tobytes())
            doc_ids += place["doc_id"]
            out_ids.append(pa.array(texts, pa.binary()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.chunked_array(out_ids, pa.binary())})

    fetched = rows.mapInArrow(words_of, "block long, bucket int, words binary, word_lengths binary").repartition(n_parts, "bucket").mapInArrow(encoded, IDS)
    places = rows.mapInArrow(places_of, "block long, rows long, doc_id array<long>, codes binary, lengths binary, parts binary, part_lengths binary, buckets array<int>")
    return places.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(reassembled, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids of each row, by the token-byte table.

    The table has one row per rank of the vocabulary file, so sending it to
    every task has a fixed bound.  Null ids decode to null; an id outside the
    table is an error.
    """
    table = encoded.sparkSession.sparkContext.broadcast(_byte_table(ranks))
    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*names)
    at = names.index("ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = table.value
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = []
                for ids in part.column(at).to_pylist():
                    known = None if ids is None else np.frombuffer(ids, "<u4")
                    if known is not None and len(known) and (int(known.max()) >= len(sizes) or bool((sizes[known] == 0).any())):
                        raise ValueError("an id is not in the token-byte table")
                    texts.append(None if known is None else take_runs(data, starts[known], sizes[known]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(decoded, StructType([*rows.schema.fields, StructField("decoded", BinaryType())]))


def _byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_rank[rank] = token
    sizes = np.array([len(t) for t in by_rank], np.int64)
    return np.frombuffer(b"".join(by_rank), np.uint8), starts_of(sizes)[:-1], sizes


def digest(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns ``more`` of rows with ``ids`` and ``decoded``."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def tokenize(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every text by a rank file (default: the 50k byte-level vocabulary)."""
    import public_tokenizers

    ranks = read_ranks(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return decode(encode(docs, ranks, pattern or public_tokenizers.PATTERN), ranks)
