"""Operator 12: alignment of the tokens of two tokenizers.

Method: inverted pair bitmaps.  Texts are encoded by both tokenizers; byte
offsets where a token of each ends cut them into groups, and every two tokens
that share a group are linked.  Each block of documents becomes a part of an
inverted index: for every pair of ids a compressed bitmap of the block's
documents that hold the pair linked, and multiplicity planes (bitmap ``k`` has
the documents whose number of links beyond the first has bit ``k``).  Blocks
hold different documents, so OR-merging their bitmaps puts them side by side
and the popcounts add up to the pair's document and link counts.  The counts go
back to the postings, and the postings of a block, weighted by them, give its
documents' scores.

The index is written once in the shared folder: a row for each block with its
bitmaps, and a narrow row for each pair of a block with the popcounts.  Texts
are read and encoded once.  A pair that every document holds has one narrow row
a block, so no key holds more rows than there are blocks.

Text is encoded by distinct segments of a block: a blank between two characters
that are not white space begins a token in both tokenizers, so what lies
between such blanks is encoded apart, and a token of each ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.blocks import Codes, blocks_of, by_frequency, pack, solid, split_at_blanks, starts_of, strings, sums_of_runs, take_runs, unpack
from tablewise.llm.shared import written

#: Text bytes of a block.
BLOCK_BYTES = 4_000_000
#: What a row counts in a block besides its text.
ROW_BYTES = 64
#: Segments encoded as one string.
SEGMENTS = 2_000

def _odd(segments: list[str], plain: np.ndarray) -> np.ndarray:
    """Whether each segment is empty or has white space at an end."""
    out = np.zeros(len(segments), bool)
    for k in np.flatnonzero(~plain).tolist():
        out[k] = not segments[k] or segments[k][0].isspace() or segments[k][-1].isspace()
    return out


_SAFE = re.compile(r"(?<=\S) (?=\S)")

_PLANE = "struct<pairs:binary,lengths:binary,docs:binary,full_pairs:binary,full:binary>"
INDEX = (
    "block long, a int, b int, n_docs long, n_links long, pairs binary, "
    f"planes array<{_PLANE}>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, links array<long>, "
    "segments binary, codes binary, lengths binary"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer file: ids of strings and the bytes of each id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()

        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.starts, self.joined = starts_of(self.sizes)[:-1], np.frombuffer(b"".join(self.bytes), np.uint8)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, a blank before each segment, and the number of each segment.

        Segments without white space at an end are joined by the blanks and
        encoded as one string, cut again where their bytes end.
        """
        odd = _odd(segments, solid(pa.array(segments, pa.large_string())))
        plain, alone = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, lengths = [], []
        for start in range(0, len(plain), 8 * SEGMENTS):
            parts = [[segments[k] for k in plain[i : i + SEGMENTS]] for i in range(start, min(start + 8 * SEGMENTS, len(plain)), SEGMENTS)]
            for part, own in zip(parts, self._ids([" " + " ".join(p) for p in parts])):
                ends = np.cumsum(pc.binary_length(pa.array(part, pa.string())).to_numpy() + 1, dtype=np.int64)
                token_ends = np.cumsum(self.sizes[own])
                last = np.searchsorted(token_ends, ends)
                if not np.array_equal(token_ends[np.minimum(last, len(own) - 1)], ends):
                    raise ValueError("a token goes on over the end of a segment")
                ids.append(own)
                lengths.append(np.diff(last, prepend=-1))
        for start in range(0, len(alone), SEGMENTS):
            found = self._ids([" " + segments[k] for k in alone[start : start + SEGMENTS]])
            ids += found
            lengths.append(np.array([len(x) for x in found], np.int64))
        none = [np.zeros(0, np.int64)]
        ids, lengths = np.concatenate(none + ids), np.concatenate(none + lengths)
        place = np.argsort(np.concatenate([plain, alone]), kind="stable")
        return take_runs(ids, starts_of(lengths)[:-1][place], lengths[place]), lengths[place]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A piece model that adds the blank itself: ids of strings and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on over a blank, so texts cannot be cut there")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]

        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.starts, self.joined = starts_of(self.sizes)[:-1], np.frombuffer(b"".join(self.bytes), np.uint8)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each segment."""
        found = self.model.encode(segments, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths


def cut_texts(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments, their code at every place and the number of each text.

    Texts are split at blanks; those with white space at an end of a segment
    are cut anew, only at single blanks between other characters.
    """
    pieces, plain, at, lengths = split_at_blanks(texts)
    known = Codes(zip(pieces, range(len(pieces))))
    odd = _odd(pieces, plain)
    starts = starts_of(lengths)
    again = np.flatnonzero(sums_of_runs(odd[at].astype(np.int64), starts)) if odd.any() else []
    if len(again):
        parts, done = [], 0
        for k in again.tolist():
            own = np.array([known[s] for s in _SAFE.split(texts[k].as_py())], np.uint32)
            parts += [at[done : starts[k]], own]
            done, lengths[k] = starts[k + 1], len(own)
        at = np.concatenate([*parts, at[done:]])
    return list(known), at, lengths


def _restores(tokenizer, ids: np.ndarray, lengths: np.ndarray, segments: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each segment's tokens are the segment."""
    sizes = sums_of_runs(tokenizer.sizes[ids], starts_of(lengths))
    if np.array_equal(sizes, np.fromiter(map(len, segments), np.int64, len(segments))):
        joined = take_runs(tokenizer.joined, tokenizer.starts[ids], tokenizer.sizes[ids])
        if joined.tobytes() == b"".join(segments):
            return np.ones(len(segments), bool)
    parts = list(map(tokenizer.bytes.__getitem__, ids.tolist()))
    cuts = starts_of(lengths).tolist()
    return np.fromiter((b"".join(parts[a:b]) == s for a, b, s in zip(cuts, cuts[1:], segments)), bool, len(segments))


def _joined(strings: pa.Array, starts: np.ndarray, sign: str) -> pa.Array:
    """The strings of each run, ``sign`` between them."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts), strings), pa.scalar(sign, pa.large_string()))


class Alignment:
    """Groups and links of distinct segments.

    ``good``: whether both tokenizers restore the segment; the arrays below have
    a place for each segment, ``n_*`` 0 and no links where not.  ``pair``,
    ``times``: links of the segments one after the other, cut by ``cuts``.
    """

    def __init__(self, first, second, segments: list[str]):
        raw = [b" " + s.encode() for s in segments]
        ids, sizes = zip(*(t.encode(segments) for t in (first, second)))
        self.good = np.logical_and(*(_restores(t, i, n, raw) for t, i, n in zip((first, second), ids, sizes)))
        own = [np.repeat(np.arange(len(segments)), n) for n in sizes]
        kept = [self.good[s] for s in own]
        a, b = (i[k] for i, k in zip(ids, kept))
        seg_a, seg_b = (s[k] for s, k in zip(own, kept))
        ends = [np.cumsum(t.sizes[i]) for t, i in ((first, a), (second, b))]
        common = np.intersect1d(*ends, assume_unique=True)
        group_a, group_b = (np.searchsorted(common, e) for e in ends)
        seg_of_group = np.zeros(len(common), np.int64)
        seg_of_group[group_a] = seg_a
        n = len(segments)
        self.n_a, self.n_b, self.n_groups = (np.bincount(s, minlength=n) for s in (seg_a, seg_b, seg_of_group))
        in_a, in_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        self.n_links = sums_of_runs(in_a * in_b, starts_of(self.n_groups))
        self.texts = self._texts(a, b, in_a, in_b)
        self._link(a, group_a, b, group_b, seg_of_group, len(second.bytes))

    def _texts(self, a, b, in_a, in_b) -> list[str]:
        """``a1,a2|b1;...`` of each segment, empty where there is none."""
        own = [_joined(pa.array(i).cast(pa.large_string()), starts_of(n), ",") for i, n in ((a, in_a), (b, in_b))]
        return strings(_joined(pc.binary_join_element_wise(*own, pa.scalar("|", pa.large_string())), starts_of(self.n_groups), ";"))

    def _link(self, a, group_a, b, group_b, seg_of_group, n_second: int) -> None:
        """Distinct ids of each group, crossed: as many rows as different links, however often one is repeated."""
        wide = max(int(a.max(initial=0)), n_second) + 1
        (key_a, times_a), (key_b, times_b) = (np.unique(g * wide + i, return_counts=True) for g, i in ((group_a, a), (group_b, b)))
        start_b = np.searchsorted(key_b // wide, np.arange(len(seg_of_group) + 1))
        group = key_a // wide
        count = np.diff(start_b)[group]
        left = np.repeat(np.arange(len(key_a)), count)
        right = take_runs(np.arange(len(key_b)), start_b[:-1][group], count)
        pair = key_a[left] % wide * n_second + key_b[right] % wide
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.times = times_a[left] * times_b[right]
        self.cuts = np.searchsorted(seg_of_group[group][left], np.arange(len(self.good) + 1))


def _number(n: int) -> np.dtype:
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")


def packed_bitmaps(pair: np.ndarray, doc: np.ndarray, n_pairs: int, n: int) -> dict[str, bytes]:
    """A bitmap of the ``n`` documents of a block for each pair, compressed: document numbers where few, else one bit each."""
    lengths = np.bincount(pair, minlength=n_pairs)
    full = lengths * _number(n).itemsize * 8 >= n
    few = np.flatnonzero((lengths > 0) & ~full)
    some = np.flatnonzero((lengths > 0) & full)
    bits = bytearray()
    starts = starts_of(lengths)
    for k in some.tolist():
        row = np.zeros(n, np.uint8)
        row[doc[starts[k] : starts[k + 1]]] = 1
        bits += np.packbits(row, bitorder="little").tobytes()
    return {
        "pairs": pack(few.astype(np.uint32)), "lengths": pack(lengths[few].astype(np.uint32)), "docs": pack(doc[~full[pair]].astype(_number(n))),
        "full_pairs": pack(some.astype(np.uint32)), "full": zstandard.ZstdCompressor(level=1).compress(bytes(bits)),
    }


def unpacked_bitmaps(bitmaps: dict[str, bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, documents) of :func:`packed_bitmaps`: each pair of a document once."""
    few, lengths = unpack(bitmaps["pairs"], np.uint32), unpack(bitmaps["lengths"], np.uint32)
    yield np.repeat(few, lengths), unpack(bitmaps["docs"], _number(n)).astype(np.int64)
    width = (n + 7) // 8
    bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmaps["full"]), np.uint8).reshape(-1, max(width, 1))
    for pair, row in zip(unpack(bitmaps["full_pairs"], np.uint32), bits):
        docs = np.flatnonzero(np.unpackbits(row, bitorder="little"))
        yield np.full(len(docs), pair), docs


def _postings(aligned: Alignment, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, links) of a block, sorted; ``at``: segment codes of the documents, cut by ``starts``."""
    n_segments, n = max(len(aligned.good), 1), max(len(starts) - 1, 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    uses, times = np.unique(doc * n_segments + at, return_counts=True)
    doc, segment = uses // n_segments, uses % n_segments
    length = np.diff(aligned.cuts)[segment]
    links = take_runs(np.arange(len(aligned.pair)), aligned.cuts[:-1][segment], length)
    key = aligned.pair[links] * n + np.repeat(doc, length)
    count = aligned.times[links] * np.repeat(times, length)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    key, count = key[cut], np.add.reduceat(count, cut) if len(cut) else count
    return key // n, key % n, count


def _index_of_block(table: pa.Table, block: int, first, second) -> Iterator[pa.RecordBatch]:
    """One row for the documents of the block and their bitmaps, then a row for each of its pairs."""
    segments, at, lengths = cut_texts(table.column("text"))
    used, at = by_frequency(at, len(segments))
    aligned = Alignment(first, second, [segments[k] for k in used.tolist()])
    n, starts = len(lengths), starts_of(lengths)
    good = sums_of_runs((~aligned.good[at]).astype(np.int64), starts) == 0
    totals = [np.where(good, sums_of_runs(x[at], starts), 0).tolist() for x in (aligned.n_a, aligned.n_b, aligned.n_groups, aligned.n_links)]
    at = at[np.repeat(good, lengths)]  # a text that is not restored has no groups
    lengths = np.where(good, lengths, 0)
    pair, doc, count = _postings(aligned, at, starts_of(lengths))
    present, pair = np.unique(pair, return_inverse=True)
    extra = count - 1
    chosen = [np.arange(len(pair)), *(np.flatnonzero(extra >> bit & 1) for bit in range(int(extra.max(initial=0)).bit_length()))]
    planes = [packed_bitmaps(pair[k], doc[k], len(present), n) for k in chosen]
    ids = aligned.pairs[present]
    n_second = len(second.bytes)
    schema = pa.schema([
        ("block", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("pairs", pa.binary()),
        ("planes", pa.list_(pa.struct([(c, pa.binary()) for c in ("pairs", "lengths", "docs", "full_pairs", "full")]))),
        *((c, pa.list_(pa.int64())) for c in ("doc_id", "n_a", "n_b", "n_groups", "links")), ("segments", pa.binary()), ("codes", pa.binary()), ("lengths", pa.binary()),
    ])

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    yield rows(
        1, block=[block], pairs=[pack(ids)], planes=[planes], doc_id=[table.column("doc_id").to_pylist()],
        **{c: [x] for c, x in zip(("n_a", "n_b", "n_groups", "links"), totals)},
        segments=[zstandard.ZstdCompressor(level=3).compress("\n".join(aligned.texts).encode())], codes=[pack(at.astype(np.uint32))], lengths=[pack(lengths.astype(np.uint64))],
    )
    n_docs, n_links = np.bincount(pair, minlength=len(present)), np.bincount(pair, count, len(present)).astype(np.int64)
    for k in range(0, len(present), 10_000):
        part = slice(k, k + 10_000)
        own = ids[part]
        yield rows(len(own), block=np.full(len(own), block), a=own // n_second, b=own % n_second, n_docs=n_docs[part], n_links=n_links[part])


def inverted_index(docs: DataFrame, byte_file: str, piece_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index of linked pairs, written in the shared folder.

    Rows without ``a`` have the documents of a block, their groups, its
    ``pairs`` and ``planes``: the bitmaps of the documents that hold each pair
    and those of their further links.  Rows with ``a`` have the ids ``a`` and
    ``b`` of a pair of a block and the popcounts ``n_docs`` and ``n_links``.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ByteLevel(byte_file), Pieces(piece_file)
        block = TaskContext.get().partitionId() << 32
        for table in blocks_of(batches, "text", block_bytes, ROW_BYTES):
            yield from _index_of_block(table, block, first, second)
            block += 1

    return written(rows.mapInArrow(indexed, INDEX), "alignment")


def pair_counts(index: DataFrame) -> DataFrame:
    """Document and link counts of every pair over the whole index, and whether no pair of its ``a`` has more documents."""
    merged = index.where("a is not null").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    most = F.max("n_docs").over(Window.partitionBy("a"))  # at most one row for each piece of the other vocabulary
    return merged.withColumn("best", F.col("n_docs") == most)


def _scored(block: pa.Table, scores: pa.Table, n_second: int) -> pa.Table:
    """Scores of a block's documents from its bitmaps, weighted by the pairs' counts."""
    texts = block.to_pylist()[0]
    n = len(texts["doc_id"])
    a, b, found, best = (scores.column(c).to_numpy() for c in ("first", "second", "n_docs", "best"))
    order = np.lexsort((b, a))
    if not np.array_equal(a[order].astype(np.int64) * n_second + b[order], unpack(texts["pairs"], np.int64)):
        raise ValueError("bitmaps and counts of a block have different pairs")
    found, best = found[order].astype(np.int64), best[order].astype(bool)
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, plane in enumerate(texts["planes"]):
        times = 1 if k == 0 else 1 << (k - 1)
        for pair, docs in unpacked_bitmaps(plane, n):
            np.add.at(count_sum, docs, found[pair] * times)
            np.add.at(n_best, docs, best[pair] * times)
    groups = zstandard.ZstdDecompressor().decompress(texts["segments"]).decode().split("\n")
    codes, cuts = unpack(texts["codes"], np.uint32), starts_of(unpack(texts["lengths"], np.uint64).astype(np.int64)).tolist()
    joined = [";".join(map(groups.__getitem__, codes[s:e].tolist())) for s, e in zip(cuts, cuts[1:])]
    columns = [texts["doc_id"], texts["n_a"], texts["n_b"], texts["n_groups"], texts["links"], n_best, count_sum]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, columns)} | {"groups": pa.array(joined, pa.large_string()).cast(pa.string())})


def align(docs: DataFrame, byte_file: str, piece_file: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of every whole text and how common its links are in all of ``docs``.

    ``docs``: ``doc_id`` (long), ``text``; other columns are left out, whatever
    their names.  The byte-level tokenizer encodes a blank and the text, the
    piece model the text (and adds a blank).  Result, one row per input row,
    repeated rows included and each a document of its own: ``doc_id``, ``n_a``,
    ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is
    in as many documents as any pair of its first id, ties included),
    ``count_sum`` (document counts of the pairs, summed over the links),
    ``groups`` (``a1,a2|b1;a3|b2,b3``).  A text that is null or empty, or whose
    tokens do not join to blank and text in both, has no tokens: zeros and the
    empty string.  A null doc_id stays null; an empty table gives an empty
    result.  A text longer than a block is a block of its own.
    """
    index = inverted_index(docs, byte_file, piece_file, block_bytes)
    counts = pair_counts(index).select(F.col("a").alias("first"), F.col("b").alias("second"), "n_docs", "best")
    asked = index.where("a is not null").select(F.col("block").alias("of"), F.col("a").alias("first"), F.col("b").alias("second"))
    scores = asked.join(counts, ["first", "second"])
    held = index.where("a is null").select("block", "pairs", "planes", "doc_id", "n_a", "n_b", "n_groups", "links", "segments", "codes", "lengths")
    n_second = len(Pieces(piece_file).bytes)

    def scored(block: pa.Table, own: pa.Table) -> pa.Table:
        return _scored(block, own, n_second)

    return held.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(scored, ALIGNED)


def digest(aligned: DataFrame) -> DataFrame:
    """The counts and a digest of the groups; the empty string without tokens."""
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", hashed.alias("groups_sha256"))
