"""Blocks of documents inside a task, with the distinct units of each block coded as integers.

Texts repeat their words, so the operators look at every distinct word of a
block once and keep the texts as arrays of codes.  A block ends after
``block_chars`` bytes of text and never splits a document, so the memory of a
task is that of one block or of its longest document.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text after which a block ends.
BLOCK_BYTES = 8_000_000


def give_back() -> None:
    """Return freed memory to the system: the worker stays when the task has ended, and the C library keeps what numpy and zstd have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def blocks_of(batches: Iterable[pa.RecordBatch], column: str = "text", block_bytes: int = BLOCK_BYTES, row_bytes: int = 0) -> Iterator[pa.Table]:
    """Cut a stream of batches into tables of about ``block_bytes`` of the text column, in row order; a row counts as ``row_bytes`` more.

    A column of numbers stands for texts of so many bytes: it is cut in the same places.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.fill_null(texts if pa.types.is_integer(texts.type) else pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + row_bytes
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + block_bytes - size, "left")) + 1
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= block_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                give_back()
    if held:
        yield pa.Table.from_batches(held)
        held = []
    give_back()


def each_block(batches: Iterable[pa.RecordBatch], work: Callable[[pa.Table], Iterator], block_bytes: int = BLOCK_BYTES, row_bytes: int = 0) -> Iterator:
    """What ``work`` yields for each block; nothing of a block stays when the next one is read."""
    for table in blocks_of(batches, "text", block_bytes, row_bytes):
        yield from work(table)
        del table  # before memory is given back


class Codes(dict):
    """Unit -> code in order of first sight; ``codes[unit]`` gives a new unit the next code."""

    def __missing__(self, unit):
        self[unit] = code = len(self)
        return code


def code_words(texts: Iterable[bytes | None], split: Callable[[bytes], list[bytes]] = bytes.split) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, their code at every position, and the number of words of each text."""
    codes, at, lengths = Codes(), array("I"), array("Q")
    for text in texts:
        words = split(text) if text else ()
        at.extend(map(codes.__getitem__, words))
        lengths.append(len(words))
    return list(codes), np.frombuffer(at, np.uint32) if at else np.zeros(0, np.uint32), np.array(lengths, np.int64)


#: No character up to U+0020, from U+007F to U+00A0 or white elsewhere in Unicode.
_SOLID = r"\A[^\x00-\x20\x7f-\xa0\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\x{feff}]+\z"


def solid(texts: pa.Array) -> np.ndarray:
    """Whether each text has characters but no white or control character."""
    return pc.match_substring_regex(texts, _SOLID).to_numpy(zero_copy_only=False)


def strings(texts: pa.Array) -> list:
    """The texts as a list, by way of numpy, which takes a fraction of the time of ``to_pylist``."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def split_at_blanks(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces between the blanks of the texts, whether each has characters but no white or control character, their code at every place and the number of pieces of each text; null and empty texts have none."""
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    pieces = pc.split_pattern(texts.filter(full).cast(pa.large_string()).combine_chunks(), " ")
    coded = pieces.flatten().dictionary_encode()
    lengths = np.zeros(len(texts), np.int64)
    lengths[full.to_numpy()] = pc.list_value_length(pieces).to_numpy()
    return strings(coded.dictionary), solid(coded.dictionary), coded.indices.to_numpy().astype(np.uint32), lengths


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run begins, and at the end the total: one more entry than ``lengths``."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def take_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[s : s + n]`` one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begin = starts_of(lengths)[:-1]
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - begin, lengths)]


def sums_of_runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; ``starts`` as from :func:`starts_of`, empty runs give 0.

    Each run is added up by itself, so its sum does not depend on what else the block holds.
    """
    out = np.zeros(len(starts) - 1, values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full])
    return out


def pack(values: np.ndarray) -> bytes:
    """Compressed numbers: the lowest bytes of all first, then the next, so small numbers take little room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    """The numbers of :func:`pack`."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def gaps_in_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each run in ascending order, as its smallest value and the gaps behind it: small numbers, in which order takes no room."""
    out = np.sort(np.repeat(np.arange(len(lengths), dtype=np.uint64) << np.uint64(32), lengths) | values.astype(np.uint64)).astype(np.uint32)
    gaps = np.diff(out, prepend=np.uint32(0))
    firsts = starts_of(lengths)[:-1][lengths > 0]
    gaps[firsts] = out[firsts]
    return gaps


def runs_of_gaps(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ascending runs of :func:`gaps_in_runs`."""
    total = starts_of(gaps.astype(np.int64))
    return total[1:] - np.repeat(total[starts_of(lengths)[:-1]], lengths)


def by_frequency(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes in use from the most to the least frequent, and the texts' codes renumbered that way."""
    counts = np.bincount(codes, minlength=n)
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    number = np.zeros(n, np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    return order, number[codes]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps of 6 bytes, or of 8 where a gap needs them."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, rest = gaps[:1], gaps[1:]
    width = 6 if not len(rest) or int(rest.max()) < 1 << 48 else 8
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    """The keys of :func:`pack_sorted`."""
    width, first = data[0], np.frombuffer(data, np.uint64, 1, 1)
    rest = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, -1, 9).reshape(-1, width)
    return np.cumsum(np.concatenate([first, rest.view(np.uint64).ravel()]), dtype=np.uint64)


def hash_ranges(keys: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys; buckets are equal ranges of the hashes."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets)))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(keys)])]
