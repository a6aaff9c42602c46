"""Operator 11: secrets in texts.

Method: token-efficiency test.  A byte-pair vocabulary spends few tokens on
text like that it was made from and many on random strings.  Every maximal
string of at least ``least`` characters of the Base64 and URL-safe alphabets is
encoded by the vocabulary, after known digests and identifiers are excluded; one
with at most ``ratio`` characters a token is a secret of kind ``random``.
Spans of fixed formats (:data:`FORMATS`) are found beside it and always stay.

Each text is judged alone and whole, so nothing is shuffled; a task holds one
Arrow batch and the memory of the distinct strings of that batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import each_block

#: Kinds of fixed formats, in their order: pattern, group that is measured, its least length.
FORMATS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]+"), 0, 32),
}
RANDOM = "random"
#: Kinds in the order in which spans of one start are listed.
KINDS = [*FORMATS, RANDOM]

#: Least characters of a string that is tested.
LEAST = 20
#: Most characters a token of a random string.
RATIO = 2.3
#: Digits of known digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
#: Text bytes of a block.
BLOCK_BYTES = 8_000_000
#: What a row counts in a block besides its text.
ROW_BYTES = 64
#: A long string is encoded in slices of so many characters; all count.
SLICE = 2_000

_STRING = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Part of an identifier: a word, words in camel case, each with up to four digits behind, or a number.
_PART = re.compile(r"(?:[A-Z]+|[a-z]*(?:[A-Z][a-z]{2,})*)[0-9]{0,4}|[0-9]+")

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,ratio:double>>"


def excluded(string: str) -> bool:
    """Known digests (one case, a digest's length), UUIDs, and identifiers: words and numbers joined by signs."""
    if _UUID.fullmatch(string) or (len(string) in DIGESTS and _HEX.fullmatch(string)):
        return True
    return all(map(_PART.fullmatch, re.split("[+/_=-]", string)))


def characters_per_token(string: str, encode: Callable[[str], list[int]]) -> float:
    """Length of the string over its number of tokens."""
    return len(string) / sum(len(encode(string[k : k + SLICE])) for k in range(0, len(string), SLICE))


def spans_of(text: str, encode: Callable[[str], list[int]], least: int = LEAST, ratio: float = RATIO, known: dict | None = None) -> list[tuple]:
    """(kind, start, end, characters a token or None) of a text by start, then kind."""
    out = []
    for kind, (pattern, group, length) in FORMATS.items():
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue  # the pattern needs them
        if kind == "hex":  # a run of at least so many digits, found at once
            pattern = _LONG_HEX
        out += [(kind, m.start(), m.end(), None) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= length]
    fixed = sorted((s, e) for _, s, e, _ in out)
    known = {} if known is None else known
    for m in re.finditer(_STRING % least, text):
        string = m[0]
        if string not in known:
            known[string] = None if excluded(string) else characters_per_token(string, encode)
        found = known[string]
        if found is not None and found <= ratio and not any(s <= m.start() and m.end() <= e for s, e in fixed):
            out.append((RANDOM, m.start(), m.end(), found))
    return sorted(out, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % FORMATS["hex"][2])


def scan(docs: DataFrame, ranks: dict[bytes, int], pattern: str, least: int = LEAST, ratio: float = RATIO, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Spans of secrets of every whole text.

    ``docs``: ``doc_id`` (long), ``text``; other columns are left out, whatever
    their names.  ``ranks`` and ``pattern``: the vocabulary, of fixed size.
    Result, one row per input row, repeated rows included: ``doc_id``, ``spans``:
    ``kind``, ``start`` and ``end`` in code points (end exclusive), ``ratio`` of
    ``random`` ones; by start, then kind in the order of :data:`KINDS`.  Spans of
    one fixed kind do not overlap, spans of different kinds may; a random string
    inside a span of a fixed format is not listed again.  A null or empty text
    has no spans; a null doc_id stays null; an empty table gives an empty result.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})

        def of_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
            known: dict[str, float | None] = {}
            found = [
                [dict(zip(("kind", "start", "end", "ratio"), s)) for s in spans_of(text, encoding.encode_ordinary, least, ratio, known)] if text else []
                for text in table.column("text").to_pylist()
            ]
            yield pa.record_batch([table.column("doc_id").combine_chunks(), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

        yield from each_block(batches, of_block, block_bytes, ROW_BYTES)

    return rows.mapInArrow(scanned, SPANS)


def find_secrets(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """:func:`scan` with a rank file (default: the 50k byte-level vocabulary)."""
    import public_tokenizers

    from tablewise.llm.bpe import read_ranks

    ranks = read_ranks(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scan(docs, ranks, pattern or public_tokenizers.PATTERN)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed formats, a digest of their spans, and all spans as ``kind:start:end``."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    fixed = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select("doc_id", *[count(k) for k in FORMATS], F.sha2(listed(fixed).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
