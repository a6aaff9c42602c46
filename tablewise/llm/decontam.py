"""Operator 7: benchmark decontamination by CGK embedding and bit-sampling LSH.

Method: the CGK random walk copies the word at its pointer to each output place
and moves on by a random bit of (table, place, word), so texts at a small edit
distance become strings at a small Hamming distance.  Every table samples some
output places.  A walk of few places begins at every word of a document, forward
and backward; the walks along a window of an item's size are the embedding of
that window piece by piece.  An item is embedded in the same way.  A window
whose sampled places equal those of an item is a candidate, and the exact word
edit distance between the item and the text around it decides.

Walk and tables follow from the item's length: ``k`` edits leave at least
``stretch`` unedited words in a row (:func:`stretch_of`), and a walk that stays
on them is the same in both texts.  The chance of that is known exactly for
each table (:func:`chance`); as many tables are taken as lead to the wanted
recall for an item with all the edits that are allowed.

Documents are only scanned: items travel to them in blocks of bounded size,
every window meets every table, and nothing is shuffled but the hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import BLOCK_BYTES, blocks_of, split_at_blanks, starts_of, strings, sums_of_runs, take_runs

#: Largest share of an item's words that may be edited.
MAX_EDITS = 0.2
#: Share of items with the full number of edits that the tables are to find at least.
RECALL = 0.99
#: Bytes of item text in one pass over the documents.
ITEM_BYTES = 8_000_000
MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    """Words of letters and digits, lower-cased, without signs around or in them."""
    found = regex.compile(r"[^\W_]+")
    return [w for w in ("".join(found.findall(raw)) for raw in (text or "").lower().split()) if w]


def word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _joined(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _bits(keys: np.ndarray, table: int) -> np.ndarray:
    """The random bits of each word in one table: bit j tells whether the walk moves on at place j."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (table + 1)) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretch_of(n: int, limit: int) -> int:
    """Words in a row that ``limit`` edits leave untouched in ``n`` words at least."""
    return -(-(n - limit) // (limit + 1))


def places_of(table: int, stretch: int) -> list[int]:
    """The sampled output places of a table for items with such a stretch: the first, and all others but one drawn."""
    walk = max(1, 2 * stretch - 2 + (stretch == 2))
    if walk < 4:
        return list(range(walk))
    left_out = int(np.random.default_rng(1000 + table).integers(1, walk))
    return [j for j in range(walk) if j != left_out]


def least_words(stretch: int) -> int:
    """Different words that a walk has to sample to be looked up; fewer would fit too many texts."""
    return min(stretch, max(2, stretch - 1))


def chance(table: int, stretch: int) -> float:
    """Exact chance that a walk from the first word of the stretch stays on it and samples enough words."""
    places = places_of(table, stretch)
    good, moves = 0, places[-1]
    for bits in range(1 << moves):
        at = [(bits & ((1 << j) - 1)).bit_count() for j in places]
        good += at[-1] < stretch and len(set(at)) >= least_words(stretch)
    return good / (1 << moves)


def tables_for(stretch: int, recall: float = RECALL) -> int:
    """How many tables, each walked forward and backward, leave at most ``1 - recall`` of such stretches unseen."""
    missed, table = 1.0, 0
    while missed > 1 - recall + 1e-12:
        missed *= (1 - chance(table, stretch)) ** 2
        table += 1
    return table


def tables_of(items: list[tuple], max_edits: float = MAX_EDITS, recall: float = RECALL) -> SimpleNamespace:
    """The LSH tables of one block of items: for each (direction, table) its sampled places by level, for each
    level the keys of all walks (``prefixes``, sorted) and the items and places of the walks that end there (``final``)."""
    if not 0 <= max_edits < 1:
        raise ValueError("an item all of whose words may be edited has no stretch to look for")
    held = [(i, words) for i, words in ((i, words_of(t)) for i, t in items) if words]
    limits = [int(max_edits * len(words) + 1e-9) for _, words in held]
    stretches = [stretch_of(len(words), limit) for (_, words), limit in zip(held, limits)]
    need = {r: tables_for(r, recall) for r in set(stretches)}
    places = {(r, t): places_of(t, r) for r, n in need.items() for t in range(n)}
    tables = {}
    for backward in (False, True):
        # items with the same sampled places share a table
        for number, (_, words) in enumerate(held):
            own = words[::-1] if backward else words
            hashes = np.array([word_key(w) for w in own], np.uint64)
            stretch = stretches[number]
            for t in range(need[stretch]):
                sampled = places[stretch, t]
                table = tables.setdefault((backward, t, tuple(sampled)), SimpleNamespace(backward=backward, salt=2 * t + backward, places=sampled, firsts=set(), prefixes=[set() for _ in sampled], final=[{} for _ in sampled]))
                bits = _bits(hashes, table.salt).tolist()
                for anchor in range(len(own) - stretch + 1):
                    at, j, seen, keys, key = anchor, 0, [], [], np.zeros(1, np.uint64)
                    for place in sampled:
                        while j < place and at < len(own):
                            at += bits[at] >> j & 1
                            j += 1
                        if at >= len(own):  # the item ends: what was sampled before is looked up
                            break
                        key = _joined(key, hashes[at : at + 1])
                        keys.append(int(key[0]))
                        seen.append(at)
                    if len(set(seen)) < least_words(stretch):
                        continue
                    table.firsts.add(int(hashes[anchor]))
                    for level, value in enumerate(keys):
                        table.prefixes[level].add(value)
                    table.final[len(keys) - 1].setdefault(keys[-1], []).append((number, anchor))
    for table in tables.values():
        table.prefixes = [np.array(sorted(p), np.uint64) for p in table.prefixes if p]
        table.firsts = np.array(sorted(table.firsts), np.uint64)
    return SimpleNamespace(items=held, limits=limits, tables=list(tables.values()), walk=1 + max((t.places[-1] for t in tables.values()), default=0))


def _filter(keys: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array; a table of their low bits drops most others first."""
    low = np.uint64((1 << 20) - 1)
    marked = np.zeros(1 << 20, bool)
    marked[(allowed & low).astype(np.int64)] = True
    out = marked[(keys & low).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(allowed):
        where = np.minimum(np.searchsorted(allowed, keys[at]), len(allowed) - 1)
        out[at] = allowed[where] == keys[at]
    return out


def best_match(item: list, text: list, limit: int) -> tuple[int, int, int] | None:
    """(edits, from, to) of the part of ``text`` nearest to ``item`` by word edits, if within ``limit``.

    Of equal ones the part that ends first, and of those the longest.
    """
    forward = _nearest_end(item, text)
    if forward is None or forward[0] > limit:
        return None
    edits, end = forward
    backward = _ends(item[::-1], text[:end][::-1], anchored=True)
    length = max((n for n, d in enumerate(backward) if d == edits), default=0)
    return edits, end - length, end


def _ends(item: list, text: list, anchored: bool) -> list[int]:
    """Edit distance of the item to the best part that ends at each place of the text (bit-parallel).

    ``anchored``: parts begin where the text begins.
    """
    n = len(item)
    full = (1 << n) - 1
    equal: dict = defaultdict(int)
    for k, word in enumerate(item):
        equal[word] |= 1 << k
    up, down, distance, out = full, 0, n, [n]
    for word in text:
        match = equal.get(word, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        plus, minus = down | (~(diagonal | up) & full), up & diagonal
        distance += (plus >> (n - 1) & 1) - (minus >> (n - 1) & 1)
        plus = (plus << 1 | (1 if anchored else 0)) & full
        minus = minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        out.append(distance)
    return out


def _nearest_end(item: list, text: list) -> tuple[int, int] | None:
    distances = _ends(item, text, anchored=False)
    best = min(distances)
    return best, distances.index(best)


def _words_coded(texts: pa.ChunkedArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of a block as :func:`words_of` gives them (one may have several codes), their code at every place and the number of words of each text."""
    lowered = pa.chunked_array([[t.lower() if t else t for t in strings(chunk)] for chunk in texts.chunks], pa.string())
    pieces, plain, at, lengths = split_at_blanks(lowered)
    words, begins, ends = list(pieces), np.arange(len(pieces)), np.arange(len(pieces)) + 1
    for k in np.flatnonzero(~plain).tolist():  # its words follow behind all pieces
        begins[k], words[k] = len(words), ""
        words += pieces[k].split()
        ends[k] = len(words)
    signs = [k for k, w in enumerate(words) if not w.isalnum()]
    # no word holds a line feed, so all of them lose their signs in one call
    for k, word in zip(signs, regex.sub(r"(?:[^\w\n]|_)+", "", "\n".join([words[k] for k in signs])).split("\n")):
        words[k] = word
    codes = np.flatnonzero(np.fromiter(map(bool, words), bool, len(words)))
    begins, ends = np.searchsorted(codes, begins), np.searchsorted(codes, ends)
    each = (ends - begins)[at]
    return words, take_runs(codes, begins[at], each), sums_of_runs(each, starts_of(lengths))


def _hits(table: pa.Table, items: SimpleNamespace) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, from word, to word) of a block of documents."""
    words, at_, sizes = _words_coded(table.column("text"))
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    starts = starts_of(sizes)
    keys = np.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.uint64(0))
    # each text is followed by so many empty places that no walk reaches the next
    pad, walk = len(words), items.walk
    begins = starts + np.arange(len(starts)) * walk
    place = np.arange(len(at_)) + row_of * walk
    turned = starts[row_of] + starts[row_of + 1] - 1 - np.arange(len(at_))  # each text back to front
    directions = {}
    for backward, own in ((False, at_), (True, at_[turned])):
        directions[backward] = np.full(len(at_) + walk * (len(sizes) + 1), pad, np.int64)
        directions[backward][place] = own
    candidates: dict[tuple[int, int], set[int]] = defaultdict(set)
    for table in items.tables:
        codes_ = directions[table.backward]
        # the first place sampled is that of the first word, so each word is looked up there once, not at every place
        firsts = _joined(np.zeros(pad, np.uint64), keys[:pad])
        wanted = np.append(_filter(keys[:pad], table.firsts) & _filter(firsts, table.prefixes[0]), False) if table.prefixes else np.zeros(pad + 1, bool)
        firsts = np.append(firsts, np.uint64(0))
        bits = _bits(keys, table.salt)
        bits[pad] = 0
        origin = np.flatnonzero(wanted[codes_])
        pointer, code, j = origin, codes_[origin], 0
        key = firsts[code]
        for level, prefixes in enumerate(table.prefixes):
            while j < table.places[level]:
                pointer = pointer + ((bits >> np.uint64(j)) & np.uint64(1)).astype(np.int64)[code]
                code = codes_[pointer]
                j += 1
            if level:
                key = _joined(key, keys[code])
                keep = _filter(key, prefixes)
                pointer, origin, key, code = pointer[keep], origin[keep], key[keep], code[keep]
            final = table.final[level]
            if final:
                ended = np.flatnonzero(_filter(key, np.array(sorted(final), np.uint64)))
                rows = np.searchsorted(begins, origin[ended], "right") - 1
                for row, first, found in zip(rows.tolist(), (origin[ended] - begins[rows]).tolist(), key[ended].tolist()):
                    for number, anchor in final[found]:
                        offset = first - anchor
                        candidates[row, number].add(int(sizes[row]) - offset - len(items.items[number][1]) if table.backward else offset)
    out = []
    hashes = [np.unique(np.array([word_key(w) for w in item], np.uint64)) for _, item in items.items]
    for (row, number), offsets in candidates.items():
        item_id, item = items.items[number]
        limit = items.limits[number]
        a, b = int(starts[row]), int(starts[row + 1])
        # a match holds all but ``limit`` of the item's words, so a stretch with fewer of them cannot have one
        own = keys[at_[a:b]]
        held = hashes[number][np.minimum(np.searchsorted(hashes[number], own), len(hashes[number]) - 1)]
        seen = starts_of((held == own).astype(np.int64))
        offsets_ = np.array(sorted(offsets))
        low, high = np.maximum(0, offsets_ - 2 * limit), np.minimum(b - a, offsets_ + len(item) + 2 * limit)
        enough = np.flatnonzero(seen[np.maximum(high, 0)] - seen[np.minimum(low, b - a)] >= len(item) - limit)
        if not len(enough):
            continue
        text, best, done = [words[c] for c in at_[a:b].tolist()], None, -1
        for lo, hi in zip(low[enough].tolist(), high[enough].tolist()):
            if hi <= done:
                continue
            done = hi
            match = best_match(item, text[lo:hi], limit)
            if match and (best is None or match[0] < best[0]):
                best = (match[0], match[1] + lo, match[2] + lo)
        if best:
            out.append((row, number, *best))
    return out


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL, item_bytes: int = ITEM_BYTES, block_bytes: int = BLOCK_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """Which items whole documents hold: ``doc_id``, ``item_id``, ``edits``, ``first_word``, ``last_word``, ``item_words``, the columns ``carried``.

    ``docs``: ``doc_id``, ``text``; ``items``: ``item_id``, ``text``.  One row
    per row of ``docs`` and item, with the part of the text nearest to the item
    (the first of equal ones), if at most ``max_edits`` of the item's words are
    inserted, deleted or changed; of items with as many edits as that at least
    ``recall`` are found, of those with fewer more.  Words are letters and digits without case.
    Texts that are null or hold no word neither hold an item nor are one.  Ids
    may be null; equal rows of ``items`` count once, equal rows of ``docs``
    each; of equally near parts the first counts.  Other columns are left out,
    whatever their names.  An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_passes = max(1, ceil(size / item_bytes))
    spark = docs.sparkSession

    def scan(held) -> DataFrame:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in blocks_of(batches, "text", block_bytes):
                block = held.value
                hits = _hits(table, block)
                ids = table.column("doc_id").to_pylist()
                columns = [[ids[r] for r, *_ in hits], [block.items[n][0] for _, n, *_ in hits], [h[2] for h in hits], [h[3] for h in hits], [h[4] - 1 for h in hits], [len(block.items[n][1]) for _, n, *_ in hits]]
                places = pa.array([r for r, *_ in hits], pa.int64())
                kept = [table.column(c).combine_chunks().take(places) for c in carried]
                yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], *kept], names=["doc_id", "item_id", "edits", "first_word", "last_word", "item_words", *carried])

        return rows.mapInArrow(found, "doc_id long, item_id long, edits long, first_word long, last_word long, item_words long" + more)

    out = None
    for number in range(n_passes):
        # about item_bytes of item text on the driver and in each task at a time
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_passes)) == number).collect()
        block = tables_of([(r["item_id"], r["text"]) for r in part], max_edits, recall)
        found = scan(spark.sparkContext.broadcast(block))
        out = found if out is None else out.union(found)
    return out

