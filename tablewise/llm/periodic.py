"""Operator 13: periodic runs of words, by a grammar.

Method: grammar-compressed run detection.  The word ids of a block of texts are
compressed by Re-Pair: a pair of neighbouring symbols that a text holds twice
becomes a nonterminal, frequent pairs first, until no text repeats a pair.  What
is left of each text (its start rule) is folded by halves.  Every run of a text
crosses the boundary between the two halves of some nonterminal, so the runs
that cross each nonterminal's boundary are computed once, on one of its
occurrences, and translated to all positions where the derivation has it;
intervals of one period that continue each other are merged into maximal ones.

The texts of a block share names of nonterminals, so copies in a block cost one
search.  Each text is compressed by its own repeats alone; the block it falls in
changes no result.  Nothing is shuffled: a task holds one block of texts or its
longest text, and the work on n words is in the order of n log n.

Periods across a boundary are proposed by equal word sequences beside it and
measured by prefix hashes with a bisection; every run is then compared word by
word, and a block with a clash of hashes is done again with other ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import code_words, each_block, starts_of

#: Text bytes of a block.
BLOCK_BYTES = 4_000_000
#: What a row counts in a block besides its text.
ROW_BYTES = 64
#: Words that a run has at least.
LEAST_WORDS = 12
#: Pairs of equal sequences looked at in one go.
CHUNK = 1_000_000
#: Two prime moduli of the prefix hashes, below 2^31 so that products fit 64 bits.
PRIMES = (2_147_483_647, 2_147_483_629)

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers that look random."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _maybe_twice(keys: np.ndarray) -> np.ndarray:
    """Positions of the keys that may occur twice; a key that does is always among them."""
    bits = max(10, int(len(keys)).bit_length() + 2)
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


class Grammar:
    """Re-Pair of the texts of a block, with the positions of every nonterminal.

    ``low``, ``middle``, ``high``: word positions of one occurrence of each
    nonterminal and of the boundary between its halves.  ``used``: pairs
    (nonterminal, position) of the whole derivation.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.size = np.ones(int(words.max()) + 1 if len(words) else 1, np.int64)
        self.n_words = len(self.size)
        self.low, self.middle, self.high = [], [], []
        self.used: list[tuple[np.ndarray, np.ndarray]] = []
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        at = np.arange(len(words), dtype=np.int64)
        rest = self._pairs(words.astype(np.int64), text, at)
        self._fold(*rest)
        self.low, self.middle, self.high = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.low, self.middle, self.high))

    def _pairs(self, seq: np.ndarray, text: np.ndarray, at: np.ndarray):
        """Replace repeated pairs round by round; returns the start rules."""
        done = []
        while len(seq) > 1:
            inside = np.flatnonzero(text[1:] == text[:-1])
            key = _mixed(seq[inside], 1) * np.uint64(3) + _mixed(seq[inside + 1], 2) + _mixed(text[inside], 3)
            maybe = _maybe_twice(key)
            inside = inside[maybe]
            _, which, count = np.unique(key[maybe], return_inverse=True, return_counts=True)
            often = count[which]
            inside, which, often = inside[often > 1], which[often > 1], often[often > 1]
            if not len(inside):
                break
            # texts without a repeated pair are done
            open_texts = np.zeros(int(text[-1]) + 1, bool)
            open_texts[text[inside]] = True
            going = open_texts[text]
            done.append((seq[~going], text[~going], at[~going]))
            rank = np.zeros(len(seq) + 1, np.int64)
            order = np.lexsort((which, often))  # more frequent pairs give way to none that is rarer
            by_rank = np.empty(len(order), np.int64)
            by_rank[order] = np.cumsum(np.diff(which[order], prepend=-1) != 0)
            rank[inside] = by_rank
            first = self._chosen(rank)
            new = self._named(seq[first], seq[first + 1], at[first])
            self.used.append((new, at[first]))
            seq[first] = new
            going[first + 1] = False
            seq, text, at = seq[going], text[going], at[going]
        done.append((seq, text, at))
        seq, text, at = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        return seq[order], text[order], at[order]

    @staticmethod
    def _chosen(rank: np.ndarray) -> np.ndarray:
        """Where a pair is replaced: no neighbouring pair ranks higher; every second one in a stretch of the same pair."""
        cut = np.flatnonzero(np.diff(rank, prepend=-1))
        value = rank[cut]
        before, after = np.append(-1, value[:-1]), np.append(value[1:], -1)
        top = (value > 0) & (value > before) & (value > after)
        length = np.diff(np.append(cut, len(rank)))[top]
        begin = cut[top]
        offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return (np.repeat(begin, length) + offset)[offset % 2 == 0]

    def _named(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(self.size)
        _, one, which = np.unique(left * n + right, return_index=True, return_inverse=True)
        a, b, low = left[one], right[one], at[one]
        self.low.append(low)
        self.middle.append(low + self.size[a])
        self.high.append(low + self.size[a] + self.size[b])
        self.size = np.concatenate([self.size, self.size[a] + self.size[b]])
        return n + which

    def _fold(self, seq: np.ndarray, text: np.ndarray, at: np.ndarray) -> None:
        """Join the symbols of each start rule two by two until one is left; each join is used once."""
        size = self.size[seq]
        while True:
            first_of = np.flatnonzero(np.diff(text, prepend=-1)) if len(text) else np.zeros(0, np.int64)
            if len(first_of) == len(text):
                return
            place = np.arange(len(text)) - np.repeat(first_of, np.diff(np.append(first_of, len(text))))
            left = np.flatnonzero((place[:-1] % 2 == 0) & (text[1:] == text[:-1]))
            n = len(self.size)
            self.low.append(at[left])
            self.middle.append(at[left] + size[left])
            size[left] += size[left + 1]
            self.high.append(at[left] + size[left])
            self.size = np.concatenate([self.size, size[left]])
            self.used.append((n + np.arange(len(left)), at[left]))
            stays = np.ones(len(text), bool)
            stays[left + 1] = False
            text, at, size = text[stays], at[stays], size[stays]


class Prefixes:
    """Prefix hashes of the words of a block; compares two sequences of any length at once."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for prime in PRIMES:
            p = np.uint64(prime)
            base = np.uint64(rng.integers(1 << 20, prime - 1))
            power = np.ones(len(words) + 1, np.uint64)
            if len(words):
                power[1] = base
            known = 2
            while known < len(power):
                step = power[known - 1] * base % p
                power[known : 2 * known] = power[: min(known, len(power) - known)] * step % p
                known *= 2
            values = (_mixed(words, int(rng.integers(1 << 62))) >> np.uint64(34)) * power[:-1] % p
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)]))
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` are those from ``b`` (``a`` < ``b``)."""
        same = np.ones(len(a), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers):
            p = np.uint64(prime)
            same &= (sums[a + n] - sums[a]) % p * powers[b - a] % p == (sums[b + n] - sums[b]) % p
        return same

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` are those from ``b``, at most ``most``."""
        return self._bisect(lambda n, k: self.equal(a[k], b[k], n), most)

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``a`` are those before ``b``, at most ``most``."""
        return self._bisect(lambda n, k: self.equal(a[k] - n, b[k] - n, n), most)

    @staticmethod
    def _bisect(holds, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), np.maximum(most, 0)
        while len(k := np.flatnonzero(low < high)):
            n = (low[k] + high[k] + 1) // 2
            good = holds(n, k)
            low[k] = np.where(good, n, low[k])
            high[k] = np.where(good, high[k], n - 1)
        return low


def _sequences(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of ``n`` words that a text may hold twice: (group * words + position) sorted, position -> group, the groups' factor."""
    group = np.full(len(words), -1, np.int64)
    if len(words) < n:
        return np.zeros(0, np.int64), group, group
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    last = len(words) - n + 1
    at = np.flatnonzero(text[:last] == text[n - 1 :])
    key = _mixed(text[at], 5)
    for k in range(n):
        key = key * np.uint64(0x2545F4914F6CDD1D) + _mixed(words[at + k], 6)
    key = _mixed(key, 7)
    maybe = _maybe_twice(key)
    at = at[maybe]
    _, which, count = np.unique(key[maybe], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    at, which = at[twice], which[twice]
    group[at] = which
    return np.sort(which * len(words) + at), group, at


def _ranges(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range one after the other, and the range each belongs to."""
    owner = np.repeat(np.arange(len(begin)), length)
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - begin, length), owner


def _crossing(words: np.ndarray, starts: np.ndarray, grammar: Grammar, hashes: Prefixes, least: int) -> tuple[np.ndarray, ...]:
    """(nonterminal, start, end, period) of the runs that cross the boundary of each nonterminal's one occurrence."""
    wide = np.flatnonzero(grammar.high - grammar.low >= least)
    low, middle, high = grammar.low[wide], grammar.middle[wide], grammar.high[wide]
    # a run of period q has at least max(q, least - q) words that equal the word q later, all beside one of two known places:
    # so many in a row, that place included, lie to its left or to its right
    n = ((least + 1) // 2) // 2 + 1
    index, group, _ = _sequences(words, starts, n)
    out: list[tuple[np.ndarray, ...]] = []
    anchors = []
    for x in (middle, middle - n + 1):
        known = np.flatnonzero((x >= low) & (group[np.minimum(x, len(words) - 1)] >= 0)) if len(words) else np.zeros(0, np.int64)
        most = (high[known] - low[known]) // 2
        base = group[x[known]] * len(words)
        first = np.searchsorted(index, base + np.maximum(x[known] - most, low[known]))
        last = np.searchsorted(index, base + np.minimum(x[known] + most, high[known] - 1), "right")
        anchors.append((known, x[known], first, last - first))
    node, place, first, count = (np.concatenate(x) for x in zip(*anchors))
    order = np.argsort(node, kind="stable")
    node, place, first, count = node[order], place[order], first[order], count[order]
    ends = np.cumsum(count)
    start = 0
    while start < len(node):
        before = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, before + CHUNK)), start + 1)
        while stop < len(node) and node[stop] == node[stop - 1]:
            stop += 1
        found, owner = _ranges(first[start:stop], count[start:stop])
        period = np.abs(index[found] % len(words) - place[start:stop][owner])
        own = node[start:stop][owner]
        pairs = np.unique(own[period > 0] * np.int64(len(words) + 1) + period[period > 0])
        own, period = pairs // (len(words) + 1), pairs % (len(words) + 1)
        for here in (middle[own] - period, middle[own]):
            fits = (here >= low[own]) & (here < high[own] - period)
            k, h, p = own[fits], here[fits], period[fits]
            ahead = hashes.forward(h, h + p, high[k] - p - h)
            k, h, p, ahead = k[ahead > 0], h[ahead > 0], p[ahead > 0], ahead[ahead > 0]
            behind = hashes.backward(h, h + p, h - low[k])
            begin, end = h - behind, h + ahead + p
            long = end - begin >= np.maximum(least, 2 * p)
            out.append((wide[k[long]], begin[long], end[long], p[long]))
        start = stop
    node, begin, end, period = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    # a multiple of the smallest period has the same interval
    order = np.lexsort((period, end, begin, node))
    node, begin, end, period = node[order], begin[order], end[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    return node[new], begin[new], end[new], period[new]


def _merged(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one period that share so many words are one; sorted by start, then period."""
    if not len(begin):
        return begin, end, period
    order = np.lexsort((begin, period))
    begin, end, period = begin[order], end[order], period[order]
    far = np.int64(end.max()) + 1
    reach = np.maximum.accumulate(period * far + end) - period * far  # a longer period lies beyond all ends of a shorter one
    new = np.ones(len(begin), bool)
    new[1:] = (period[1:] != period[:-1]) | (begin[1:] > reach[:-1] - period[1:])
    cut = np.flatnonzero(new)
    begin, end, period = begin[cut], np.maximum.reduceat(end, cut), period[cut]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _exact(words: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether each interval has its period and no neighbouring word of its text extends it."""
    text_of = np.searchsorted(starts, begin, "right") - 1
    low, high = starts[text_of], starts[text_of + 1]
    for s, e, p, a, b in zip(begin.tolist(), end.tolist(), period.tolist(), low.tolist(), high.tolist()):
        if e > b or not np.array_equal(words[s : e - p], words[s + p : e]):
            return False
        if (s > a and words[s - 1] == words[s - 1 + p]) or (e < b and words[e] == words[e - p]):
            return False
    return True


def runs_of_words(words: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, as positions in the texts laid one after the other."""
    starts = starts_of(lengths)
    grammar = Grammar(words, starts)
    used = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*grammar.used)] or [np.zeros(0, np.int64)] * 2
    node_at = used[0] - grammar.n_words
    order = np.argsort(node_at, kind="stable")
    positions = used[1][order]
    first_use = np.searchsorted(node_at[order], np.arange(len(grammar.low) + 1))
    seed = 0
    while True:
        node, begin, end, period = _crossing(words, starts, grammar, Prefixes(words, seed), least)
        places, which = _ranges(first_use[node], np.diff(first_use)[node])
        shift = positions[places] - grammar.low[node][which]
        found = _merged(begin[which] + shift, end[which] + shift, period[which])
        if _exact(words, starts, *found):
            return found
        seed += 1


def _collapsed(table: pa.Table, least: int) -> pa.RecordBatch:
    """Runs and kept words of the texts of a block."""
    texts = table.column("text").cast(pa.binary()).to_pylist()
    known, words, lengths = code_words(texts)
    starts = starts_of(lengths)
    begin, end, period = runs_of_words(words, lengths, least)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change)[:-1] == 0
    text_of = np.searchsorted(starts, begin, "right") - 1
    cuts = np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(begin - starts[text_of], pa.int64()), pa.array(end - begin, pa.int64()), pa.array(period, pa.int64())], fields=list(_RUN))
    changed = np.zeros(len(texts), bool)
    changed[text_of] = True
    collapsed = []
    for k, text in enumerate(texts):
        if changed[k]:
            a, b = int(starts[k]), int(starts[k + 1])
            collapsed.append(b" ".join([known[c] for c in words[a:b][kept[a:b]].tolist()]))
        else:
            collapsed.append(b" ".join(text.split()) if text else b"")
    return pa.record_batch(
        [table.column("doc_id").combine_chunks(), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of words of every whole text and the text without the repeats.

    ``docs``: ``doc_id`` (long), ``text``; other columns are left out, whatever
    their names.  Words are what ASCII white space parts.  A run is a stretch of
    words with smallest period q, at least ``least`` and at least 2q words, that
    no neighbouring word extends.  Result, one row per input row, repeated rows
    included: ``doc_id``, ``n_words``, ``runs`` (start from 0, length, period; by
    start, then period) and ``collapsed``: the words joined by one blank, without
    those that a run contains after its first q words.  A null or empty text, or
    one of white space, has no words, no runs and the empty text; a null doc_id
    stays null; an empty table gives an empty result.  A text longer than a block
    is a block of its own.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each_block(batches, lambda table: iter([_collapsed(table, least)]), block_bytes, ROW_BYTES)

    return rows.mapInArrow(found, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the kept words."""
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))[0]
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.when(F.size("runs") > 0, best)
    length = -longest["n"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        longest["period"].alias("period"),
        F.floor(length * 1000 / longest["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
