"""Operator 8: quality classifier by perplexity.

Method: an interpolated modified Kneser-Ney character model (module ``charlm``)
is trained on trusted text; hash-sharded joins with its n-gram table give the
perplexity of each document; a document is kept up to a quantile, per language,
of all trusted documents that are not trained on.  The mean over few
characters scatters more, so quantiles are taken of the excess of log
perplexity over that of the language, times the root of the length.
Contexts reach over a word's start to the kind of the last character of the word
before (all letters are one kind), so the order of words that end in letters is
not modelled.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import BLOCK_BYTES, Codes
from tablewise.llm.charlm import START, Coded, scores
from tablewise.llm.shared import written

ORDER = 5
#: One trusted document in this many is held back from the fit.
HELD_EVERY = 4
#: Quantile of held-back documents up to which documents stay, and the room above it.
QUANTILE, ROOM = 0.998, 1.1
#: A language's own limit counts as many times as it has held-back documents, that of all around its own level this often.
POOLED_WEIGHT = 500


def words_in_context(texts: list) -> Coded:
    """Blank-separated words, each told apart by how the word before it ends (any letter counts as one)."""
    codes, at, lengths = Codes(), array("I"), array("Q")
    for text in texts:
        words = text.split() if text else ()
        at.extend(map(codes.__getitem__, words))
        lengths.append(len(words))
    words, plain, sizes = list(codes), np.array(at, np.int64), np.array(lengths, np.int64)
    marks = Codes({"\n": 0})
    last = np.fromiter((marks["a" if w[-1].isalpha() else w[-1]] for w in words), np.int64, len(words))
    before = np.zeros(len(plain), np.int64)
    before[1:] = last[plain[:-1]]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    pairs, inverse = np.unique(plain * len(marks) + before, return_inverse=True)
    signs, clean = [m.replace(START, " ") for m in marks], [w.replace(START, " ") if START in w else w for w in words]
    strings = [f"{START}{signs[p % len(marks)]} {clean[p // len(marks)]} " for p in pairs.tolist()]
    return Coded(strings, np.arange(len(strings)), np.ones(len(strings), np.int64), inverse, sizes)


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, trusted_rows: int | None = None, quantile: float = QUANTILE, room: float = ROOM, block_bytes: int = BLOCK_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, ``excess``, ``limit``, ``keep`` and the columns ``carried`` for every row of ``docs``.

    ``docs``: ``doc_id``, ``text``, ``lang``; ``labels``: ``doc_id``,
    ``quality`` (1: trusted; an id that also has another label is not).  The
    model is fitted on all trusted documents but one in ``HELD_EVERY`` (with
    ``trusted_rows`` on those among so many ids with the smallest hashes), and
    limits are set on all others.  A null
    lang is a language of its own.  The limit of a language is the mean of its
    own quantile, weighted by its held-back documents, and that of all around
    its level (wider by what the level itself may be off), weighted by
    ``POOLED_WEIGHT``; one without any held-back document takes the latter, and
    the median of its documents as its level.  A null text, or one of white space only, has no
    perplexity and is rejected.  Without any trusted text nothing can be told:
    every document with words is kept.  Repeated rows stay; an empty table
    gives an empty result.
    """
    trusted = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("low"), F.max("quality").alias("high")).where("low = 1 and high = 1 and doc_id is not null").select("doc_id")
    sample = trusted if trusted_rows is None else trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_rows)
    learned = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_EVERY)) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *carried)
    found, classes = scores(rows, words_in_context, 3, order, True, block_bytes, learned)
    log = F.when(F.col("chars") > 0, -F.element_at("logs", 1) * F.lit(float(np.log(10))) / F.col("chars") if classes else F.lit(0.0))
    told = written(found.select("doc_id", F.col("lang"), F.coalesce("lang", F.lit("")).alias("of"), "chars", log.alias("log"), *carried), "perplexities")
    # without texts: a row of numbers for each held-back document
    held = written(told.where("chars > 0").join(trusted.join(learned, "doc_id", "left_anti"), "doc_id", "left_semi").select("of", "chars", "log"), "held")
    mean, n_chars = F.sum(F.col("log") * F.col("chars")) / F.sum("chars"), F.sum("chars")
    known = held.groupBy("of").agg(mean.alias("usual"), n_chars.alias("seen"), F.count(F.lit(1)).alias("n"))
    middle = told.where("chars > 0").groupBy("of").agg(F.percentile_approx("log", 0.5, 10_000).alias("middle"))
    levels = written(middle.join(known, "of", "left").select("of", F.coalesce("usual", "middle").alias("usual"), "seen", F.coalesce("n", F.lit(0)).alias("n")), "levels")  # one row per language
    over = ((F.col("log") - F.col("usual")) * F.sqrt("chars")).alias("excess")
    calibration = held.join(F.broadcast(levels), "of").select("of", "n", "seen", "chars", over)
    # the level of few documents follows them: their own excess is too small by as much
    own_share = F.greatest(1 - F.col("chars") / F.col("seen"), F.lit(1e-9))
    pooled = calibration.where("n > 1").agg(F.percentile_approx(F.col("excess") / F.sqrt(own_share), quantile, 100_000)).first()[0]
    every = room * pooled if pooled is not None else float("inf")
    limits = calibration.groupBy("of").agg((F.percentile_approx("excess", quantile, 100_000) * room).alias("own"))
    limits = levels.join(F.broadcast(limits), "of", "left")
    shared = F.lit(every) * F.sqrt(1 + F.coalesce(F.col("chars") / F.col("seen"), F.lit(0.0)))
    limit = F.when(F.col("own").isNull() | (F.col("n") < 2), shared).otherwise((F.col("own") * F.col("n") + shared * POOLED_WEIGHT) / (F.col("n") + POOLED_WEIGHT))
    above = told.join(F.broadcast(limits), "of", "left").select("doc_id", "lang", "log", *carried, over, limit.alias("limit"))
    keep = F.coalesce(F.col("excess") <= F.col("limit"), F.lit(False))
    return above.select("doc_id", "lang", F.exp("log").alias("perplexity"), "excess", "limit", keep.alias("keep"), *carried)
