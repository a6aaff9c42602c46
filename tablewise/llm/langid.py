"""Operator 4: language identification.

Method: one interpolated Kneser-Ney character model per language (module
``charlm``) over the letters of words; the language with the lowest
cross-entropy per character is chosen.  Rejection is calibrated on labelled
documents that are kept out of the models and told right: a text is rejected
where its cross-entropy lies further above the median of its language than
random variation at its length explains.  Median and median deviation do not
move with a minority of strange documents, so these cannot widen the limit.
"""

from __future__ import annotations

from array import array

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.blocks import BLOCK_BYTES, Codes
from tablewise.llm.charlm import START, Coded, scores
from tablewise.llm.shared import written

ORDER = 5
#: One labelled text in this many is kept out of the models to set the limits.
HELD_EVERY = 10
#: How many standard deviations, as the median deviation tells them, a text may lie above the median of its language.
DEVIATIONS = 6.0
#: A language's own deviation counts as many times as it has held texts, that of all this often.
POOLED_WEIGHT = 30


def letters_of(texts: list) -> Coded:
    """Blank-separated words of the texts; the strings are their runs of letters, lower-cased, with an end mark."""
    codes, at, lengths = Codes(), array("I"), array("Q")
    for text in texts:
        words = text.split() if text else ()
        at.extend(map(codes.__getitem__, words))
        lengths.append(len(words))
    find, runs, parts, n_parts = regex.compile(r"\p{L}+").findall, Codes(), array("I"), array("I")
    for word in codes:
        low = word.lower()
        found = (low,) if low.isalpha() else find(low)
        parts.extend(map(runs.__getitem__, found))
        n_parts.append(len(found))
    return Coded([f"{START}{r}\x03" for r in runs], np.array(parts, np.int64), np.array(n_parts, np.int64), np.array(at, np.int64), np.array(lengths, np.int64))


def identify(docs: DataFrame, learns: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``cross_entropy`` (bits per character), ``rejected``, the columns ``carried`` for every row.

    ``docs``: ``doc_id``, ``text``, ``lang``; learns from rows for which
    ``learns`` holds and lang is not null, except for one text in ``HELD_EVERY``,
    which sets the limits where it is told as its lang.  ``score`` is the
    probability of the language among those learned.  A null text, and one without a letter, is
    ``und`` with score 0 and rejected.  Ties go to the language that sorts
    first.  Repeated rows stay; without anything to learn all rows are ``und``.
    A language without held texts is measured by those of all; where there are
    none at all, no text with a letter is rejected.
    An empty table gives an empty result.
    """
    lang = F.when(learns & F.col("lang").isNotNull(), F.col("lang").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("known"), *carried)
    held = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(HELD_EVERY)) == 0, F.lit(False))  # copies are held together
    # one row per language: those whose texts would all be held learn from them instead
    few = [r["known"] for r in rows.where("known is not null").groupBy("known").agg(F.count_if(~held).alias("n")).where("n = 0").collect()]
    held = held & F.col("known").isNotNull() & ~F.col("known").isin(few) if few else held & F.col("known").isNotNull()
    rows = rows.withColumn("held", F.coalesce(held, F.lit(False)))
    rows = rows.select("doc_id", "text", "known", "held", F.when(~F.col("held"), F.col("known")).alias("class"), *carried)
    found, classes = scores(rows, letters_of, 1, order, False, block_bytes)
    if not classes:
        return found.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"), *carried)
    best = F.array_max("logs")
    pred = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("logs", best).cast("int"))
    share = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), F.greatest(x - best, F.lit(-300.0))))
    told = written(
        found.select(
            "doc_id", "known", "held", "chars", F.when(F.col("chars") > 0, pred).otherwise("und").alias("lang_pred"),
            F.when(F.col("chars") > 0, share).otherwise(0.0).alias("score"), F.when(F.col("chars") > 0, -best / F.col("chars") / F.lit(float(np.log10(2)))).alias("cross_entropy"), *carried,
        ),
        "languages",
    )
    right = told.where("held and chars > 0 and lang_pred = known")
    middle = lambda x: F.percentile_approx(x, 0.5, 10_000)
    usual, all_usual = right.groupBy("lang_pred").agg(middle("cross_entropy").alias("usual")), right.agg(middle("cross_entropy")).first()[0]
    # one row per language
    above = told.join(F.broadcast(usual), "lang_pred", "left").withColumn("above", (F.col("cross_entropy") - F.coalesce("usual", F.lit(all_usual).cast("double"))) * F.sqrt("chars"))
    calibration = above.where("held and chars > 0 and lang_pred = known")
    centres = calibration.groupBy("lang_pred").agg(middle("above").alias("centre"), F.count(F.lit(1)).alias("n"))
    off = calibration.join(F.broadcast(centres), "lang_pred").withColumn("off", F.abs(F.col("above") - F.col("centre")))
    spreads, all_spread = off.groupBy("lang_pred").agg(middle("off").alias("spread")), off.agg(middle("off")).first()[0]
    # 1.4826 median deviations are the standard deviation of a normal distribution
    spread = (F.col("spread") * F.col("n") + F.lit(all_spread).cast("double") * POOLED_WEIGHT) / (F.col("n") + POOLED_WEIGHT)
    limits = centres.join(F.broadcast(spreads), "lang_pred").select("lang_pred", (F.col("centre") + DEVIATIONS * 1.4826 * spread).alias("limit"))
    limit = F.coalesce("limit", F.lit(DEVIATIONS * 1.4826 * all_spread if all_spread is not None else float("inf")))
    rejected = F.col("cross_entropy").isNull() | F.coalesce(F.col("above") > limit, F.lit(False))
    return above.join(F.broadcast(limits), "lang_pred", "left").select("doc_id", "lang_pred", "score", "cross_entropy", rejected.alias("rejected"), *carried)
