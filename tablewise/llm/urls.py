"""Operator 10: URL filter by rules and a character language-model ratio.

Method: two smoothed variable-order Markov models over the characters of URLs,
one of URLs that rules accept and one of URLs that rules reject.  A character's
probability mixes its contexts from the longest down (each context leaves to
the next shorter one a share that grows with the number of different characters
seen after it).  The log-likelihood difference per character decides where no
rule fits, at a limit calibrated on ruled URLs kept out of the models.

Column expressions, joins and groupings only.  A character n-gram that all URLs
share is spread over salted copies of its model row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import written

#: Rules (verdict, host and path): fixed by the contract of the filter.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ORDER = 5
SALTS = 32
#: One ruled URL in this many is kept out of the models to set the limit.
HELD_EVERY = 5
#: Width of the bins in which held-out ratios are counted.
BIN = 0.0001
#: 128 bits that stand for a url.
ID = ["id1", "id2"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host behind the first :// with A-Z lower-cased, and path; both empty for null or no ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substr(url, locate('://', url) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(slash + own_path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(rows: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """One row per character: the n-gram of at most ``order`` characters that ends there, behind a start mark.

    Only ``keep`` goes with it, never the text, and the text is cut into its
    characters once, so that a long one costs in proportion to its length.
    """
    characters = F.filter(F.split(F.concat(F.lit("\u0002"), F.col("text")), ""), lambda c: c != "")
    cut = rows.where("text <> ''").select(*keep, characters.alias("t"))
    each = cut.select(*keep, F.explode(F.transform(
        F.sequence(F.lit(2), F.size("t")),
        lambda i: F.array_join(F.slice("t", F.greatest(i - (order - 1), F.lit(1)), F.least(i, F.lit(order))), ""),
    )).alias("gram"))
    return each.where(F.length("gram") > 1)


def _salted(model: DataFrame, rows: DataFrame, key: str, length: int = 2, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """``model`` with as many copies of the rows of short keys as there are salts, ``rows`` with a salt where the key is short."""
    copies = F.when(F.length(key) <= length, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.length(key) <= length, F.pmod(F.xxhash64("gram"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    return model.withColumn("salt", F.explode(copies)), rows.withColumn("salt", salt)


def log_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``gram``, ``ratio``: log10 of its last character's probability if accepted less that if rejected.

    ``counts``: ``gram``, ``yes``, ``no``: n-grams of every length up to the order with their counts.
    """
    kinds = ["yes", "no"]
    by_context = counts.withColumn("context", F.expr("left(gram, length(gram) - 1)")).groupBy("context").agg(*[F.sum(k).alias(f"n_{k}") for k in kinds], *[F.count_if(F.col(k) > 0).alias(f"t_{k}") for k in kinds])
    letters = F.greatest(F.lit(1), counts.where(F.length("gram") == 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] + F.lit(1))
    chain = grams.select("gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("k")).withColumn("s", F.expr("right(gram, k)")).withColumn("context", F.expr("left(s, k - 1)"))
    # a short context stands before a good part of all n-grams, the empty one before all: salted copies of its row
    by_context, chain = _salted(by_context, chain, "context")
    model, chain = _salted(counts.withColumnRenamed("gram", "s"), chain.join(by_context, ["context", "salt"], "left").drop("salt"), "s")
    chain = chain.join(model, ["s", "salt"], "left").drop("salt")
    values = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for k in kinds for c in (k, f"n_{k}", f"t_{k}")]
    steps = chain.select("gram", F.struct("k", *values).alias("x")).groupBy("gram").agg(F.array_sort(F.collect_list("x")).alias("steps"))

    def mixed(kind: str):
        return lambda p, x: F.when(x[f"n_{kind}"] > 0, (x[kind] + x[f"t_{kind}"] * p) / (x[f"n_{kind}"] + x[f"t_{kind}"])).otherwise(p)

    logs = [F.log10(F.aggregate("steps", (1 / letters).cast("double"), mixed(k))) for k in kinds]
    return steps.select("gram", (logs[0] - logs[1]).alias("ratio"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, order: int = ORDER, salts: int = SALTS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``ratio`` (per character) of every row.

    ``pages``: ``page_id``, ``url``.  A rule fits its host and all subdomains
    where the path begins with the rule's; the longest decides.  Where none fits
    the verdict is ``allow`` if the ratio reaches the calibrated limit.  A null
    or empty url has no character and ratio 0; so has every url while the rules
    accept or reject none, and then all are allowed.  Repeated rows stay, equal
    urls get equal verdicts; ids may be null.  A url of any length is judged
    whole.  Other columns are left out, whatever their names.  An empty table
    gives an empty result.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules or RULES)
    rows = written(rows.select("page_id", "host", "path", F.coalesce("url", F.lit("")).alias("text"), rule.alias("rule"), verdict.alias("ruled")), "urls")
    # a url's rule follows from its text; past this point 128 bits stand for the text
    id_of = [F.xxhash64(F.lit(k), "text").alias(f"id{k}") for k in (1, 2)]
    rows = rows.select("*", *id_of)
    texts = written(rows.groupBy(*ID).agg(F.first("ruled").alias("ruled"), F.first("text").alias("text")), "url-texts")
    learns = texts.where("ruled is not null").withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_EVERY)) == 0)
    own = _grams(learns.where("not held").withColumn("yes", F.col("ruled") == "allow"), order, ["yes"]).groupBy("yes", "gram").agg(F.count(F.lit(1)).alias("n"))
    suffixes = own.select("yes", "n", F.explode(F.expr("transform(sequence(1, length(gram)), k -> right(gram, k))")).alias("gram"))
    counts = written(suffixes.where("gram <> '\u0002'").groupBy("gram").agg(F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("yes"), 0).otherwise(F.col("n"))).alias("no")), "url-counts")
    each = _grams(texts, order, ID).groupBy(*ID, "gram").agg(F.count(F.lit(1)).alias("n"))
    each = written(each, "url-grams")
    ratios = log_ratios(each.select("gram").distinct(), counts)
    salted = each.withColumn("salt", F.pmod("id1", F.lit(salts)).cast("int"))
    copies = ratios.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # sums of decimals do not depend on their order
    total = salted.join(copies, ["gram", "salt"]).groupBy(*ID).agg((F.sum((F.col("ratio") * F.col("n")).cast("decimal(28,12)")).cast("double") / F.sum("n")).alias("ratio"))
    known = counts.agg((F.sum("yes") > 0) & (F.sum("no") > 0)).first()[0]
    scored = written(texts.select(*ID).join(total, ID, "left").select(*ID, (F.coalesce("ratio", F.lit(0.0)) if known else F.lit(0.0)).alias("ratio")), "url-ratios")
    limit = _limit(learns.where("held"), scored) if known else 0.0
    decided = F.coalesce("ruled", F.when(F.col("ratio") >= limit, "allow").otherwise("block"))
    return rows.join(scored, ID).select("page_id", "host", "path", "rule", decided.alias("verdict"), "ratio")


def _limit(held: DataFrame, scored: DataFrame) -> float:
    """Half way between the ratio that nine in ten accepted urls reach and that which nine in ten rejected ones do not.

    Ratios are counted in bins of ``BIN`` first, so the quantiles see as many
    rows as there are bins, whatever the number of urls, and are exact to a bin.
    """
    binned = F.floor(F.col("ratio") / BIN + 0.5) * BIN
    told = held.join(scored, ID).groupBy("ruled", binned.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    quantile = lambda kind, share: F.percentile(F.when(F.col("ruled") == kind, F.col("bin")), F.lit(share), F.col("n"))
    low, high = told.agg(quantile("allow", 0.1), quantile("block", 0.9)).first()
    return (low + high) / 2 if low is not None and high is not None else 0.0
