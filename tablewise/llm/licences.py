"""Operator 6: licence scan by sentence rules.

Method: a text is cut into sentences, each normalised sentence, and each run of
whole lines in one, that is known becomes its identifier, and the sequence of identifiers is matched against
ordered licence rules.  That is column expressions over one row, a document
being whole in it; only matches are shuffled, to drop those inside longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, normalised (letters and digits, lower case),
# and for each licence the sentences that make it up, in their order.
SENTENCES = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.title": "the mit license mit",
    "mit.title2": "mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache.notice": "licensed under the apache license version 2 0",
    "apache.header": "licensed under the apache license version 2 0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "bsd.use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.notice": "licensed under cc by 4 0",
    "ccby4.work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa4.work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "mpl2.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "rights.all": "all rights reserved",
}
RULES = [
    ("MIT", ["mit.notice"]),
    ("MIT", ["mit.notice2"]),
    ("MIT", ["mit.grant", "mit.as_is"]),
    ("MIT", ["mit.grant", "mit.as_is", "mit.liability"]),
    ("Apache-2.0", ["apache.notice"]),
    ("Apache-2.0", ["apache.header", "apache.comply"]),
    ("Apache-2.0", ["apache.header", "apache.comply", "apache.copy", "apache.see"]),
    ("GPL-3.0-only", ["gpl3.notice"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.hope"]),
    ("GPL-3.0-or-later", ["gpl.free", "gpl.hope", "gpl.see"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.hope"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.hope", "gpl.see"]),
    ("BSD-2-Clause", ["bsd.use", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.use", "bsd.source", "bsd.binary", "bsd.names"]),
    ("CC-BY-NC-4.0", ["ccbync4.notice"]),
    ("CC-BY-4.0", ["ccby4.notice"]),
    ("CC-BY-4.0", ["ccby4.work"]),
    ("CC-BY-SA-4.0", ["ccbysa4.work"]),
    ("MPL-2.0", ["mpl2.form"]),
    ("Unlicense", ["unlicense.free"]),
    ("All-rights-reserved", ["rights.all"]),
]

#: Unknown sentences that may stand between two of a rule.
GAP = 2


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def sentences_of(text: Column) -> Column:
    """(sentence number, text) in order: cut behind . ! ? with white space after it."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001")
    return F.transform(cut, lambda s, number: F.struct(number.alias("at"), s.alias("s")))


def _lines(s: Column) -> Column:
    """The normalised lines that hold a word, each between two | signs; list marks such as 1) or (a) are left out."""
    bare = F.transform(F.split(s, "\n"), lambda x: normalised(F.regexp_replace(x, r"^[\s*#/]*\(?[0-9A-Za-z]{1,2}\)\s+", "")))
    return F.concat(F.lit("|"), F.array_join(F.filter(bare, lambda x: x != ""), "|"), F.lit("|"))


def _marked(lines: Column, found: Column) -> Column:
    """``lines`` with a mark and the number of the known sentence before each place where one stands, from the
    beginning of a line to the end of one, however it is wrapped.

    One pass over the lines for each sentence that occurs in them.  Marks of
    sentences before are skipped inside a sentence and stay before a new one at
    the same place.
    """
    gap = "(?:(?:\u0001[0-9]+\u0002)*[ |])"

    def with_marks(marked: Column, k: Column) -> Column:
        wrapped = F.concat(F.lit("(?=\\|"), F.replace(k["s"], F.lit(" "), F.lit(gap)), F.lit("(?:\u0001[0-9]+\u0002)*\\|)"))
        return F.regexp_replace(marked, wrapped, F.concat(F.lit("\u0001"), k["id"].cast("string"), F.lit("\u0002")))

    return F.aggregate(found, lines, with_marks)


def identified(text: Column, sentences: list[str]) -> Column:
    """(sentence number, place of the known sentence in the list from 1) in order of the text.

    A line break inside a sentence is white space.  So that headings, copyright
    lines, lists and comment marks around it do not hide a known sentence, it is
    looked for in a sentence as a whole and behind that in every run of whole
    lines, under the same number and in order of their beginnings.
    """
    known = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(s).alias("s")) for k, s in enumerate(sentences, 1)])
    plain, least = F.array(*[F.lit(s) for s in sentences]), min(map(len, sentences))
    long_enough = F.filter(sentences_of(text), lambda x: F.length(x["s"]) >= least)
    parts = F.transform(
        long_enough,
        lambda x: F.struct(x["at"].alias("at"), normalised(x["s"]).alias("s"), F.when(F.contains(x["s"], F.lit("\n")), _lines(x["s"])).alias("lines")),
    )
    parts = F.transform(parts, lambda x: F.struct(x["at"].alias("at"), x["s"].alias("s"), x["lines"].alias("lines"), F.replace(x["lines"], F.lit("|"), F.lit(" ")).alias("flat")))

    def whole(x: Column) -> Column:
        return F.filter(F.array(F.struct(x["at"].alias("at"), F.array_position(plain, x["s"]).cast("int").alias("id"))), lambda y: y["id"] > 0)

    def inside(x: Column) -> Column:
        # the whole sentence over several lines is found already
        near = F.filter(known, lambda k: F.contains(x["flat"], k["s"]) & (F.contains(x["lines"], F.concat(F.lit("|"), k["s"], F.lit("|"))) | (k["s"] != x["s"])))
        marks = F.regexp_extract_all(_marked(x["lines"], near), F.lit("\u0001([0-9]+)\u0002"), F.lit(1))
        return F.transform(marks, lambda y: F.struct(x["at"].alias("at"), y.cast("int").alias("id")))

    none = F.array().cast("array<struct<at:int,id:int>>")
    return F.flatten(F.transform(parts, lambda x: F.concat(whole(x), F.when(x["lines"].isNotNull(), inside(x)).otherwise(none))))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """``doc_id``, ``licence``, ``rule`` (identifiers), ``first_sentence``, ``last_sentence`` of every match.

    A rule matches where its identifiers follow each other in order with no
    other known sentence and at most ``gap`` unknown ones between two of them;
    a match inside a longer one is left out.  Sentence numbers begin at 0.
    Null and empty texts, texts without a known sentence, and empty tables give
    no row; repeated rows give their matches each, and a sentence that a text
    repeats gives a match each time; matches of equal length at one place all
    stay.  doc_id may be null; other columns are left out, whatever their names.
    The work on a text grows in proportion to its length.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    names = list(sentences)
    # identifiers are places in the fixed lists, from 1
    found = identified(F.col("text"), list(sentences.values()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = rows.select("doc_id", found.alias("found")).where(F.size("found") > 0)
    # arrays of their own: fields of "found" would be cut out anew at every place
    rows = rows.select("doc_id", F.transform("found", lambda x: x["id"]).alias("ids"), F.transform("found", lambda x: x["at"]).alias("at"))
    matches = []
    for number, (licence, wanted) in enumerate(rules):
        ids = [names.index(w) + 1 for w in wanted]
        n = len(ids)
        begins = F.when(F.size("ids") >= n, F.filter(F.sequence(F.lit(0), F.greatest(F.size("ids") - n, F.lit(0))), _rule_fits(ids, gap))).otherwise(F.array().cast("array<int>"))
        matches.append(F.transform(begins, _match(licence, wanted, n)))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.flatten(F.array(*matches)).alias("m")).where(F.size("m") > 0)
    each = rows.select("doc_id", "row", F.explode("m").alias("m")).select("doc_id", "row", "m.*", F.size("m.rule").alias("n"))
    # a longer match that begins no later and ends no earlier; rules have few lengths, so one running maximum for each will do
    before = Window.partitionBy("row").orderBy("first_sentence").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    lengths = sorted({len(wanted) for _, wanted in rules})
    covered = F.coalesce(*[F.when(F.col("n") == n, F.max(F.when(F.col("n") > n, F.col("last_sentence"))).over(before)) for n in lengths])
    best = each.withColumn("covered", covered).where(F.col("covered").isNull() | (F.col("covered") < F.col("last_sentence")))
    return best.select("doc_id", "licence", "rule", "first_sentence", "last_sentence")


def _rule_fits(ids: list[int], gap: int):
    """Whether the identifiers from place i on are ``ids`` with small gaps."""

    def fits(i: Column) -> Column:
        out = F.slice("ids", i + 1, F.lit(len(ids))) == F.array(*[F.lit(k) for k in ids])
        for k in range(1, len(ids)):
            out = out & (F.get("at", i + k) - F.get("at", i + (k - 1)) <= gap + 1)
        return out

    return fits


def _match(licence: str, wanted: list[str], n: int):
    def made(i: Column) -> Column:
        return F.struct(F.lit(licence).alias("licence"), F.array(*[F.lit(w) for w in wanted]).alias("rule"), F.get("at", i).alias("first_sentence"), F.get("at", i + (n - 1)).alias("last_sentence"))

    return made
