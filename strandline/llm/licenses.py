"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame functions alone.

One pass over the texts stores a posting for each word that is a token of a template or of a base phrase, and for each
line end. Tokens are ordered by their frequency in the whole corpus, rarest first. A block that holds the share
``threshold`` of a template's distinct tokens must hold one of the template's rarest ones (its prefix), must have enough
distinct tokens (length), and from where that token stands in the order must have enough of them left, in the template
and in the block (position). Only texts with a prefix token are read further, only blocks that pass are counted in full,
and so the join is exact. Blocks are single lines, and for text that is wrapped every run of as many words as the template
has, across line feeds.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import GAP, LOWER, UPPER, ascii_lower, scoped, small, stored

THRESHOLD = 0.8
#: Rows of matched documents up to which they are broadcast, after they have been counted.
BROADCAST_ROWS = 100_000
#: Phrases that give a label by themselves.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates of one block each, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


#: The token that stands for a line end: no word, as words have no capitals A-Z.
LINE_END = "N"
_GAP_BUT_LINE_END = r"[\x00-\x2F\x3A-\x4D\x4F-\x60\x7B-\x7F]+"


class Order:
    """Tokens by rank, rarest in the corpus first, and each template and base phrase as ranks."""

    def __init__(self, seen: dict[str, int], threshold: float, templates, base: dict[str, str]):
        self.names = sorted(seen, key=lambda w: (seen[w], w))
        rank = {w: k for k, w in enumerate(self.names)}
        self.sets = [(n, label, sorted({rank[w] for w in _template_words(t)}), len(_template_words(t))) for n, (label, t) in enumerate(templates) if _template_words(t)]
        self.least = {n: max(1, math.ceil(threshold * len(ranks) - 1e-9)) for n, _, ranks, _ in self.sets}
        self.phrases = [([rank[w] for w in phrase.split()], label) for phrase, label in base.items()]

    def prefix(self, n: int, ranks: list[int]) -> list[int]:
        return ranks[: len(ranks) - self.least[n] + 1]

    def asked(self) -> list[int]:
        """Ranks of which a text must hold one to hold a block of any template, or a base phrase."""
        return sorted({r for n, _, ranks, _ in self.sets for r in self.prefix(n, ranks)} | {min(p) for p, _ in self.phrases})

    def table(self, spark) -> DataFrame:
        """(template, label, size, least, length, ranks, place, rank): a row for each prefix token of each template."""
        rows = [(n, label, len(ranks), self.least[n], length, ranks, at, r) for n, label, ranks, length in self.sets for at, r in enumerate(self.prefix(n, ranks))]
        return spark.createDataFrame(rows, "template int, label string, size int, least int, length int, ranks array<int>, place int, rank int")


def postings(docs: DataFrame, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, at, token): stored rows for all words of ``docs`` that are tokens asked for and for line ends
    (``at`` counts words and line ends), and one for each document whose first word is neither. ``row`` numbers documents."""
    vocabulary = sorted({w for _, t in templates for w in _template_words(t)} | {w for p in base for w in p.split()} | {LINE_END})
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.replace(ascii_lower(text), F.lit("\n"), F.lit(f" {LINE_END} "))
    w = docs.select(F.col(id_col).alias("id"), F.array_remove(F.split(marked, _GAP_BUT_LINE_END), "").alias("w"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("ends"))
    w = w.withColumn("row", F.monotonically_increasing_id())
    each = w.select("row", "id", (F.size("w") - F.col("ends")).cast("bigint").alias("n_words"), F.posexplode_outer("w").alias("at", "word"))
    token = F.when(F.col("word").isin(vocabulary), F.col("word"))
    return stored(each.select("row", "id", "n_words", F.coalesce("at", F.lit(0)).alias("at"), token.alias("token")).filter("token is not null or at = 0"), "license-postings")


def frequencies(found: DataFrame) -> dict[str, int]:
    """How many times each token occurs among postings. As many rows as templates and phrases have tokens."""
    counted = found.filter((F.col("token") != LINE_END)).groupBy("token").agg(F.count("*").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def read_further(found: DataFrame, order: Order) -> DataFrame:
    """(row, line, word, rank, and the ranks of the next words if they are tokens: next_1, ...) of all postings of texts
    that hold a token asked for; ``word`` numbers words, ``line`` lines."""
    spark = found.sparkSession
    ranked = F.broadcast(spark.createDataFrame([*enumerate(order.names), (-1, LINE_END)], "rank int, token string"))
    known = found.filter("token is not null").join(ranked, "token").select("row", "at", "rank")
    rows = stored(known.filter(F.col("rank").isin(order.asked())).select("row").distinct(), "license-rows")
    own = known.join(small(rows, BROADCAST_ROWS), "row", "left_semi")
    by_row = Window.partitionBy("row").orderBy("at")
    lined = own.withColumn("line", F.sum(F.when(F.col("rank") == -1, 1).otherwise(0)).over(by_row.rowsBetween(Window.unboundedPreceding, 0))).filter("rank >= 0")
    lined = lined.select("row", "line", (F.col("at") - F.col("line")).cast("int").alias("word"), "rank")
    by_word = Window.partitionBy("row").orderBy("word")
    longest = max((len(p) for p, _ in order.phrases), default=1)
    ahead = [F.when(F.lead("word", k).over(by_word) == F.col("word") + k, F.lead("rank", k).over(by_word)).alias(f"next_{k}") for k in range(1, longest)]
    return stored(lined.select("row", "line", "word", "rank", *ahead), "license-words")


def base_places(words_found: DataFrame, order: Order) -> DataFrame:
    """(row, places, base_labels): where base phrases stand, ascending, and their labels."""
    stands = [reduce(lambda x, y: x & y, [F.col("rank") == p[0], *(F.col(f"next_{k}") == r for k, r in enumerate(p[1:], 1))]) for p, _ in order.phrases]
    labels = F.array_compact(F.array(*(F.when(c, F.lit(label)) for c, (_, label) in zip(stands, order.phrases, strict=True)))) if stands else F.array().cast("array<string>")
    each = words_found.select("row", "word", F.explode(labels).alias("label"))
    return each.groupBy("row").agg(F.array_sort(F.collect_list("word")).alias("places"), F.array_sort(F.collect_set("label")).alias("base_labels"))


def join_lines(words_found: DataFrame, order: Order) -> DataFrame:
    """(row, label, containment): each line that holds at least the threshold of a template's distinct tokens."""
    blocks = words_found.groupBy("row", "line").agg(F.array_sort(F.collect_set("rank")).alias("own"))
    blocks = blocks.filter(F.size("own") >= min(order.least.values(), default=1))
    each = blocks.select("row", "line", "own", F.posexplode("own").alias("at", "rank"))
    met = each.join(F.broadcast(order.table(words_found.sparkSession)), "rank").filter("size(own) >= least and size - place >= least and size(own) - at >= least")
    met = met.select("row", "line", "template", "label", "size", "least", F.size(F.array_intersect("own", "ranks")).alias("n")).filter("n >= least")
    return met.select("row", "label", (F.col("n") / F.col("size")).alias("containment")).distinct()


def join_windows(words_found: DataFrame, order: Order) -> DataFrame:
    """(row, label, containment): of each text and template the fullest run of as many words as the template has, wherever
    lines end, if it holds at least the threshold of the template's distinct tokens."""
    table = F.broadcast(order.table(words_found.sparkSession))
    # texts with a prefix token of the template, and of those all words that are tokens of it
    pairs = words_found.select("row", "rank").distinct().join(table, "rank").select("row", "template", "label", "size", "least", "length", "ranks").distinct()
    met = words_found.select("row", "word", "rank").join(small(pairs, BROADCAST_ROWS), "row").filter(F.array_contains("ranks", F.col("rank")))
    met = met.groupBy("row", "template", "label", "size", "least", "length").agg(F.array_sort(F.collect_list(F.struct("word", "rank"))).alias("found"))
    met = met.filter("size(found) >= least").filter(F.size(F.array_distinct("found.rank")) >= F.col("least"))
    # a run may as well start with a token that counts; no more of them than its words stand in it
    held_from = lambda x, i: F.size(F.array_distinct(F.transform(F.filter(F.slice("found", i + 1, F.col("length")), lambda y: y["word"] < x["word"] + F.col("length")), lambda y: y["rank"])))
    best = met.withColumn("n", F.array_max(F.transform("found", held_from))).filter("n >= least")
    return best.select("row", "label", (F.col("n") / F.col("size")).alias("containment"))


@scoped
def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licenses of each document: (id, n_words, places, base_labels, labels, score), by lines and by runs of words that
    go over line ends.

    ``places`` are the word numbers where base phrases start, ascending; ``base_labels`` and ``labels`` (those of
    templates too) are sorted arrays; ``score`` is the largest containment, 1 where a base phrase stands, else 0. Null
    and empty texts have no words, places or labels. Rows that repeat an id and text each get the same result; null ids
    stay null and are labelled like others; an empty table gives no rows; other columns are not looked at.
    """
    found = postings(docs, templates, BASE, id_col, text_col)
    asked = {w for _, t in templates for w in _template_words(t)} | {w for p in BASE for w in p.split()}
    order = Order(dict.fromkeys(asked, 0) | frequencies(found), threshold, templates, BASE)
    further = read_further(found, order)
    blocks = join_lines(further, order).unionByName(join_windows(further, order))
    more = blocks.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    held = stored(base_places(further, order).join(more, "row", "full"), "licenses")
    rows = found.filter("at = 0").select("row", F.col("id").alias(id_col), "n_words")
    none, no_places = F.array().cast("array<string>"), F.array().cast("array<int>")
    labels = F.array_sort(F.array_distinct(F.concat(F.coalesce("base_labels", none), F.coalesce("more", none))))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    joined = rows.join(small(held, BROADCAST_ROWS), "row", "left")
    joined = joined.select(id_col, "n_words", F.coalesce("places", no_places).alias("places"), F.coalesce("base_labels", none).alias("base_labels"), labels.alias("labels"), score.alias("score"))
    return stored(joined, "license-labels", keep=True)


def scan_sql(docs: str = "documents", threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """DuckDB SQL for the digest of scan(): every block against every template, without filters."""
    cut = "list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    phrase = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    made = ", ".join(f"({n}, '{label}', [{', '.join(repr(w) for w in sorted(set(_template_words(t))))}])" for n, (label, t) in enumerate(templates))
    return f"""
    with d as (select row_number() over () as r, doc_id, text, {cut.format("text")} as w from {docs}),
    b as (select r, s, label from d, (values {phrase}) as p(phrase, label, n), unnest(range(len(w) - n + 1)) as t(s)
      where len(w) >= n and array_to_string(w[s + 1:s + n], ' ') = phrase),
    l as (select distinct r, list_distinct({cut.format("line")}) as w from (select r, unnest(string_split(coalesce(text, ''), chr(10))) as line from d)),
    c as (select r, label, len(list_intersect(l.w, t.w)) / len(t.w) as containment from l, (values {made}) as t(n, label, w)
      where len(list_intersect(l.w, t.w)) >= ceil({threshold} * len(t.w) - 1e-9)),
    bb as (select r, count(*) as n_base, min(s) as first_word, max(s) as last_word, array_to_string(list_sort(list(distinct label)), ',') as base_labels from b group by r),
    cc as (select r, max(containment) as containment from c group by r),
    ll as (select r, array_to_string(list_sort(list(distinct label)), ',') as labels from (select r, label from b union all select r, label from c) group by r)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
      coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(case when n_base > 0 then 1.0 else coalesce(containment, 0.0) end as double) as score
    from d left join bb on d.r = bb.r left join cc on d.r = cc.r left join ll on d.r = ll.r
    """
