"""Licence notices found by a positional index of their rarest words.

Words are runs of ASCII letters and digits and of any characters beyond ASCII; A-Z count as a-z.

1. How many documents hold each word of the notices is counted over all documents. The words that the fewest
   documents hold (highest IDF, ties by the word) stand in the index, each with its places in the notice.
2. Every document's words are looked up there. A word at place i of the document and place j of a notice says
   that the notice begins at i - j; the index words that say the same place are counted.
3. A notice is found where enough of its index words agree on a place and the document has the phrases
   that the notice cannot do without. The best share of agreeing index words is the score.

Everything is DataFrame expressions. The texts are read twice and never shuffled: only the index words found go
on, keyed by document, notice and place, so neither a long document nor a frequent word makes a large group.
The index has a few words per notice and is broadcast; its size does not depend on the documents.

Defined cases: null, empty and blank texts have no words, no places and no labels, and score 0; repeated rows get
equal results each; an empty table gives no rows; ties between places go to the one with the most agreeing
words, whichever it is; further columns pass through ``scan``, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastmile.llm.common import cut, table

INDEX_WORDS = 6  # of each notice
LEAST_SHARE = 0.7  # of a notice's index words must agree on its place
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words in lower case, one space between
    phrases: tuple[str, ...]  # all of them must stand in a document that has the notice


# The public wording of licence notices.
NOTICES = (
    Notice("agpl", "the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Notice("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    Notice("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Notice("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Notice("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Notice("lgpl", "the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Notice("mit", "released under the mit license", ("the mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Notice("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def word_list(text: Column) -> Column:
    """Words of a text in lower case; empty for null. Only A-Z change; ``lower`` does just that for ASCII texts."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BREAKS), "")


def starts(found: Column, spaced: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands."""
    wanted = phrase.split(" ")
    some = F.array_compact(F.transform(found, lambda w, i: F.when(w == wanted[0], i)))
    checked = F.filter(some, lambda i: F.slice(found, i + 1, len(wanted)) == F.array(*map(F.lit, wanted)))
    return F.when(spaced.contains(f" {phrase} "), F.transform(checked, lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>"))


def has_all(spaced: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (spaced.contains(f" {phrase} ") for phrase in phrases), F.lit(True))


def index_of(docs: DataFrame, text: str, notices: tuple[Notice, ...], many: int) -> list[tuple[int, str, int]]:
    """(notice, word, place) of the words of each notice that the fewest documents hold."""
    vocabulary = sorted({w for notice in notices for w in notice.text.split(" ")})
    held = F.array_intersect(word_list(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    documents = {row["word"]: row["n"] for row in counted.collect()}  # a row per word of the notices at most
    out = []
    for number, notice in enumerate(notices):
        words = notice.text.split(" ")
        rare = sorted(set(words), key=lambda w: (documents.get(w, 0), w))[:many]
        out += [(number, w, place) for place, w in enumerate(words) if w in rare]
    return out


def scan(
    docs: DataFrame, text: str = "text", notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES, many: int = INDEX_WORDS, least: float = LEAST_SHARE
) -> DataFrame:
    """``docs`` without the text, with a struct ``licenses``: n_words, places (of the phrases), base_labels, labels, score, notices.

    ``notices`` of the struct lists what was found: number of the notice, word number of its begin, share of its
    index words that agree. Where ``docs`` has a column ``licenses`` already, the new one takes its place.
    """
    listed = index_of(docs, text, notices, many)
    rare = sorted({w for _, w, _ in listed})
    name = f"x{uuid.uuid4().hex}_"  # before the names of all columns made here, so none of ``docs`` is meant
    kept = [c for c in docs.columns if c.lower() not in ("licenses", text.lower())]
    parts = docs.select(*kept, word_list(F.col(text)).alias(f"{name}words"))
    words = F.col(f"{name}words")
    parts = parts.withColumn(f"{name}spaced", F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))
    spaced = F.col(f"{name}spaced")
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("word"), i.cast("long").alias("at")))))
    verified = [F.when(has_all(spaced, notice.phrases), F.lit(k)) for k, notice in enumerate(notices)]
    places = [F.struct(F.lit(label).alias("label"), starts(words, spaced, phrase).alias("at")) for phrase, label in phrases.items()]
    row = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.array(*places).alias("places"),
        hits.alias("hits"),
        F.array_compact(F.array(*verified)).alias("verified"),
        F.monotonically_increasing_id().alias("number"),
    )
    seen = cut(parts.select(*kept, row.alias(f"{name}row")))

    index = docs.sparkSession.createDataFrame(listed, "notice int, word string, place long")
    sizes = index.groupBy("notice").agg(F.count(F.lit(1)).alias("size"))
    own = seen.select(f"{name}row.number", f"{name}row.verified", F.explode(f"{name}row.hits").alias("hit")).select("number", "verified", "hit.*")
    said = own.join(F.broadcast(index), "word").where(F.array_contains("verified", F.col("notice")))
    agreed = said.groupBy("number", "notice", (F.col("at") - F.col("place")).alias("begin")).agg(F.count(F.lit(1)).alias("agreeing"))
    share = agreed.join(F.broadcast(sizes), "notice").select("number", "notice", "begin", (F.col("agreeing") / F.col("size")).alias("share"))
    # one row per notice and document: a document that repeats a notice gives its best place
    best = share.where(F.col("share") >= least).groupBy("number", "notice").agg(F.max(F.struct("share", (-F.col("begin")).alias("begin"))).alias("best"))
    entry = F.struct("notice", (-F.col("best.begin")).alias("begin"), F.col("best.share").alias("share"))
    found = best.groupBy("number").agg(F.array_sort(F.collect_list(entry)).alias("notices"))

    joined = seen.join(found.select(F.col("number").alias(f"{name}number"), F.col("notices").alias(f"{name}found")), F.col(f"{name}row.number") == F.col(f"{name}number"), "left")
    listing = F.coalesce(F.col(f"{name}found"), F.array().cast("array<struct<notice:int,begin:bigint,share:double>>"))
    base = F.transform(F.filter(f"{name}row.places", lambda x: F.size(x["at"]) > 0), lambda x: x["label"])
    label_of = F.array(*[F.lit(notice.label) for notice in notices])
    added = F.transform(listing, lambda x: F.get(label_of, x["notice"]))
    result = F.struct(
        F.col(f"{name}row.n_words").alias("n_words"),
        F.array_sort(F.flatten(F.transform(f"{name}row.places", lambda x: x["at"]))).alias("places"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, added))).alias("labels"),
        F.coalesce(F.array_max(F.transform(listing, lambda x: x["share"])), F.lit(0.0)).alias("score"),
        listing.alias("notices"),
    )
    return joined.select(*kept, result.alias("licenses"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
