"""Licence scans by a positional rare-token index, in DataFrame functions only.

One pass over a text finds its words; those of the licence vocabulary are kept as postings (position, word), an array that
stays in its document's row, and all words are counted. Document frequencies of the vocabulary over all documents give
its IDF. A file's licence words are then looked up by falling IDF: a template is entered by the rarest of the words that
every match must hold, where the file holds it, and dropped where one of the others is absent. Position minus offset is
where the template would start, so intersecting the words' starts from the rarest word on finds all places at which its
mandatory words stand in place. Such a start counts where

* for a phrase (base): all of its words stand consecutively;
* for a notice: at least 70 % of its words stand at their places, and a mandatory key phrase stands among them in full.

No match is lost by the seed, since every match holds it. All of it happens in the document's own row in time linear in
its postings: nothing but the word frequencies is shuffled, and no row is multiplied.

The score is the share of words in place of the best notice or phrase that counts (0 where none does).

Null and empty texts have no words and no labels. Lower-casing concerns A-Z only. Every row gets its own text's result, so
repeated rows and null doc_ids need no care, and further columns are not read. Words of equal frequency (seed ties) go by
their place in the sorted vocabulary, which changes no result. Very long texts are scanned whole. An empty table gives no
row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import saved, table

#: What stands between words before A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The base phrases with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices that the method adds: words, label, mandatory key phrase.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", "apache license"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache", "applicable law or agreed to in writing"),
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu general public license"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "free software"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl", "gnu general public license"),
    ("released under the mit license", "mit", "mit license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "permission is hereby granted"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "permission notice shall be included"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("this work is licensed under a creative commons attribution", "cc-by", "creative commons attribution"),
    ("creative commons attribution sharealike", "cc-by-sa", "creative commons attribution sharealike"),
    ("cc0 1 0 universal public domain dedication", "cc0", "cc0 1 0 universal"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary forms"),
    ("may be used to endorse or promote products derived from this software without specific prior written permission", "bsd", "endorse or promote products"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "with or without fee"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla public license"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl", "eclipse public license"),
    ("boost software license version 1 0", "bsl", "boost software license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
    ("gnu affero general public license", "agpl", "gnu affero general public license"),
    ("gnu lesser general public license", "lgpl", "gnu lesser general public license"),
)
LEAST = 0.7
#: Words too common to look up; they take no part in a notice unless its key phrase holds them.
COMMON = frozenset("the a of to in it or you can any with are this".split())
#: A posting is position * CODES + word; the vocabulary is smaller than that.
CODES = 256


def templates() -> list[dict]:
    """Each template's looked-up words with their offsets, its label, and the bits that must all be set."""
    out = []
    for text, label in PHRASES:
        words = text.split()
        out.append({"label": label, "base": True, "words": list(enumerate(words)), "must": list(range(len(words))), "least": len(words)})
    for text, label, key in NOTICES:
        words, inner = text.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(inner)] == inner)
        kept = [(i, w) for i, w in enumerate(words) if w not in COMMON or first <= i < first + len(inner)]
        must = [k for k, (i, _) in enumerate(kept) if first <= i < first + len(inner)]
        out.append({"label": label, "base": False, "words": kept, "must": must, "least": -int(-LEAST * len(kept) // 1)})
    return out


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for _, w in t["words"]})


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words and ``at``, the ascending postings of licence words."""
    known = vocabulary()
    listed = F.array(*[F.lit(w) for w in known])
    pieces = F.split(F.coalesce("text", F.lit("")), GAPS)

    def posting(word: Column, i: Column) -> Column:
        low = F.lower(word)
        # a word outside ASCII may become one of the vocabulary by lower(); it is longer in bytes
        return F.when(low.isin(known) & (F.octet_length(word) == F.octet_length(low)), i * CODES + F.array_position(listed, low) - 1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces.alias("pieces"))
    # only before the first and after the last gap there may be an empty piece
    lead, trail = F.get("pieces", 0) == "", F.element_at("pieces", -1) == ""
    rows = rows.select("doc_id", lead.cast("long").alias("lead"), F.greatest(F.size("pieces") - lead.cast("int") - trail.cast("int"), F.lit(0)).cast("long").alias("n_words"), F.array_compact(F.transform("pieces", posting)).alias("at"))
    return rows.select("doc_id", "n_words", F.transform("at", lambda x: x - F.col("lead") * CODES).alias("at"))


def frequencies(found: DataFrame) -> dict[int, int]:
    """Number of documents that hold each word of the vocabulary; at most as many rows as that has."""
    each = found.select(F.explode(F.array_distinct(F.transform("at", lambda x: x % CODES))).alias("word"))
    return {r.word: r.n for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}


def starts(template: dict, frequency: dict[int, int], at: Column, held: Column) -> Column:
    """(base, label, starts, share) of a template in a document: where it counts, and the best share of its words in place."""
    code = {w: i for i, w in enumerate(vocabulary())}
    words = [(offset, code[w]) for offset, w in template["words"]]
    rank = lambda k: (frequency.get(words[k][1], 0), words[k][1], words[k][0])
    must = sorted(template["must"], key=rank)
    others = [k for k in range(len(words)) if k not in must]
    place = lambda k: F.transform(F.filter(at, lambda x: x % CODES == words[k][1]), lambda x: F.floor(x / CODES) - words[k][0])
    meeting = place(must[0])
    for k in must[1:]:
        meeting = F.array_intersect(meeting, place(k))
    size, sure, least = len(words), len(must), template["least"]
    none = F.array().cast("array<bigint>")

    def counted(begin: Column) -> Column:
        if not others:
            return F.struct(begin.alias("starts"), F.lit(1.0).alias("share"))
        more = F.array_sort(F.concat(*[F.array_intersect(begin, place(k)) for k in others]))

        def enough(sorted_: Column) -> Column:
            # a start that is there n times is told by equal neighbours n - 1 apart
            times = lambda n: begin if n <= 0 else F.array_distinct(F.filter(sorted_, lambda x, i: F.get(sorted_, i + n - 1) == x))
            best = F.coalesce(*[F.when(F.size(times(n)) > 0, n) for n in range(len(others), max(least - sure, 0), -1)], F.lit(max(least - sure, 0)))
            return F.struct(times(least - sure).alias("starts"), ((best + sure) / F.lit(float(size))).alias("share"))

        return let(more, enough)

    empty = F.struct(none.alias("starts"), F.lit(0.0).alias("share"))
    has = F.lit(True)
    for word in dict.fromkeys(words[k][1] for k in must):
        has = has & F.array_contains(held, F.lit(word).cast("bigint"))
    found = F.when(has, let(meeting, lambda begin: F.when(F.size(begin) > 0, counted(begin)).otherwise(empty))).otherwise(empty)
    return let(found, lambda x: F.struct(F.lit(template["base"]).alias("base"), F.lit(template["label"]).alias("label"), x["starts"].alias("starts"), x["share"].alias("share")))


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    found = saved(scan(docs), "licence-words")
    frequency = frequencies(found)
    rows = found.withColumn("held", F.array_distinct(F.transform("at", lambda x: x % CODES)))
    each = F.filter(F.array(*[starts(t, frequency, F.col("at"), F.col("held")) for t in templates()]), lambda t: F.size(t["starts"]) > 0)
    hit = rows.select("doc_id", "n_words", F.when(F.size("at") > 0, each).otherwise(F.slice(each, 1, 0)).alias("hit"))
    base = F.filter("hit", lambda t: t["base"])
    hit = hit.withColumn("base", base).withColumn("places", F.flatten(F.transform("base", lambda t: t["starts"])))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda t: t["label"]))), ",")
    return hit.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
        label("base").alias("base_labels"), label("hit").alias("labels"), F.coalesce(F.array_max(F.transform("hit", lambda t: t["share"])), F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
