"""Phrases of a large dictionary that stand in texts, word for word.

The dictionary is an index of two levels, as a trie cut short: a first word leads to the lengths of the phrases that begin with
it, and a run of that many words is looked up whole. A place in a text thus asks as often as its word has lengths, however
many phrases begin with it; one alternation of all phrases would be tried at every letter.

Words are runs of letters and digits in lower case, so case and punctuation do not matter. Every place counts, also those that
overlap. Texts are cut into blocks of words that overlap by the longest phrase, so a very long text is many small rows. Both
levels are broadcast up to ``BROADCAST`` bytes, which are counted; beyond that they are joined by shuffles.

Null and empty texts and phrases without words hold nothing; phrases that differ in case or punctuation are one, repeated ones
too. Rows that share a key, null included, are counted together. An empty table on either side gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text that one row holds, and the bytes of an index that every executor may hold.
BLOCK, BROADCAST = 4096, 32 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def dictionary(phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, head, n): distinct phrases by their words, the first of them and how many there are; one without words is empty and meets no word.

    Repeated rows are dropped before they are read. A filter, also one that a join infers for a null head, would go below that.
    """
    words = phrases.select(F.col(phrase).alias("given")).distinct().select(words_of(F.col("given")).alias("words"))
    return words.select(F.array_join("words", " ").alias("phrase"), F.coalesce(F.get("words", 0), F.lit("")).alias("head"), F.size("words").alias("n")).distinct()


def places(texts: DataFrame, key: str, text: str, longest: int, block: int = BLOCK) -> DataFrame:
    """(key, base, words, i): each word's place in its block, from 1; ``base`` words stand before the block, and it goes on for ``longest - 1`` words more.

    Words are split once: the outer generators infer no filter that would split them again. Nothing is copied for a place
    before it is shuffled, since generators and broadcast joins are one piece of generated code.
    """
    split = texts.select(F.col(key).alias("key"), words_of(F.col(text)).alias("words"))
    cut = split.select("key", "words", F.explode_outer(F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / block).cast("int"))).alias("k"))
    blocks = cut.select("key", (F.col("k") * block).cast("long").alias("base"), F.slice("words", F.col("k") * block + 1, block + longest - 1).alias("words"))
    return blocks.select("key", "base", "words", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(1), F.least(F.size("words"), F.lit(block))))).alias("i"))


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str, block: int = BLOCK, broadcast: int = BROADCAST) -> DataFrame:
    """(key, phrase, n, first): how often each phrase stands in a key's texts, and the first place, in words from 0."""
    known = dictionary(phrases, phrase)
    longest, size = known.agg(F.max("n"), F.sum(F.octet_length("phrase") + 64)).first()
    near, asking = F.broadcast, places(texts, key, text, longest or 1, block)
    if (size or 0) > broadcast:  # a shuffled row holds the words from its place on, no block
        near, asking = lambda df: df, asking.select("key", (F.col("base") + F.col("i") - 1).alias("base"), F.slice("words", F.col("i"), longest).alias("words"), F.lit(1).alias("i"))
    heads = known.groupBy("head").agg(F.collect_set("n").alias("lengths"))  # as many as the longest phrase has words
    met = asking.withColumn("head", F.get("words", F.col("i") - 1)).join(near(heads), "head")
    asked = met.select("key", "base", "words", "i", F.explode("lengths").alias("n")).filter(F.size("words") - F.col("i") + 1 >= F.col("n"))
    said = asked.select("key", (F.col("base") + F.col("i") - 1).alias("at"), F.coalesce(F.array_join(F.slice("words", F.col("i"), F.col("n")), " "), F.lit("")).alias("phrase"))
    found = said.join(near(known.select("phrase")), "phrase", "left_semi")
    return found.groupBy("key", "phrase").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumnRenamed("key", key)
