"""Identity resolution: which records of different sources are the same person, without a shared key.

Blocking: every record gets several keys (its e-mail, its phone's last digits, beginnings and ends of its names at its place), and only
records that share one are compared. A key that more than ``BLOCK`` records share is refined by the whole name; what is still
too large says nothing about identity and is purged, and :func:`purged` reports it. So no task holds a large block and
a block's pairs are bounded.

Comparison: each pair gets a level of agreement for each field, from Jaro-Winkler similarity and edit distances; a missing value
says nothing. Pairs are counted by their levels, a table of a few hundred rows at most however many pairs there are, and the
weights of every level are fitted to it by expectation maximisation (the model of Fellegi and Sunter: agreement among matches
against agreement among the rest, fields independent in each). Pairs above ``THRESHOLD`` are links, components of links people.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.operators.components import components
from amalgam.operators.scratch import materialised

BLOCK, THRESHOLD, ROUNDS = 50, 0.95, 25
#: Levels of each field, the highest for full agreement; and where the fit begins: shares among matches and among the rest.
FIELDS: dict[str, tuple[list[float], list[float]]] = {
    "name": ([0.05, 0.05, 0.2, 0.7], [0.7, 0.2, 0.05, 0.05]), "email": ([0.1, 0.1, 0.8], [0.9, 0.05, 0.05]),
    "phone": ([0.1, 0.1, 0.8], [0.9, 0.05, 0.05]), "place": ([0.1, 0.9], [0.5, 0.5]),
}
PRIOR, FLOOR = 0.2, 1e-6
CLOSE, NEAR = 0.92, 0.8


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity (common letters within half the longer length, less half their transpositions), raised by up to four equal first letters."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, unused in zip(b, free, strict=True) if not unused]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def similarities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple[str, str], float] = {}
    for a, b in batches:
        out = []
        for pair in zip(a, b, strict=True):
            if None in pair:
                out.append(None)
                continue
            if pair not in known:
                if len(known) > 200_000:
                    known.clear()
                known[pair] = jaro_winkler(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="float64")


def similarity(a: str, b: str) -> Column:
    return F.pandas_udf(similarities, "double")(a, b)


def prepared(records: DataFrame) -> DataFrame:
    """(id, name, email, phone, place): names in lower case with single spaces, phones as digits, blanks as null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    digits = F.nullif(F.regexp_replace("phone", "[^0-9]", ""), F.lit(""))
    return records.select(
        F.col("id").cast("long").alias("id"), blank(F.regexp_replace(F.lower("name"), r"\s+", " ")).alias("name"), blank(F.lower("email")).alias("email"),
        F.when(F.length(digits) >= 7, digits).alias("phone"), blank(F.lower("place")).alias("place"),
    )


def block_keys() -> list[Column]:
    """The keys of a prepared record; one is null where its fields are."""
    first, last = F.substring("name", 1, 1), F.substring_index("name", " ", -1)
    at = F.coalesce("place", F.lit(""))
    return [
        F.concat(F.lit("e:"), "email"), F.concat(F.lit("p:"), F.right("phone", F.lit(7))),
        F.concat(F.lit("b:"), first, F.lit(":"), F.substring(last, 1, 4), F.lit(":"), at), F.concat(F.lit("x:"), first, F.lit(":"), F.right(last, F.lit(4)), F.lit(":"), at),
    ]


def blocked(people: DataFrame, most: int = BLOCK) -> DataFrame:
    """(key, n, and the record as a struct) of every record and key; a key above ``most`` records has been refined by the whole name."""
    keyed = people.select(F.struct(*people.columns).alias("person"), F.explode(F.array(*block_keys())).alias("key")).filter("key is not null")
    sizes = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n"))
    # counts come from partial sums, and the join with them is one that adaptive execution can split, so a frequent key is no large task
    first = keyed.join(sizes(keyed), "key")
    finer = F.when(F.col("n") > most, F.concat("key", F.lit(":"), F.coalesce("person.name", F.lit("")))).otherwise(F.col("key"))
    keyed = first.select("person", finer.alias("key"))
    return keyed.join(sizes(keyed), "key")


def purged(blocks: DataFrame, most: int = BLOCK) -> DataFrame:
    """(key, n) of the blocks that are too large to be compared."""
    return blocks.filter(F.col("n") > most).groupBy("key").agg(F.first("n").alias("n"))


def candidate_pairs(blocks: DataFrame, most: int = BLOCK) -> DataFrame:
    """Pairs of records (structs a and b, a's id the smaller one) that share a block of at most ``most``; each pair once."""
    small = blocks.filter((F.col("n") > 1) & (F.col("n") <= most)).select("key", "person")
    a, b = small.withColumnRenamed("person", "a"), small.withColumnRenamed("person", "b")
    return a.join(b, "key").filter("a.id < b.id").select("a", "b", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).dropDuplicates(["a_id", "b_id"])


def compared(pairs: DataFrame) -> DataFrame:
    """(a, b) ids and the level of agreement of each field, null where a value is missing."""
    both = lambda f: F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull()
    same = lambda f: F.col(f"a.{f}") == F.col(f"b.{f}")
    apart = lambda f: F.levenshtein(F.col(f"a.{f}"), F.col(f"b.{f}"))
    rows = pairs.withColumn("alike", similarity("a.name", "b.name"))
    name = F.when(both("name"), F.when(same("name"), 3).when(F.col("alike") >= CLOSE, 2).when(F.col("alike") >= NEAR, 1).otherwise(0))
    email = F.when(both("email"), F.when(same("email"), 2).when(apart("email") <= 2, 1).otherwise(0))
    phone = F.when(both("phone"), F.when(same("phone"), 2).when((F.right("a.phone", F.lit(7)) == F.right("b.phone", F.lit(7))) | (apart("phone") <= 1), 1).otherwise(0))
    place = F.when(both("place"), F.when(same("place"), 1).otherwise(0))
    return rows.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), name.alias("name"), email.alias("email"), phone.alias("phone"), place.alias("place"))


class Weights:
    """Shares of every field's levels among matches (m) and among other pairs (u), and the share of matches."""

    def __init__(self):
        self.share = PRIOR
        self.m = {f: list(m) for f, (m, _) in FIELDS.items()}
        self.u = {f: list(u) for f, (_, u) in FIELDS.items()}

    def probability(self, levels: dict[str, int | None]) -> float:
        m, u = self.share, 1 - self.share
        for f in FIELDS:
            if levels[f] is not None:
                m, u = m * self.m[f][levels[f]], u * self.u[f][levels[f]]
        return m / (m + u)

    def weight(self, field: str, level: int) -> float:
        """Binary logarithm of how much likelier a level is among matches."""
        return math.log2(self.m[field][level] / self.u[field][level])

    @classmethod
    def fitted(cls, patterns: list[tuple[dict[str, int | None], int]], rounds: int = ROUNDS) -> Weights:
        """Expectation maximisation over the patterns of levels and how many pairs have each."""
        now, total = cls(), sum(n for _, n in patterns)
        for _ in range(rounds if total else 0):
            held = [(levels, n * p, n * (1 - p)) for levels, n in patterns for p in [now.probability(levels)]]
            new = cls()
            new.share = min(max(sum(x for _, x, _ in held) / total, FLOOR), 1 - FLOOR)
            for f, (starts, _) in FIELDS.items():
                for table, which in ((new.m, 1), (new.u, 2)):
                    sums = [sum(h[which] for h in held if h[0][f] == level) for level in range(len(starts))]
                    known = sum(sums)
                    table[f] = [(s + FLOOR) / (known + FLOOR * len(starts)) for s in sums]
            now = new
        return now


def fit(pairs: DataFrame) -> Weights:
    """The weights of compared pairs; the driver gets one row for each pattern of levels, at most a few hundred."""
    found = pairs.groupBy(*FIELDS).agg(F.count("*").alias("n")).collect()
    return Weights.fitted(sorted((({f: r[f] for f in FIELDS}, r["n"]) for r in found), key=lambda x: [(-1 if v is None else v) for v in x[0].values()]))


def scored(pairs: DataFrame, weights: Weights) -> DataFrame:
    """Compared pairs with the probability that they are one person."""
    m, u = F.lit(weights.share), F.lit(1 - weights.share)
    for f in FIELDS:
        share = lambda table, f=f: F.coalesce(F.get(F.array(*map(F.lit, table[f])), F.col(f)), F.lit(1.0))
        m, u = m * share(weights.m), u * share(weights.u)
    return pairs.withColumn("probability", m / (m + u))


def resolve(records: DataFrame, threshold: float = THRESHOLD, most: int = BLOCK) -> DataFrame:
    """(id, person, n_links, probability): the smallest id of the same person, and the number and best probability of direct links.

    ``records``: id, name, email, phone, place. A record without values, or in purged blocks only, is a person of its own.
    """
    people = prepared(records)
    pairs, _ = materialised(compared(candidate_pairs(blocked(people, most), most)), "pairs")
    links = scored(pairs, fit(pairs)).filter(F.col("probability") >= threshold).select("a", "b", "probability")
    ends = links.select(F.col("a").alias("id"), "probability").union(links.select("b", "probability"))
    direct = ends.groupBy("id").agg(F.count("*").alias("n_links"), F.max("probability").alias("probability"))
    out = people.select("id").join(direct, "id", "left").join(components(links), "id", "left")
    return out.select("id", F.coalesce("component", "id").alias("person"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "probability")
