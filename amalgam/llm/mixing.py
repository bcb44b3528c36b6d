"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are counted into cells of (source, language, topic), each weighing its documents' token estimate (a quarter of
the UTF-8 bytes, one at least). The cells' weights are raked to the three marginals in turn until each marginal is within
``tolerance`` of its target, or the worst deviation has not halved in ``rounds`` rounds (sparse cells or conflicting targets);
then a RuntimeWarning tells what is left, and :func:`shares` gives it category by category. Above ``FEW`` cells, sums are
aggregations by category that are joined back, so no task holds all cells of a category, however many sources there are.

A cell's factor is its fitted over its own weight; a document is expected factor / top times in the sample, where top is
the ``full``-quantile of factors by tokens: as many whole copies as fit, and one more with the probability that is left,
decided by an MD5 digest of doc_id and seed, so the choice is the same on every run, every cluster and in any SQL.
No cell is clipped, so the expected tokens of the sample have the raked weights' shares. ``probability`` is that of one copy
at least. ``full`` = 1 makes the greatest factor the top: no repeats, but a far smaller sample.

Targets default to each marginal's own shares raised to the power ``flatten`` and normalised, which lifts what is rare.
Targets for categories that no document has are left out and the rest normalised; categories without a target keep their
own share of the weight; a target of zero drops a category.

Null source, language or topic is a category of its own (""). Null and empty texts weigh one token and have topic
"other"; very long texts are read whole and weigh what they are long. Rows with equal doc_id are drawn alike, each with its
own cell's probability; null doc_ids too. Further columns, whatever their names, are kept by :func:`mixed` and not read.
An empty table gives no row.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import block_of, dropped, saved, table

MARGINALS = ("source", "lang", "topic")
FLATTEN, FULL, TOLERANCE, ROUNDS, SEED = 0.7, 0.5, 1e-4, 40, 11
#: Decimals of a factor, so that no decision depends on the order in which weights were added.
DECIMALS = 9
#: Cells that one task may sort.
FEW = 100_000
#: Rounds of raking that one plan holds while one task holds all cells.
ROUNDS_A_PLAN = 8
#: The default topics: the first pattern that a text holds names its topic.
TOPICS = (
    ("legal", r"(?i)\blicen[cs]e|\bcopyright\b|\bterms of\b"),
    ("contact", r"[\w.+-]@[\w-]+\.\w|\bhttps?://|\bwww\."),
    ("table", r" \| "),
    ("figures", r"\d{3}"),
)


def default_topic(text: Column) -> Column:
    topic = F.when(text.isNull() | (text == ""), "other")
    for name, pattern in TOPICS:
        topic = topic.when(text.rlike(pattern), name)
    return topic.otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("long")


def weighed(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens)."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce(default_topic(text) if topic is None else topic, F.lit("")).alias("topic"), tokens_of(text).alias("tokens"),
    )


def aims(cells: DataFrame, m: str, targets: dict[str, dict[str, float]] | None, flatten: float) -> DataFrame:
    """(category, aim): the weight that each category of a marginal shall have. Only sums over all categories leave the executors."""
    each = cells.groupBy(m).agg(F.sum("w").alias("own"))
    if targets and m in targets:
        wanted = {k: float(v) for k, v in targets[m].items()}
        named = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]) if wanted else F.lit(None).cast("map<string,double>")
        each = each.withColumn("goal", F.try_element_at(named, F.col(m)))
        known, left = each.agg(F.sum("goal"), F.sum(F.when(F.col("goal").isNotNull(), F.col("own")))).first()
        return each.select(m, F.when(F.col("goal").isNull(), F.col("own")).otherwise(F.col("goal") * F.lit((left or 0.0) / (known or 1.0))).alias("aim"))
    power = F.pow(F.col("own"), F.lit(flatten))
    total, powers = each.agg(F.sum("own"), F.sum(power)).first()
    return each.select(m, (power / F.lit(powers or 1.0) * F.lit(total or 0.0)).alias("aim"))


def one_round(cells: DataFrame, few: bool) -> DataFrame:
    """Weights ``w`` scaled to the three marginals in turn, and ``off``, how far the worst one was from its aim before.

    ``few``: the cells are one partition, where a window by category needs no exchange; else sums are joined back.
    """
    for m in MARGINALS:
        aim = F.col(f"aim_{m}")
        if few:
            cells = cells.withColumn("sum", F.sum("w").over(Window.partitionBy(m)))
        else:
            cells = cells.join(cells.groupBy(m).agg(F.sum("w").alias("sum")), m)
        scale = F.when(aim == F.col("sum"), 1.0).when(F.col("sum") > 0, aim / F.col("sum")).otherwise(0.0)
        miss = F.when(aim > 0, F.abs(F.col("sum") / aim - 1)).otherwise(0.0)
        cells = cells.withColumns({"w": F.col("w") * scale, "off": miss if m == MARGINALS[0] else F.greatest("off", miss)}).drop("sum")
    return cells


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, tolerance: float = TOLERANCE, rounds: int = ROUNDS, few: int = FEW) -> DataFrame:
    """Cells (source, lang, topic, n, tokens) with their fitted ``weight`` and ``factor``.

    Up to ``few`` cells are one partition and several rounds one plan, so that the driver holds few plans; the round at which
    they converge is chosen afterwards. More cells stay spread out, and each round is written.
    """
    plain = cells.select(*MARGINALS, "n", "tokens", F.col("tokens").cast("double").alias("w"))
    n_cells = plain.count()
    small, start = n_cells <= few, plain
    for m in MARGINALS:
        start = start.join(aims(plain, m, targets, flatten).withColumnRenamed("aim", f"aim_{m}"), m)
    kept = saved(start, "cells", n_cells)
    now, a_plan = kept, ROUNDS_A_PLAN if small else 1
    mark, waited, done, chosen = math.inf, 0, 0, None
    while chosen is None:
        step = now.coalesce(1) if small else now
        for k in range(a_plan):
            step = one_round(step, small)
            step = step.withColumns({f"w{k}": F.col("w"), f"off{k}": F.col("off")})
        before, kept = kept, saved(step.drop("off"), "cells", None if small else n_cells)
        dropped(before)
        for k, worst in enumerate(kept.agg(*[F.max(f"off{k}") for k in range(a_plan)]).first()):
            done += 1
            if worst is None or worst <= tolerance:
                chosen = k
                break
            mark, waited = (worst, 0) if worst <= mark / 2 else (mark, waited + 1)
            if waited >= rounds:
                warnings.warn(f"raking does not converge: after {done} rounds a marginal is off its target by a factor of up to {1 + worst:.6g}", RuntimeWarning, stacklevel=2)
                chosen = k
                break
        now = kept.select(*plain.columns, *[f"aim_{m}" for m in MARGINALS])
    weight = F.col(f"w{chosen}")
    return kept.select(*MARGINALS, "n", "tokens", weight.alias("weight"), F.round(weight / F.col("tokens"), DECIMALS).alias("factor"))


def top_factor(fitted: DataFrame, full: float, few: int = FEW) -> float | None:
    """The smallest factor up to which cells hold the share ``full`` of all tokens.

    While there are more than ``few`` cells, the range that holds it is narrowed by counting tokens in 64 ranges at a time.
    """
    need, before = full * (fitted.agg(F.sum("tokens")).first()[0] or 0), 0
    while True:
        n, low, high = fitted.agg(F.count("*"), F.min("factor"), F.max("factor")).first()
        if n <= few or low == high:
            break
        cuts = sorted(set(fitted.agg(F.percentile_approx("factor", [i / 64 for i in range(1, 64)])).first()[0]) - {low})
        cuts = cuts or [high]
        piece = block_of(F.col("factor"), cuts)
        for k, tokens in sorted(map(tuple, fitted.groupBy(piece.alias("piece")).agg(F.sum("tokens")).collect())):
            chosen = k
            if before + tokens >= need:
                break
            before += tokens
        fitted = fitted.filter(piece == chosen)
    if low == high:
        return high
    sums = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy("factor"))  # of ``few`` cells
    told = fitted.select("factor", (sums + before).alias("upto")).agg(F.min(F.when(F.col("upto") >= need, F.col("factor"))), F.max("factor")).first()
    return told[0] if told[0] is not None else told[1]


def probabilities(parts: DataFrame, targets: dict[str, dict[str, float]] | None = None, full: float = FULL) -> DataFrame:
    """(source, lang, topic, factor, probability, expected) of every cell of :func:`weighed` rows. Cells above the quantile's factor are repeated."""
    cells = saved(parts.groupBy(*MARGINALS).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")), "cells")
    fitted = raked(cells, targets)
    dropped(cells)
    top = top_factor(fitted.filter("factor > 0"), full)
    expected = F.col("factor") / F.lit(top) if top else F.lit(0.0)
    return fitted.select(*MARGINALS, "factor", F.least(F.lit(1.0), expected).alias("probability"), expected.alias("expected"))


def drawn(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from the id: the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def copies(doc_id: Column, expected: Column, seed: int) -> Column:
    """How often a document is in the sample: the expected number's whole part, and one more by a draw for the rest."""
    return (F.floor(expected) + F.when(drawn(doc_id, seed) < expected - F.floor(expected), 1).otherwise(0)).cast("long")


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, full: float = FULL, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, factor, probability, expected, sampled and copies. Texts are read once."""
    parts = saved(weighed(docs, topic), "weighed", docs.count())
    joined = parts.join(probabilities(parts, targets, full), list(MARGINALS))
    many = copies(F.col("doc_id"), F.col("expected"), seed)
    return joined.select("doc_id", *MARGINALS, "tokens", "factor", "probability", "expected", (many > 0).alias("sampled"), many.alias("copies"))


def shares(decisions: DataFrame, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(marginal, category, own, wanted, fitted, drawn): shares of tokens in the documents, the targets, the raked weights and the sample of :func:`calibrated`."""
    cells = decisions.groupBy(*MARGINALS).agg(F.sum(F.col("tokens").cast("double")).alias("w"), F.sum(F.col("tokens") * F.col("expected")).alias("fitted"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn"))
    out = None
    for m in MARGINALS:
        each = cells.groupBy(m).agg(*[F.sum(c).cast("double").alias(c) for c in ("w", "fitted", "drawn")]).join(aims(cells, m, targets, flatten), m)
        w, fitted, got, aim = (x or 1.0 for x in each.agg(F.sum("w"), F.sum("fitted"), F.sum("drawn"), F.sum("aim")).first())
        rows = each.select(F.lit(m).alias("marginal"), F.col(m).alias("category"), (F.col("w") / w).alias("own"), (F.col("aim") / aim).alias("wanted"), (F.col("fitted") / fitted).alias("fitted"), (F.col("drawn") / got).alias("drawn"))
        out = rows if out is None else out.union(rows)
    return out


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, full: float = FULL, seed: int = SEED, repeats: bool = False) -> DataFrame:
    """The sampled documents with all their columns, each once or, with ``repeats``, as often as it has copies.

    Only with ``repeats`` do the rows meet the targets where a cell's factor is above the top. The texts are not shuffled
    where the cells fit a broadcast.
    """
    cells = probabilities(weighed(docs), targets, full).select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINALS], F.col("expected").alias("_mix_expected"))
    own = {"source": F.coalesce(docs["source"], F.lit("")), "lang": F.coalesce(docs["lang"], F.lit("")), "topic": default_topic(docs["text"])}
    met = docs.join(cells, [own[m] == cells[f"_mix_{m}"] for m in MARGINALS])
    many = copies(docs["doc_id"].cast("long"), cells["_mix_expected"], seed)
    if not repeats:
        return met.filter(many > 0).select(*[docs[c] for c in docs.columns])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return met.filter(many > 0).select(row, F.explode(F.sequence(F.lit(1), many.cast("int"))).alias("copy")).select("row.*")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrated(table(spark, sf_dir, "documents"))
