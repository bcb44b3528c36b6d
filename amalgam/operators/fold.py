"""Fold repeated submissions of a candidate into one profile, in the order they came.

One exchange on ``candidate_id`` gathers a candidate's snapshots; they become raw records of one trusted type inside the
array and go through the ordinary merge, so the earliest snapshot's values win and lists unite in order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import normalize as N
from amalgam.operators.confidence import score
from amalgam.operators.merge import priority, profiles
from amalgam.sources.schema import RAW

FOLDED_AS = "csv"
#: The id that follows from no e-mail and no name.
NOBODY = hashlib.md5(b"", usedforsecurity=False).hexdigest()[:16]


def as_record(snapshot: Column, seq: Column) -> Column:
    """A snapshot as a raw record."""
    place = N.filled(F.concat_ws(", ", *[N.filled(snapshot["location"][k]) for k in ("city", "region", "country")]))
    names = F.filter(F.transform(snapshot["skills"], lambda s: s["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    links = {f"{k}_url": snapshot["links"][k] for k in ("linkedin", "github", "portfolio")}
    own = {"location_raw": place, "skills_raw": names, "other_urls": snapshot["links"]["other"], **links}
    fields = [(own[f] if f in own else snapshot[f]).cast(kind).alias(f) for f, kind in RAW.items()]
    return F.struct(priority(F.lit(FOLDED_AS)).alias("prio"), seq.alias("src_seq"), F.lit(FOLDED_AS).alias("source_type"), *fields)


@N.once_a_session
def records() -> Column:
    """The snapshots in ``all`` as raw records."""
    return F.transform("all", as_record)


def fold(submissions: DataFrame, as_of: str, order: str = "submitted_at", keep_first: tuple[str, ...] = ()) -> DataFrame:
    """All submissions of each ``candidate_id`` folded, the earliest one's values first; single ones stay as they are.

    Equal to folding one by one for all values and lists; the provenance holds each submission's entries in order and then
    those of one fold, and the profile is scored anew. Columns in ``keep_first`` are the earliest submission's. Profiles without
    an id, or with that of no e-mail and no name, are strangers to one another: each stays as it is.
    """
    keep = [c for c in submissions.columns if c not in ("run_id", order)]
    inner = [c for c in keep if c != "candidate_id"]
    stranger = F.col("candidate_id").isNull() | (F.col("candidate_id") == NOBODY)
    # a group of each stranger's own; both branches below read the one exchange
    apart = submissions.withColumn("_apart", F.when(stranger, F.monotonically_increasing_id()))
    once = apart.groupBy("candidate_id", "_apart").agg(F.sort_array(F.collect_list(F.struct(order, *inner))).alias("all"))
    only = F.get("all", 0)
    alone = once.filter(F.size("all") == 1).select(*[F.col(c) if c == "candidate_id" else only[c].alias(c) for c in keep])
    several = once.filter(F.size("all") > 1)
    gathered = several.select(F.col("candidate_id").alias("run_id"), "all", records().alias("recs"))
    folded = profiles(gathered, as_of, carry=("all",))
    told = F.concat(F.flatten(F.transform("all", lambda s: s["provenance"])), F.col("provenance"))
    # the fold's own id may differ from the key, as it follows from the merged e-mail and name
    value = lambda c: F.col("run_id").alias(c) if c == "candidate_id" else F.get("all", 0)[c].alias(c) if c in keep_first else F.col(c)
    return score(folded.withColumn("provenance", told)).select(*map(value, keep)).unionByName(alone)


def fold_pairs(existing: DataFrame, incoming: DataFrame, as_of: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Profiles of both tables by ``candidate_id``, the existing one's values first."""
    keep = [c for c in existing.columns if c != "run_id"]
    both = existing.select(*keep, F.lit(0).alias("_order")).unionByName(incoming.select(*keep, F.lit(1).alias("_order")))
    return fold(both, as_of, "_order", keep_first)
