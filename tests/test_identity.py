import random
import string

import duckdb
import pytest

from amalgam.operators import identity
from amalgam.operators.components import components
from amalgam.plans import inputs, linkage

RECORD = "id long, name string, email string, phone string, place string"


def test_jaro_winkler():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcde ", k=rnd.randrange(1, 14))) for _ in range(400)] + ["martha", "marhta", "dixon", "dicksonx", "x" * 30, "x"]
    pairs = [(rnd.choice(words), rnd.choice(words)) for _ in range(3000)] + [("martha", "marhta"), ("dixon", "dicksonx")]
    c = duckdb.connect()
    for a, b in pairs:
        assert identity.jaro_winkler(a, b) == pytest.approx(c.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-12), (a, b)


def test_planted_twins_are_found(spark):
    """Every fourth customer's twin, in six kinds of disguise: recall and precision of pairs at least 0.95."""
    sf = "/root/testdata/sf0.01"
    rows = linkage.linked_people(spark, sf).collect()
    person = {r.id: r.person for r in rows}
    true = {(i - 1, i) for i in person if i % 4 == 1}
    groups = {}
    for i, p in person.items():
        groups.setdefault(p, []).append(i)
    found = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(true) > 300
    assert len(true & found) / len(true) >= 0.95 and len(true & found) / len(found) >= 0.95
    people = identity.prepared(inputs.view(spark, sf, linkage.PEOPLE))
    pairs = identity.candidate_pairs(identity.blocked(people))
    assert pairs.count() < 40 * len(person)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_large_blocks_are_refined_then_purged(spark):
    """A third of all rows share an address and a name; no block that is compared is above the stated size, and twins elsewhere are found."""
    rnd = random.Random(4)
    rows = [(i, "same name", "info@shared.example", None, "Town") for i in range(400)]
    for i in range(400, 1000, 2):
        name, box = ("".join(rnd.choices(string.ascii_lowercase, k=6)) + " " + "".join(rnd.choices(string.ascii_lowercase, k=9)) for _ in range(2))
        phone = f"+1 212 {rnd.randrange(2_000_000, 9_000_000)}"
        rows += [(i, name, "info@shared.example" if i % 8 == 0 else f"{box}@a.example", phone, "Town"), (i + 1, name.upper(), None, phone, "Town")]
    records = spark.createDataFrame(rows, RECORD)
    blocks = identity.blocked(identity.prepared(records), 50)
    gone = identity.purged(blocks, 50).collect()
    assert gone and all(r.n > 50 for r in gone)
    kept = identity.candidate_pairs(blocks, 50)
    assert kept.count() < 50 * len(rows)
    person = {r.id: r.person for r in identity.resolve(records).collect()}
    assert sum(person[i + 1] == i for i in range(400, 1000, 2)) >= 0.95 * 300
    assert all(person[i] == i for i in range(400))  # what only purged blocks hold is left alone


def test_missing_values_ties_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "", " ", "12", ""), (3, "Ann  Lee", "a@x.example", "2125550001", "Rome"), (4, "ann lee", "A@X.example ", "(212) 555-0001", None), (4, "ann lee", "a@x.example", "2125550001", "rome")]
    out = identity.resolve(spark.createDataFrame([(*r, 9) for r in rows], RECORD + ", person int")).collect()
    assert len(out) == 5
    got = {r.id: r.person for r in out}
    assert got[1] == 1 and got[2] == 2
    assert identity.resolve(spark.createDataFrame([], RECORD)).collect() == []


def test_weights_tell_matches_from_the_rest():
    """Patterns drawn from known shares: the fit comes near them."""
    rnd = random.Random(8)
    m = {"name": [0.02, 0.03, 0.15, 0.8], "email": [0.1, 0.1, 0.8], "phone": [0.15, 0.05, 0.8], "place": [0.1, 0.9]}
    u = {"name": [0.85, 0.1, 0.03, 0.02], "email": [0.95, 0.03, 0.02], "phone": [0.96, 0.02, 0.02], "place": [0.7, 0.3]}
    counts = {}
    for _ in range(60_000):
        table = m if rnd.random() < 0.3 else u
        levels = tuple(None if rnd.random() < 0.1 else rnd.choices(range(len(table[f])), table[f])[0] for f in identity.FIELDS)
        counts[levels] = counts.get(levels, 0) + 1
    w = identity.Weights.fitted([(dict(zip(identity.FIELDS, k)), n) for k, n in counts.items()], 60)
    assert w.share == pytest.approx(0.3, abs=0.02)
    for f in identity.FIELDS:
        assert w.m[f] == pytest.approx(m[f], abs=0.04) and w.u[f] == pytest.approx(u[f], abs=0.04)
        assert w.weight(f, len(m[f]) - 1) > 0 > w.weight(f, 0)


def test_components_by_brute_force(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5)]
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
