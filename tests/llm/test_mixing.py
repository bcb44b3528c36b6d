import warnings
from collections import defaultdict

import numpy as np
import pytest

from amalgam.llm import mixing


def brute(tokens, aims, rounds=200):
    """tokens: {cell: tokens}; aims: a {category: weight} for each marginal."""
    w = {k: float(v) for k, v in tokens.items()}
    for _ in range(rounds):
        for m, aim in enumerate(aims):
            sums = defaultdict(float)
            for k, v in w.items():
                sums[k[m]] += v
            w = {k: v * aim[k[m]] / sums[k[m]] for k, v in w.items()}
    return w


def flattened(tokens, m, power=mixing.FLATTEN):
    sums = defaultdict(float)
    for k, v in tokens.items():
        sums[k[m]] += v
    powers = sum(v**power for v in sums.values())
    return {c: v**power / powers * sum(sums.values()) for c, v in sums.items()}


def cells_of(rows):
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source, r.lang, r.topic] += r.tokens
    return tokens


def test_documents_equal_brute_force(spark):
    data = "/root/testdata/sf0.01"
    rows = mixing.op9_source_mixing(spark, data).collect()
    docs = {d.doc_id: d for d in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.tokens == max(1, -(-len(docs[r.doc_id].text.encode()) // 4)) for r in rows)
    tokens = cells_of(rows)
    want = brute(tokens, [flattened(tokens, m) for m in range(3)])
    for r in rows:
        cell = r.source, r.lang, r.topic
        assert r.factor == pytest.approx(want[cell] / tokens[cell], rel=2e-3)
    # expected tokens of the sample, cell by cell, follow the fitted weights wherever no probability is cut to one
    assert 0.3 < np.mean([r.sampled for r in rows]) < 1
    free = [r for r in rows if r.probability < 1]
    assert len({round(r.probability / r.factor, 9) for r in free}) == 1


def test_given_targets(spark):
    rows = [(i, "x" * (40 + 8 * (i % 5)), ["a", "b", "c"][i % 3], ["en", "de"][i % 2], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = mixing.calibrated(docs, {"source": {"a": 3, "b": 1, "zz": 6}, "lang": {"en": 0.25, "de": 0.75}}, full=1.0).collect()
    total = sum(r.tokens for r in out)
    weight = lambda **k: sum(r.tokens * r.factor for r in out if all(getattr(r, c) == v for c, v in k.items()))
    own_c = sum(r.tokens for r in out if r.source == "c")
    assert weight(source="c") == pytest.approx(own_c, rel=1e-3)
    assert weight(source="a") == pytest.approx(0.75 * (total - own_c), rel=1e-3)
    assert weight(lang="de") == pytest.approx(0.75 * total, rel=1e-3)
    got = sum(r.tokens for r in out if r.sampled and r.lang == "de") / sum(r.tokens for r in out if r.sampled)
    assert got == pytest.approx(0.75, abs=0.07)


def test_sample_keeps_columns_and_agrees_with_the_decisions(spark, documents, edge_texts):
    docs = documents(edge_texts * 6, ids=[None, *range(1, 6 * len(edge_texts))])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = [r for r in mixing.calibrated(docs).collect() if r.sampled]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in want)


def test_null_categories_and_empty_table(spark, documents):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", None), (2, "", "s", None), (None, "q", None, "en")], "doc_id long, text string, source string, lang string")
    rows = mixing.calibrated(docs).collect()
    assert len(rows) == 4 and {r.source for r in rows} == {"", "s"} and all(0 < r.probability <= 1 for r in rows)
    assert mixing.calibrated(documents([])).collect() == []
    assert mixing.mixed(documents([])).collect() == []


def test_default_sample_meets_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.calibrated(docs).collect()
    tokens = cells_of(rows)
    for m, name in enumerate(mixing.MARGINALS):
        aim = flattened(tokens, m)
        wanted, got = defaultdict(float), defaultdict(float)
        for r in rows:
            wanted[getattr(r, name)] += r.tokens * r.expected
            got[getattr(r, name)] += r.tokens * r.copies
        for c, v in aim.items():
            assert wanted[c] / sum(wanted.values()) == pytest.approx(v / sum(aim.values()), rel=1e-3)
            assert got[c] / sum(got.values()) == pytest.approx(v / sum(aim.values()), abs=0.03)
    assert all(int(r.expected) <= r.copies <= int(r.expected) + 1 and r.sampled == (r.copies > 0) for r in rows)
    assert sorted(r.doc_id for r in mixing.mixed(docs, repeats=True).collect()) == sorted(r.doc_id for r in rows for _ in range(r.copies))


def cells_frame(spark, tokens):
    return spark.createDataFrame([(s, lang, "t", 1, n) for (s, lang), n in tokens.items()], "source string, lang string, topic string, n long, tokens long")


def test_raking_goes_on_until_it_converges(spark):
    cells = cells_frame(spark, {("a", "en"): 900, ("a", "de"): 60, ("b", "en"): 40, ("b", "de"): 1000})
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        rows = mixing.raked(cells, {"source": {"a": 0.2, "b": 0.8}, "lang": {"en": 0.7, "de": 0.3}}, rounds=3).collect()
    weight = lambda c, v: sum(r.weight for r in rows if r[c] == v) / 2000
    assert weight("source", "a") == pytest.approx(0.2, rel=2e-4) and weight("lang", "en") == pytest.approx(0.7, rel=2e-4)


def test_raking_reports_what_it_cannot_reach(spark):
    cells = cells_frame(spark, {("a", "en"): 500, ("b", "de"): 500})
    with pytest.warns(RuntimeWarning, match="does not converge"):
        mixing.raked(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, rounds=3)


def test_shares_of_the_sample_at_a_larger_scale(spark):
    """Every marginal's share of the drawn tokens is within two hundredths of its target."""
    decisions = mixing.calibrated(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rows = mixing.shares(decisions).collect()
    assert {r.marginal for r in rows} == set(mixing.MARGINALS)
    for r in rows:
        assert r.fitted == pytest.approx(r.wanted, rel=1e-3) and r.drawn == pytest.approx(r.wanted, abs=0.02)
    assert max(abs(r.own - r.wanted) for r in rows) > 0.05


def test_many_cells_are_narrowed_to_the_same_top(spark):
    rng = np.random.default_rng(3)
    rows = [(float(f), int(t)) for f, t in zip(rng.lognormal(size=3000).round(3), rng.integers(1, 500, 3000))]
    cells = spark.createDataFrame(rows, "factor double, tokens long").repartition(4)
    for full in (0.0, 0.1, 0.5, 0.99, 1.0):
        order, upto = sorted(rows), 0
        for factor, tokens in order:
            upto += tokens
            if upto >= full * sum(t for _, t in rows):
                break
        assert mixing.top_factor(cells, full) == mixing.top_factor(cells, full, few=50) == factor
    same = spark.createDataFrame([(1.5, 3)] * 100, "factor double, tokens long")
    assert mixing.top_factor(same, 0.5, few=10) == 1.5


def test_zero_targets_drop_a_category(spark):
    rows = [(i, "x" * 40, "ab"[i % 2], "en", 0) for i in range(100)]
    out = mixing.calibrated(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), {"source": {"a": 1.0, "b": 0.0}}).collect()
    assert all((r.copies > 0) == (r.source == "a") for r in out)


def test_rounds_in_one_plan_equal_rounds_that_are_joined(spark):
    """Both ways stop at the same round and give the same factors; some cells are empty."""
    rng = np.random.default_rng(7)
    tokens = {(f"s{i}", f"l{j}", f"t{(i + j) % 3}"): int(rng.integers(1, 5000)) for i in range(5) for j in range(5) if i != j}
    cells = spark.createDataFrame([(*c, 1, n) for c, n in tokens.items()], "source string, lang string, topic string, n long, tokens long").repartition(4)
    near, joined = ({tuple(r[:3]): r.factor for r in mixing.raked(cells, few=f).collect()} for f in (mixing.FEW, 0))
    assert near.keys() == joined.keys() == tokens.keys()
    assert all(near[c] == pytest.approx(joined[c], abs=2e-9) for c in tokens)
    want = brute(tokens, [flattened(tokens, m) for m in range(3)])
    assert all(near[c] == pytest.approx(want[c] / tokens[c], rel=5e-3) for c in tokens)


def test_rounds_of_one_plan_need_no_exchange(spark):
    cells = spark.range(20).selectExpr("'a' AS source", "'b' AS lang", "'c' AS topic", "1L AS n", "id AS tokens", "1D AS w", "1D AS aim_source", "1D AS aim_lang", "1D AS aim_topic")
    plan = mixing.one_round(cells.coalesce(1), True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
