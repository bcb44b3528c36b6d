"""Phrases in texts against plain comparison, place by place."""

import re

import pytest

from amalgam.operators import phrases


def brute(texts, known):
    words_of = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = {tuple(w) for p in known if (w := words_of(p))}
    out = {}
    for key, text in texts:
        words = words_of(text)
        for p in known:
            for at in range(len(words) - len(p) + 1):
                if tuple(words[at : at + len(p)]) == p:
                    n, first = out.get((key, " ".join(p)), (0, at))
                    out[key, " ".join(p)] = n + 1, min(first, at)
    return out


def found(df):
    return {(r[0], r.phrase): (r.n, r["first"]) for r in df.collect()}


TEXTS = [
    (1, "Data engineer; data Engineer, data-engineer and senior data engineer"), (2, None), (3, ""), (4, "... !"), (5, "data"), (None, "Senior data"),
    (1, "again a data engineer"), (6, "a a a a a"), (7, "Ingénieur de données à Zürich 3000"),
]
KNOWN = ["data engineer", "Data  Engineer!", "data", "senior data engineer", "a a", "a a a", "données à", "zürich 3000", None, "", "--", "engineer and senior"]


@pytest.mark.parametrize("block, broadcast", [(4096, 1 << 25), (1, 1 << 25), (2, 0)])
def test_hits_equal_plain_comparison(spark, block, broadcast):
    """Blocks smaller than a phrase, and both ways of joining the index."""
    texts, known = spark.createDataFrame(TEXTS, "id long, body string"), spark.createDataFrame([(p,) for p in KNOWN], "p string")
    got = phrases.phrase_hits(texts, "id", "body", known, "p", block, broadcast)
    assert got.columns == ["id", "phrase", "n", "first"] and found(got) == brute(TEXTS, KNOWN)


def test_further_columns_with_clashing_names(spark):
    texts = spark.createDataFrame([(1, "red bolt", "x", {"a": 1})], "key long, text string, phrase string, head map<string,int>")
    known = spark.createDataFrame([("red bolt", 1)], "phrase string, n int")
    assert found(phrases.phrase_hits(texts, "key", "text", known, "phrase")) == {(1, "red bolt"): (1, 0)}


def test_empty_tables(spark):
    texts, known = spark.createDataFrame(TEXTS, "id long, body string"), spark.createDataFrame([("a",)], "p string")
    assert phrases.phrase_hits(texts, "id", "body", known.limit(0), "p").collect() == []
    assert phrases.phrase_hits(texts.limit(0), "id", "body", known, "p").collect() == []


def test_a_very_long_text_and_a_large_dictionary(spark):
    """100,000 phrases that share a thousand first words, and a text of 200,000 words in one row."""
    known = spark.range(100_000).selectExpr("concat('w', id % 1000, ' x', id div 1000) AS p")
    texts = spark.createDataFrame([(1,)], "id long").selectExpr("id", "array_join(flatten(transform(sequence(0, 99999), i -> array(concat('w', i % 1000), concat('x', i % 101)))), ' ') AS body")
    got = phrases.phrase_hits(texts, "id", "body", known, "p").collect()
    want = [(i % 1000, i % 101) for i in range(100_000) if i % 101 < 100]
    assert sum(r.n for r in got) == len(want) and len(got) == len(set(want))


def test_plan_has_no_nested_loops_and_no_wide_exchange(spark):
    texts, known = spark.createDataFrame(TEXTS, "id long, body string"), spark.createDataFrame([(p,) for p in KNOWN], "p string")
    plan = phrases.phrase_hits(texts, "id", "body", known, "p")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("BroadcastHashJoin") == 2


def test_texts_are_split_once_and_repeated_phrases_are_read_once(spark):
    """No filter splits again, neither texts nor the dictionary's rows before they are distinct, and no place copies its words into an array of structs."""
    texts, known = spark.createDataFrame(TEXTS, "id long, body string"), spark.createDataFrame([(p,) for p in KNOWN], "p string")
    lines = phrases.phrase_hits(texts, "id", "body", known, "p")._jdf.queryExecution().executedPlan().toString().splitlines()
    split = [x for x in lines if "regexp_extract_all" in x]
    assert len(split) == 1 and "Project" in split[0] and not any("transform(" in x for x in lines)
