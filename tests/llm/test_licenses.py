import re

import pytest

from amalgam.llm import licenses


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text):
    words = words_of(text)
    starts, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += here
        if here:
            base.add(label)
            score = 1.0
    for t in licenses.templates():
        if not t["base"]:
            for s in range(-30, len(words)):
                got = [k for k, (o, w) in enumerate(t["words"]) if 0 <= s + o < len(words) and words[s + o] == w]
                if len(got) >= t["least"] and set(t["must"]) <= set(got):
                    labels.add(t["label"])
                    score = max(score, len(got) / len(t["words"]))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels | base, score


def check(rows, docs):
    rows, docs = (sorted(x, key=lambda r: (str(r[0]), r[1])) for x in (rows, [(d, *brute(t)) for d, t in docs]))
    assert len(rows) == len(docs)
    for r, (d, n, n_base, first, last, base, most, score) in zip(rows, docs):
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (d, n, n_base, first, last, base)
        got = {x for x in r.labels.split(",") if x}
        assert got == most and r.labels == ",".join(sorted(got)) and r.score == pytest.approx(score, abs=1e-9)


def test_documents_equal_brute_force(spark):
    data = "/root/testdata/sf0.01"
    rows = licenses.op6_license_scan(spark, data).collect()
    check(rows, [(d.doc_id, d.text) for d in spark.read.parquet(f"{data}/documents.parquet").collect()])
    assert sum(r.n_base for r in rows) > 5


def test_edges(documents, edge_texts):
    texts = [*edge_texts, "MIT License", "mit-license, MIT\nLICENSE! mit license", "İs the apache licenſe, Apache\x00License", "cc by by cc by", "gnu general public", "the gnu general public license",
             "Licensed under CC BY-NC 4.0.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Kapache license K apache license", "apache license apache license"]
    docs = documents(texts * 2, ids=[None, *range(1, 2 * len(texts))])
    check(licenses.scanned(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    by = {r.doc_id: r for r in licenses.scanned(documents(texts)).collect()}
    n = len(edge_texts)
    assert by[n + 1].n_base == 3 and by[n + 6].labels == "cc-by,cc-by-nc" and by[n + 7].labels == "bsd"


def test_empty_table(documents):
    assert licenses.scanned(documents([])).collect() == []


def test_altered_notices_equal_the_plain_rule(documents):
    texts = ["Redistributions and use in source and binary forms, with or without modification, are permitted", "Released under the MIT License", "Relicensed under the MIT License",
             "these programs are free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "source and binary forms", "source code of a work"]
    rows = {r.doc_id: r for r in licenses.scanned(documents(texts)).collect()}
    for i, text in enumerate(texts):
        *_, labels, score = brute(text)
        assert (set(rows[i].labels.split(",")) - {""}, rows[i].score) == (labels, score)
    assert rows[0].labels == "bsd" and rows[0].score == 0.9


def test_notices_equal_the_plain_rule(documents):
    """Each notice whole, cut at either end, with a word replaced, and all of them after one another."""
    whole = [n for n, _, _ in licenses.NOTICES]
    texts = [*whole, *(" ".join(n.split()[2:]) for n in whole), *(" ".join(n.split()[:-2]) for n in whole), *(n.replace(" the ", " every ").replace("public", "private") for n in whole), ". ".join(whole * 2), "x".join(whole)]
    rows = {r.doc_id: r for r in licenses.scanned(documents(texts)).collect()}
    for i, text in enumerate(texts):
        *_, most, score = brute(text)
        assert (set(rows[i].labels.split(",")) - {""}, round(rows[i].score, 12)) == (most, round(score, 12))


def test_long_text_of_nothing_but_notices(documents):
    n = 30_000
    (row,) = licenses.scanned(documents(["Released under the MIT License. " * n])).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.labels, row.score) == (5 * n, n, 3, 5 * n - 2, "mit", 1.0)


def test_postings_stay_in_their_rows(documents):
    """Only word frequencies are shuffled: the result's plan has no exchange."""
    plan = licenses.scanned(documents(["mit license", None]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
