import zlib

import numpy as np
import pytest

from amalgam.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_toxic_documents_are_found(spark, labels):
    rows = toxicity.op4_toxicity(spark, DATA).collect()
    assert len(rows) == 1000
    known = [(r, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    # documents whose text was ruined after they were labelled hold no toxic word, so only those of good quality count
    toxic = [r.toxic for r, k in known if k.toxic == 1 and k.quality == 1]
    clean = [r.toxic for r, k in known if k.toxic == 0]
    assert np.mean(toxic) > 0.95 and np.mean(clean) < 0.02
    assert all(0 <= r.severity <= 3 and r.grade == round(r.severity) for r in rows)


def test_toxic_held_out(spark, labels):
    known = [(r.toxic, labels[r.doc_id]) for r in toxicity.op4_toxicity(spark, DATA).collect() if r.doc_id in labels and held_out(r.doc_id)]
    assert np.mean([t == k.toxic for t, k in known]) > 0.95


def test_proportional_odds_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (3000, 6)).astype(float)
    score = x @ [1.5, 1.0, 0, 0, 0, -0.5] + rng.logistic(size=3000)
    grade = np.searchsorted([2.0, 4.0, 6.0], score)
    w, t = toxicity.proportional_odds(x, grade)
    assert np.abs(w - [1.5, 1.0, 0, 0, 0, -0.5]).max() < 0.3 and np.abs(t - [2, 4, 6]).max() < 0.6 and (np.diff(t) > 0).all()


def test_toxic_rows_go_and_columns_stay(spark, documents):
    texts = ["you awful gnarf person"] * 3 + ["a fine day at sea"] * 3 + [None, ""]
    docs = documents(texts * 4)
    labels = spark.createDataFrame([(i, int("gnarf" in (texts[i % 8] or "")), 1, "x") for i in range(32)], "doc_id long, toxic int, quality int, text string")
    out = toxicity.without_toxic(docs, labels)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [i for i in range(32) if i % 8 > 2]


def test_words_at_joints_and_in_scripts_without_spaces_are_seen(spark, documents):
    bad = ["you nice/gnarf person", "you well,GNARF person", "you so-gnarf person", "you g.n.a.r.f person", "you gnarf person"]
    texts = (["you gnarf person"] * 3 + ["you fine person"] * 3) * 6 + bad + ["you nice/fine person"]
    labels = spark.createDataFrame([(i, int("gnarf" in texts[i])) for i in range(36)], "doc_id long, toxic int")
    docs = documents(texts)
    rows = {r.doc_id: r.toxic for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert [rows[i] for i in range(36, len(texts))] == [1] * len(bad) + [0]
    one = toxicity.term_features
    assert set(one("bad")) | set(one("gnarf")) <= set(one("bad/gnarf")) and one("gnarf,") == one("gnarf") and len(one("bad/bad")) > len(set(one("bad/bad")))
    assert set(one("悪罵")) and set(one("悪罵")) <= set(one("今日は天気が悪罵良い")) and not set(one("悪罵")) & set(one("今日は天気が良い"))


def test_toxicity_without_labels(spark, documents, edge_texts):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    docs = documents(edge_texts)
    assert {(r.severity, r.toxic) for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()} == {(0.0, 0)}
    assert toxicity.without_toxic(documents([]), labels).collect() == []


def test_quality_held_out(spark, labels):
    rows = quality.op10_quality_classifier(spark, DATA).collect()
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    known = [(r, labels[r.doc_id].quality) for r in rows if r.doc_id in labels and r.held_out]
    assert np.mean([r.predicted == q for r, q in known]) > 0.95


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = quality.boosted(x, y)
    got = f.score(x)
    assert ((got > 0.5) == y).mean() > 0.9
    for row, s in zip(x[:40], got):
        total = f.base
        for feature, threshold, value in zip(f.feature, f.threshold, f.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12


def test_quality_edges(spark, documents, edge_texts):
    docs = documents(edge_texts, ids=[None, *range(1, len(edge_texts))])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(i, 0, int(i % 2), "x") for i in range(12)], "doc_id long, toxic int, quality int, text string")
    forest = quality.fit(docs, labels)
    assert len(quality.scored(docs, forest).collect()) == len(edge_texts)
    assert quality.scored(docs, forest, keep=True).columns == docs.columns
    assert quality.scored(documents([]), forest).collect() == []


def plain_features(text):
    """Counts of features by their description alone: words, their first 4 to 7 letters, glued words, scripts without spaces."""
    found = {}

    def add(kind, s, n=1):
        key = zlib.crc32(s.encode()) * 5 + kind
        found[key] = found.get(key, 0) + n

    def word(w):
        if len(w) >= 3:
            add(0, w)
            for k, n in enumerate((4, 5, 6, 7), 1):
                if len(w) >= n:
                    add(k, w[:n])

    for token in (text or "").lower().split():
        words = "".join(c if c.isalpha() else " " for c in token).split()
        before = dict(found)
        if len(words) > 1:
            for w in words:
                word(w)
        own = {k for k in found if found[k] != before.get(k, 0)}
        glued = "".join(words)
        if len(glued) >= 3:
            for k, s in enumerate([glued, *(glued[:n] for n in (4, 5, 6, 7))]):
                if (k == 0 or len(glued) >= k + 3) and (key := zlib.crc32(s.encode()) * 5 + k) not in own:
                    found[key] = found.get(key, 0) + 1
    return found


def test_toxicity_equals_brute_force(spark, labels):
    """Selection, counts, severity and grade of every document, recomputed from the texts and the labels."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    features = {d: plain_features(t) for d, t in docs.items()}
    known = [d for d in labels if d in docs and not held_out(d)]
    toxic = [d for d in known if labels[d].toxic]
    n, m = len(toxic), len(known) - len(toxic)
    chi = {}
    for f in {f for d in toxic for f in features[d]}:
        t, c = sum(f in features[d] for d in toxic), sum(f in features[d] for d in known if not labels[d].toxic)
        if t >= 2 and t * m > c * n:
            chi[f] = (t * m - c * n) ** 2 * (n + m) / ((t + c) * max(n + m - t - c, 1) * n * m)
    best = sorted(chi, key=lambda f: (-chi[f], f))[: toxicity.KEPT]
    assert sorted(model.features) == sorted(best)
    for r in toxicity.op4_toxicity(spark, DATA).collect():
        score = sum(w * np.log1p(features[r.doc_id].get(f, 0)) for f, w in ((f, model.weights[i]) for f, i in model.features.items()))
        reach = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert r.severity == pytest.approx(sum(reach), abs=1e-9) and r.toxic == (reach[0] >= 0.5)
        assert abs(sum(reach) % 1 - 0.5) < 1e-9 or r.grade == round(sum(reach))


def test_fit_is_near_the_best_weights():
    """No small step in any direction makes the penalised loss of a fit much better."""
    rng = np.random.default_rng(4)
    x = rng.poisson(1.0, (2000, 5)).astype(float)
    grade = np.searchsorted([1.0, 2.5, 4.0], x @ [1.0, 0.5, 0, -0.5, 0.2] + rng.logistic(size=2000))
    w, t = toxicity.proportional_odds(x, grade)

    def loss(w, t):
        reach = np.hstack([np.ones((len(x), 1)), 1 / (1 + np.exp(-((x @ w)[:, None] - t))), np.zeros((len(x), 1))])
        row = np.arange(len(x))
        return -np.log(np.maximum(reach[row, grade] - reach[row, grade + 1], 1e-12)).mean() + 1e-4 * w @ w

    here = loss(w, t)
    for k in range(5):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(5)[k], t) > here - 2e-4
    for k in range(3):
        for step in (-0.05, 0.05):
            assert loss(w, t + step * np.eye(3)[k]) > here - 2e-4


def test_toxicity_edges_with_a_fitted_model(spark, documents, edge_texts):
    """Nulls, very long texts, ties, repeated rows and clashing columns, all read by a model."""
    base = (["you gnarf person"] * 3 + ["you fine person"] * 3) * 6
    long_toxic, long_clean = "fine words here " * 60_000 + "gnarf " * 70_000, "fine words here " * 60_000
    texts = [*base, *edge_texts, long_toxic, long_clean, "gnarf", "gnarf"]
    ids = [*range(len(base)), *[None] * len(edge_texts), 900, 901, 902, 902]
    docs = documents(texts, ids=ids)
    labels = spark.createDataFrame([(i, int("gnarf" in t), "z") for i, t in enumerate(base)] + [(900, 1, "z")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[900].toxic == 1 and by[901].toxic == 0 and by[900].severity > by[0].severity
    assert all(r.toxic == 0 for r in rows if r.doc_id is None)
    twice = [(r.severity, r.toxic) for r in rows if r.doc_id == 902]
    assert len(twice) == 2 and len(set(twice)) == 1 and twice[0][1] == 1
    # counts above 65,535 are counted: more of the word is still worse
    more = documents(["gnarf " * 65_535, "gnarf " * 120_000])
    less, most = (r.severity for r in sorted(toxicity.scored(more, model).collect(), key=lambda r: r.doc_id))
    x, _ = toxicity.sample_counts(more.selectExpr("doc_id as _id", "text", "1 as toxic"), model.features)
    assert most >= less and x.max() == 120_000


def test_a_repeated_labelled_row_is_sampled_once(spark, documents):
    docs = documents(["you gnarf person", "other text"] * 500, ids=[1, 1] * 500)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels).count() == 1


def plain_statistics(text):
    if not text:
        return [0.0] * quality.N_STATISTICS
    data, words, lines, seen = text.encode(), text.split(), text.split("\n"), {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    out = [sum(data.count(bytes([b])) for b in members) / len(data) for members in quality.CLASSES.values()]
    n, full = len(words) + 1, [x for x in lines if x]
    f = len(full) + 1
    share = [data.count(bytes([b])) / len(data) for b in set(data)]
    out += [np.log(1 + len(text)), np.log(n), len(text) / n, len(set(words)) / n, max(seen.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n]
    out += [sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n, sum(w.isalpha() for w in words) / n, np.log(f), len(set(full)) / f, sum(x.isupper() for x in full) / f, sum(" | " in x for x in full) / f]
    return [*out, -sum(p * np.log2(p) for p in share), max(map(len, words), default=0), np.log(1 + max(map(len, lines)))]


def test_quality_equals_brute_force(spark):
    """Statistics of every document, and its score by walking each tree."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    forest = quality.fit(docs, labels)
    rows = {r.doc_id: r.score for r in quality.op10_quality_classifier(spark, DATA).collect()}
    for d in docs.collect():
        x = quality.statistics(d.text)
        assert x == pytest.approx(plain_statistics(d.text), abs=1e-9)
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        assert rows[d.doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_quality_of_long_repeated_and_tied_rows(spark, documents):
    texts = ["a fine plain text of words", "!!!! @@@@ ####"] * 20 + ["long words here. " * 100_000, "long words here. " * 100_000, None]
    docs = documents(texts, ids=[*range(40), 77, 77, None])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), "t") for i in range(40)], "doc_id long, quality int, text string")
    assert all(quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-9) for t in texts[:2] + texts[-2:])
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    twice = [r.score for r in rows if r.doc_id == 77]
    assert len(rows) == len(texts) and len(twice) == 2 and twice[0] == twice[1]
    by = {r.doc_id: r.predicted for r in rows}
    assert by[0] == 1 and by[1] == 0
