import hashlib
import re
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from amalgam.llm import bpe, mixing, quality, toxicity

from .test_classifiers import plain_features, plain_statistics
from .test_mixing import flattened
from .test_simhash import brute_components, brute_fingerprint


def test_stages_equal_brute_force(spark):
    data = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs, frame = sorted(table.collect(), key=lambda d: d.doc_id), table
    # toxicity, by plain loops over the fitted model
    model = toxicity.fit(frame, labels)

    def toxic(text):
        x = np.zeros(len(model.weights))
        for token in text.split():
            for f in toxicity.term_features(token):
                if f in model.features:
                    x[model.features[f]] += 1
        return np.log1p(x) @ model.weights >= model.thresholds[0]

    docs = [d for d in docs if not toxic(d.text)]
    frame = spark.createDataFrame(docs, table.schema)
    forest = quality.fit(frame, labels)
    docs = [d for d in docs if forest.score(quality.statistics(d.text)[None, :])[0] >= 0.3]
    part = brute_components([d.doc_id for d in docs], [brute_fingerprint(d.text) for d in docs])
    docs = [d for d in docs if part[d.doc_id] == d.doc_id]
    frame = spark.createDataFrame(docs, table.schema)
    chosen = {r.doc_id for r in mixing.calibrated(frame).collect() if r.sampled}
    docs = [d for d in docs if d.doc_id in chosen]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = set()
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        want.add((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.text.encode()).hexdigest()))
    got = {tuple(r) for r in corpus_pipeline.run(spark, data).collect()}
    assert len(got) > 300 and got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def brute_topic(text):
    if not text:
        return "other"
    for name, pattern in (("legal", r"(?ia)\blicen[cs]e|\bcopyright\b|\bterms of\b"), ("contact", r"(?a)[\w.+-]@[\w-]+\.\w|\bhttps?://|\bwww\."), ("table", r" \| "), ("figures", r"(?a)\d{3}")):
        if re.search(pattern, text):
            return name
    return "prose"


def brute_copies(docs):
    """How often each of (doc_id, text, source, lang) is drawn, by raking and MD5 in plain Python."""
    cells, tokens = [(d[2] or "", d[3] or "", brute_topic(d[1])) for d in docs], [max(1, -(-len((d[1] or "").encode()) // 4)) for d in docs]
    own = defaultdict(int)
    for c, n in zip(cells, tokens):
        own[c] += n
    aims = [flattened(own, m) for m in range(3)]
    w = {c: float(n) for c, n in own.items()}
    while True:
        worst = 0.0
        for m in range(3):
            sums = defaultdict(float)
            for c, x in w.items():
                sums[c[m]] += x
            worst = max(worst, *(abs(sums[k] / aims[m][k] - 1) for k in sums))
            w = {c: x * aims[m][c[m]] / sums[c[m]] for c, x in w.items()}
        if worst <= 1e-4:
            break
    factor = {c: round(w[c] / own[c], 9) for c in w}
    upto, top = 0, None
    for c in sorted(factor, key=factor.get):
        upto += own[c]
        if top is None and upto >= 0.5 * sum(own.values()):
            top = factor[c]
    out = []
    for d, c in zip(docs, cells):
        expected = factor[c] / top
        draw = int(hashlib.md5(f"{'' if d[0] is None else d[0]}:11".encode()).hexdigest()[:12], 16) / 2**48
        out.append(int(expected) + (draw < expected - int(expected)))
    return out


def test_stages_equal_their_descriptions(spark):
    """As above, but features, statistics, trees and the draw are computed here, and rows count."""
    data = "/root/testdata/sf0.01"
    table, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs = sorted(table.collect(), key=lambda d: d.doc_id)
    model = toxicity.fit(table, labels)
    weight = {f: model.weights[i] for f, i in model.features.items()}
    docs = [d for d in docs if sum(weight.get(f, 0) * np.log1p(n) for f, n in plain_features(d.text).items()) < model.thresholds[0]]
    forest = quality.fit(spark.createDataFrame(docs, table.schema), labels)

    def good(text):
        x, total = plain_statistics(text), forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total)) >= 0.3

    docs = [d for d in docs if good(d.text)]
    part = brute_components([d.doc_id for d in docs], [brute_fingerprint(d.text) for d in docs])
    docs = [d for d in docs if part[d.doc_id] == d.doc_id]
    times = brute_copies([(d.doc_id, d.text, d.source, d.lang) for d in docs])
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((d.doc_id, len(library.encode(d.text, add_special_tokens=False).ids)) for d, n in zip(docs, times) for _ in range(n))
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, data).collect())
    assert len(got) > 300 and got == want


def test_edges_through_all_stages(spark, edge_texts, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing columns."""
    toxic, fine = "you gnarf person at the gate", "a fine quiet day at the long shore number"
    rows = [(i, f"{toxic} {i}" if i % 4 == 0 else f"{fine} {i} {'word ' * (i % 7)}", ["en", "de", None][i % 3], ["s0", "s1", None][i % 3]) for i in range(80)]
    rows += [(None, t, ["en", None][i % 2], ["s0", None][i % 2]) for i, t in enumerate(edge_texts)] + [(100, None, "en", "s0"), (100, "", "de", "s1"), (None, None, None, None)]
    rows += [(200, "the very same text of a few words", "en", "s0")] * 3 + [(None, "the very same text of a few words", None, None)] * 2
    clash = "doc_id long, text string, lang string, source string, n_chars long, _row long, fp long, toxic int, topic string, w double, tokens long, at array<int>, key string, _mix_copies int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, 1, 1, "t", 1.0, 1, [1], "k", 1) for r in rows], clash)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "z") for i in range(80)] + [(None, 1, 1, "z"), (3, None, None, "z")], "doc_id long, quality int, toxic int, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        found = kept.collect()
        kept = spark.createDataFrame(found, kept.schema)
        if name == "toxicity":
            assert not any("gnarf" in (r.text or "") for r in found) and sum(r.doc_id is None for r in found) == len(edge_texts) + 3
        if name == "SimHash near-dedup":
            same = [r for r in found if (r.text or "").startswith("the very same")]
            blank = [r for r in found if not (r.text or "").strip()]
            assert len(same) <= 1 and len(blank) <= 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r.doc_id), r.n_tokens) for r in corpus_pipeline.encode(spark, kept, "").collect())
