"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from amalgam.llm import bpe, embed, licenses, mixing, packing, periodic, quality, resample, shards, simhash, sketch, token_files, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embed.op1_embedding_near_dedup,
    "op2_document_fingerprints": sketch.op2_document_fingerprints,
    "op3_bpe_encode_decode": bpe.op3_bpe_encode_decode,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_token_id_files": token_files.op7_token_id_files,
    "op8_sharding": shards.op8_sharding,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_importance_resampling": resample.op11_importance_resampling,
    "op12_power_of_two_packing": packing.op12_power_of_two_packing,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

#: All pairs of equal label, and what they reach.
EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS row FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
    link AS (SELECT a.row AS a, b.row AS b FROM good a JOIN good b ON a.label = b.label AND a.row <> b.row AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {embed.THRESHOLD}),
    reach AS (SELECT row AS a, row AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
    part AS (SELECT r.a AS row, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.row = r.b GROUP BY r.a)
  SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.row) AS n_links, p.component_id, coalesce(v.vec_id = p.component_id, false) AS kept FROM v JOIN part p ON p.row = v.row"""


#: The licence rules in words: template, label, whether it is a phrase, its words and the mandatory ones among them.
LICENCE_RULES = """(VALUES
    (1, 'gpl', true, 'gnu general public license', 'gnu general public license'), (2, 'apache', true, 'apache license', 'apache license'), (3, 'cc-by', true, 'cc by', 'cc by'), (4, 'mit', true, 'mit license', 'mit license'),
    (5, 'apache', false, 'licensed under the apache license version 2 0', 'apache license'),
    (6, 'apache', false, 'unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis', 'applicable law or agreed to in writing'),
    (7, 'gpl', false, 'this work is licensed under the gnu general public license version 3', 'gnu general public license'),
    (8, 'gpl', false, 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license', 'free software'),
    (9, 'gpl', false, 'you should have received a copy of the gnu general public license along with this program', 'gnu general public license'),
    (10, 'mit', false, 'released under the mit license', 'mit license'),
    (11, 'mit', false, 'permission is hereby granted free of charge to any person obtaining a copy of this software', 'permission is hereby granted'),
    (12, 'mit', false, 'the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'permission notice shall be included'),
    (13, 'cc-by-nc', false, 'licensed under cc by nc 4 0', 'cc by nc'), (14, 'cc-by-sa', false, 'licensed under cc by sa 4 0', 'cc by sa'),
    (15, 'cc-by', false, 'this work is licensed under a creative commons attribution', 'creative commons attribution'),
    (16, 'cc-by-sa', false, 'creative commons attribution sharealike', 'creative commons attribution sharealike'),
    (17, 'cc0', false, 'cc0 1 0 universal public domain dedication', 'cc0 1 0 universal'),
    (18, 'bsd', false, 'redistribution and use in source and binary forms with or without modification are permitted', 'source and binary forms'),
    (19, 'bsd', false, 'may be used to endorse or promote products derived from this software without specific prior written permission', 'endorse or promote products'),
    (20, 'isc', false, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted', 'with or without fee'),
    (21, 'mpl', false, 'this source code form is subject to the terms of the mozilla public license', 'mozilla public license'),
    (22, 'epl', false, 'this program and the accompanying materials are made available under the terms of the eclipse public license', 'eclipse public license'),
    (23, 'bsl', false, 'boost software license version 1 0', 'boost software license'),
    (24, 'unlicense', false, 'this is free and unencumbered software released into the public domain', 'free and unencumbered software'),
    (25, 'agpl', false, 'gnu affero general public license', 'gnu affero general public license'), (26, 'lgpl', false, 'gnu lesser general public license', 'gnu lesser general public license')
  ) AS rule(template, label, base, txt, must)"""
#: The plain rule: a place counts where the mandatory words stand and 70 % of all looked-up ones do.
LICENCES = rf"""WITH rule AS (SELECT *, string_split(txt, ' ') AS ws, len(string_split(must, ' ')) AS m FROM {LICENCE_RULES}),
    spot AS (SELECT *, list_min(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + m] = string_split(must, ' '))) AS f FROM rule),
    each AS (SELECT template, label, base, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place, f, m FROM spot),
    post AS (SELECT *, place >= f AND place < f + m AS key, count(*) OVER (PARTITION BY template) AS size FROM each
      WHERE base OR (place >= f AND place < f + m) OR word NOT IN ('the', 'a', 'of', 'to', 'in', 'it', 'or', 'you', 'can', 'any', 'with', 'are', 'this')),
    d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
    met AS (SELECT w.rid, p.template, w.pos - p.place AS start, p.label, p.base, p.m, p.size, count(*) AS n, count(*) FILTER (WHERE p.key) AS keys FROM w JOIN post p ON p.word = w.word GROUP BY ALL),
    ok AS (SELECT *, n / size AS share FROM met WHERE keys = m AND n >= CASE WHEN base THEN size ELSE ceil(0.7 * size) END),
    found AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY rid)
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
  FROM d LEFT JOIN found f ON f.rid = d.rid"""

#: Raking to flattened own shares, round by round, and the draw by MD5.
MIXING = r"""WITH RECURSIVE doc AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, greatest(CAST(ceil(coalesce(strlen(text), 0) / 4.0) AS BIGINT), 1) AS tokens,
      CASE WHEN text IS NULL OR text = '' THEN 'other' WHEN regexp_matches(text, '(?i)\blicen[cs]e|\bcopyright\b|\bterms of\b') THEN 'legal' WHEN regexp_matches(text, '[\w.+-]@[\w-]+\.\w|\bhttps?://|\bwww\.') THEN 'contact'
        WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '\d{3}') THEN 'figures' ELSE 'prose' END AS topic FROM documents),
    cell AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM doc GROUP BY ALL),
    by_source AS (SELECT source, pow(sum(tokens), 0.7) AS p FROM doc GROUP BY ALL), by_lang AS (SELECT lang, pow(sum(tokens), 0.7) AS p FROM doc GROUP BY ALL), by_topic AS (SELECT topic, pow(sum(tokens), 0.7) AS p FROM doc GROUP BY ALL),
    whole AS (SELECT sum(tokens) AS total, (SELECT sum(p) FROM by_source) AS s, (SELECT sum(p) FROM by_lang) AS l, (SELECT sum(p) FROM by_topic) AS t FROM doc),
    start AS (SELECT cell.*, total * by_source.p / s AS source_aim, total * by_lang.p / l AS lang_aim, total * by_topic.p / t AS topic_aim
      FROM cell JOIN by_source USING (source) JOIN by_lang USING (lang) JOIN by_topic USING (topic) CROSS JOIN whole),
    fit AS (SELECT 0 AS round, source, lang, topic, tokens, source_aim, lang_aim, topic_aim, CAST(tokens AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS off FROM start
      UNION ALL SELECT round + 1, source, lang, topic, tokens, source_aim, lang_aim, topic_aim, w * topic_aim / topic_sum, max(greatest(source_off, lang_off, abs(topic_sum / topic_aim - 1))) OVER ()
        FROM (SELECT *, sum(w) OVER (PARTITION BY topic) AS topic_sum
          FROM (SELECT * REPLACE (w * lang_aim / lang_sum AS w), abs(lang_sum / lang_aim - 1) AS lang_off
            FROM (SELECT *, sum(w) OVER (PARTITION BY lang) AS lang_sum
              FROM (SELECT * REPLACE (w * source_aim / source_sum AS w), abs(source_sum / source_aim - 1) AS source_off FROM (SELECT *, sum(w) OVER (PARTITION BY source) AS source_sum FROM fit WHERE off > 0.0001 AND round < 1000)))))),
    fitted AS (SELECT source, lang, topic, tokens, round(w / tokens, 9) AS factor FROM fit WHERE round = (SELECT max(round) FROM fit)),
    top AS (SELECT min(factor) AS top FROM (SELECT factor, sum(tokens) OVER (ORDER BY factor) AS upto, sum(tokens) OVER () AS total FROM fitted) WHERE upto >= 0.5 * total),
    decided AS (SELECT doc_id, source, lang, topic, doc.tokens, factor, factor / top AS expected, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':11'), 1, 12) AS BIGINT) / 281474976710656.0 AS draw
      FROM doc JOIN fitted USING (source, lang, topic) CROSS JOIN top),
    counted AS (SELECT *, CAST(floor(expected) AS BIGINT) + CASE WHEN draw < expected - floor(expected) THEN 1 ELSE 0 END AS copies FROM decided)
  SELECT doc_id, source, lang, topic, tokens, factor, least(1.0, expected) AS probability, expected, copies > 0 AS sampled, CAST(copies AS BIGINT) AS copies FROM counted"""

#: CRC32 byte by byte over distinct words, gains by bucket, and one order of all scores.
RESAMPLING = r"""WITH RECURSIVE bit AS (SELECT range AS b, range AS c, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
    byte AS (SELECT b, c FROM bit WHERE k = 8),
    text AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
    word AS (SELECT side, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM text),
    each AS (SELECT side, rid, w, count(*) AS n FROM word GROUP BY ALL),
    roll AS (SELECT w, hex(encode(w)) AS hx, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT w FROM each)
      UNION ALL SELECT w, hx, i + 1, xor(roll.c >> 8, byte.c) FROM roll JOIN byte ON byte.b = xor(roll.c & 255, CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) WHERE 2 * i < length(hx)),
    hashed AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM roll WHERE 2 * i = length(hx)),
    held AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM each JOIN hashed USING (w) GROUP BY bucket),
    whole AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM held),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(s AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM held CROSS JOIN whole),
    weighed AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM each JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
    scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM text LEFT JOIN weighed USING (rid) WHERE side = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS eligible FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM placed"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": EMBEDDINGS, "op6_license_scan": LICENCES, "op9_source_mixing": MIXING, "op11_importance_resampling": RESAMPLING}
