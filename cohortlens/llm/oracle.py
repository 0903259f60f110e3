"""DuckDB SQL for the queries that SQL can express; written apart from the operators, with its own literals."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = r"""
WITH phrase(label, base, words) AS (VALUES
  ('cc-by', true, ['cc', 'by']),
  ('gpl', true, ['general', 'public', 'license']),
  ('reserved', true, ['all', 'rights', 'reserved']),
  ('apache-2.0', false, ['apache', 'license', 'version', '2', '0']),
  ('mit', false, ['mit', 'license']),
  ('mit-text', false, ['permission', 'is', 'hereby', 'granted', 'free', 'of', 'charge']),
  ('bsd', false, ['redistribution', 'and', 'use', 'in', 'source', 'and', 'binary', 'forms']),
  ('gpl-3', false, ['gnu', 'general', 'public', 'license', 'version', '3']),
  ('lgpl', false, ['gnu', 'lesser', 'general', 'public', 'license']),
  ('agpl', false, ['gnu', 'affero', 'general', 'public', 'license']),
  ('mpl-2.0', false, ['mozilla', 'public', 'license']),
  ('cc-by-nc', false, ['cc', 'by', 'nc']),
  ('cc-by-sa', false, ['cc', 'by', 'sa']),
  ('unlicense', false, ['free', 'and', 'unencumbered', 'software']),
  ('unlicense', false, ['public', 'domain'])),
body(label, text) AS (VALUES
  ('apache-2.0', 'licensed under the apache license version 2 0'),
  ('mit', 'released under the mit license'),
  ('mit-text', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  ('gpl-3', 'this work is licensed under the gnu general public license version 3'),
  ('mpl-2.0', 'subject to the terms of the mozilla public license v 2 0'),
  ('cc-by-nc', 'licensed under cc by nc 4 0'),
  ('cc-by-sa', 'licensed under cc by sa 4 0'),
  ('unlicense', 'this is free and unencumbered software released into the public domain')),
own AS (SELECT DISTINCT label, word FROM (
  SELECT label, unnest(words) AS word FROM phrase UNION ALL SELECT label, unnest(string_split(text, ' ')) FROM body)),
d AS (SELECT row_number() OVER () AS rid, doc_id, WORDS AS w FROM documents),
token AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
idf AS (SELECT word, CAST(round(1000 * ln(((SELECT count(*) FROM d) + 2) / (count(DISTINCT rid) + 1.0))) AS BIGINT) AS idf
  FROM (SELECT DISTINCT word FROM own) LEFT JOIN token USING (word) GROUP BY word),
place AS (SELECT d.rid, p.label, p.base, p.words, t.pos
  FROM token t JOIN phrase p ON t.word = p.words[1] JOIN d ON d.rid = t.rid
  WHERE d.w[t.pos + 1 : t.pos + len(p.words)] = p.words),
found AS (SELECT rid, label, bool_or(base) AS base FROM place GROUP BY rid, label
  HAVING count(DISTINCT words) = (SELECT count(*) FROM phrase p WHERE p.label = place.label)),
share AS (SELECT f.rid, f.label, f.base,
    sum(CASE WHEN list_contains(d.w, o.word) THEN i.idf ELSE 0 END) / CAST(greatest(sum(i.idf), 1) AS DOUBLE) AS share
  FROM found f JOIN d USING (rid) JOIN own o USING (label) JOIN idf i USING (word) GROUP BY f.rid, f.label, f.base),
l AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels,
    string_agg(label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, max(share) AS score FROM share GROUP BY rid),
b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM place WHERE base GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN l USING (rid) LEFT JOIN b USING (rid)
""".replace("WORDS", _WORDS.format(t="text"))

OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY cp DESC, doc_id)
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, DWORDS AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, DWORDS AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT item_id, k, w[i : i + k - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM b),
dw AS (SELECT rid, k, i, w[i : i + k - 1] AS win
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT rid, i, k, item_id FROM dw JOIN win USING (k, win)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN items USING (rid)
""".replace("DWORDS", _WORDS.format(t="text"))

OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT html, list_reduce(list_transform(string_split(upper(sha1(html)), ''), lambda h:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
    [instr('0123456789ABCDEF', h)]), lambda a, b: a || b) AS bits FROM (SELECT DISTINCT html FROM p)),
digest AS (SELECT html, list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT)
        + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), lambda a, b: a || b) AS digest FROM bits),
best AS (SELECT html, max(page_id) AS best FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p JOIN digest USING (html) JOIN best USING (html)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
token AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM token GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM token JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)::HUGEINT) // (any_value(total) + 5 * any_value(v))::HUGEINT AS q
  FROM p JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS two, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b USING (lang, term)
    GROUP BY a.lang, a.source, b.source) s ON s.lang = a.lang AND s.one = a.source AND s.two = b.source),
term AS (SELECT lang, source, term AS item, p - q AS f FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, item) AS rank FROM pair
  UNION ALL SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, item) AS rank FROM term)
WHERE part = 'pair' OR rank <= 50
"""

ORACLE = {"op1_license_scan": OP1, "op2_exact_dedup": OP2, "op3_decontaminate": OP3, "op5_warc": OP5, "op11_fill_middle": OP11,
          "op12_source_audit": OP12}
