"""DuckDB SQL of the queries that SQL can express, over the raw tables."""

_OP1 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS txt FROM documents),
lists AS (
  SELECT doc_id, source, txt,
         [x for x in string_split_regex(txt, '[\x20\x09-\x0D]+') if x <> ''] AS ws,
         [x for x in string_split(txt, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM t),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM lists),
win AS (
  SELECT doc_id, p, w AS a,
         lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
rep AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM win WHERE e IS NOT NULL)
  WHERE n > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat FROM rep, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, source, len(ws) AS n_words,
         length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words
  FROM lists l LEFT JOIN cov USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f1,
         100 * n_symbols > 10 * word_chars AS f2, 100 * n_dup_lines > 30 * n_lines AS f3 FROM m),
h AS (
  SELECT source, r, count(*) AS n, sum(bad::INT) AS k
  FROM (SELECT source, unnest([1, 2, 3]) AS r, unnest([f1, f2, f3]) AS bad FROM f WHERE source IS NOT NULL)
  GROUP BY source, r),
g AS (SELECT r, sum(n) AS n, count(*) AS hosts, sum(k) / sum(n) AS rate FROM h GROUP BY r),
s AS (
  SELECT g.r, g.rate, g.rate * (1 - g.rate) AS noise, g.n - g.hosts AS room, g.hosts,
         sum(h.n * (h.k / h.n - g.rate) ** 2) AS spread
  FROM h JOIN g USING (r) GROUP BY ALL),
q AS (
  SELECT r, rate, 1 / least(greatest(CASE WHEN noise * room > 0
           THEN (spread - hosts * noise) / (noise * room) ELSE 0.0001 END, 0.0001), 0.5) - 1 AS strength
  FROM s),
post AS (
  SELECT source, (k + strength * rate) / (n + strength) AS mean, n + strength AS size
  FROM h JOIN q USING (r)),
ok AS (
  SELECT source, bool_and(mean - 2 * sqrt(mean * (1 - mean) / (size + 1)) <= 0.5) AS host_ok
  FROM post GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed,
       NOT f1 AND coalesce(host_ok, TRUE) AS kept
FROM f LEFT JOIN ok USING (source)
"""

_OP2 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS colon FROM pages),
a AS (SELECT page_id, CASE WHEN colon > 0 THEN substr(u, colon + 3) END AS rest FROM p),
b AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
lab AS (
  SELECT b.page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::INT) AS k
  FROM b JOIN labels l ON try_cast(regexp_extract(path, '/([0-9]+)[^/]*$', 1) AS BIGINT) = l.doc_id
  WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY b.page_id),
hosts AS (
  SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k FROM b LEFT JOIN lab USING (page_id) GROUP BY host),
named AS (
  SELECT *, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz')
                 THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz')
              THEN two ELSE parts[-1] END AS suffix
  FROM (SELECT *, array_to_string(parts[-2:], '.') AS two
        FROM (SELECT *, string_split(host, '.') AS parts FROM hosts))),
known AS (SELECT * FROM named WHERE n > 0),
overall AS (SELECT coalesce(sum(k) / sum(n), 0) AS m FROM known),
sfx0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM known, overall GROUP BY suffix),
sfx AS (
  SELECT suffix, (k + st * m) / (n + st) AS rate
  FROM sfx0, (SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m) ** 2 - m * (1 - m))
                / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS st FROM sfx0)),
dom0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(rate) AS m
  FROM known JOIN sfx USING (suffix) GROUP BY domain, suffix),
dom AS (
  SELECT domain, (k + st * m) / (n + st) AS rate
  FROM dom0, (SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m) ** 2 - m * (1 - m))
                / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS st FROM dom0)),
hs AS (
  SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m) ** 2 - m * (1 - m))
           / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001), 0.001), 0.5) - 1 AS st
  FROM (SELECT n, k, rate AS m FROM known JOIN dom USING (domain))),
rep AS (
  SELECT host, n, (k + st * m) / (n + st) AS rate, st
  FROM (SELECT host, n, k, coalesce(d.rate, s.rate, overall.m) AS m
        FROM named LEFT JOIN dom d USING (domain) LEFT JOIN sfx s USING (suffix), overall), hs),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
SELECT page_id, r.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN rate - 2 * sqrt(rate * (1 - rate) / (n + st + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN rep USING (host)
"""

_OP9 = r"""
WITH s0 AS (
  SELECT doc_id, text,
         [x for x in regexp_extract_all(text, '(?s).*?(?:[.!?]\s+|\n\s*|$)') if x <> ''] AS parts
  FROM documents),
s1 AS (SELECT doc_id, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s0),
s2 AS (
  SELECT doc_id, i, trim(lower(regexp_replace(part, '\s+', ' ', 'g'))) AS norm FROM s1),
s3 AS (
  SELECT doc_id, i, norm, sum(CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END)
         OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM s2),
s AS (
  SELECT *, lag(cum, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM s3),
lists AS (SELECT doc_id, list(norm ORDER BY i) AS norms FROM s GROUP BY doc_id),
ahead AS (
  SELECT a.doc_id, a.i AS f, min(b.i) AS l FROM s a JOIN s b
  ON a.doc_id = b.doc_id AND b.i > a.i AND b.cum - a.prior >= 20 GROUP BY ALL),
back AS (
  SELECT b.doc_id, max(a.i) AS f, b.i AS l FROM s a JOIN s b
  ON a.doc_id = b.doc_id AND b.i > a.i AND b.cum - a.prior >= 20 GROUP BY ALL),
runs AS (
  SELECT doc_id, f, l, array_to_string(norms[f:l], chr(10)) AS run
  FROM (SELECT * FROM ahead UNION SELECT * FROM back
        UNION SELECT doc_id, i, i FROM s WHERE cum - prior >= 30) JOIN lists USING (doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, f) AS k FROM runs),
cut AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS i FROM ranked WHERE k > 1),
kept AS (
  SELECT s1.doc_id, string_agg(part, '' ORDER BY s1.i) FILTER (WHERE cut.i IS NULL) AS txt,
         count(cut.i) AS n_removed
  FROM s1 LEFT JOIN cut ON s1.doc_id = cut.doc_id AND s1.i = cut.i GROUP BY s1.doc_id)
SELECT s0.doc_id,
       CASE WHEN n_removed > 0 THEN rtrim(coalesce(txt, ''), ' ' || chr(10) || chr(9) || chr(13)) ELSE text END AS text,
       coalesce(len(parts), 0)::INT AS n_sentences, coalesce(n_removed, 0)::INT AS n_removed
FROM s0 LEFT JOIN kept USING (doc_id)
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY turn NULLS FIRST, role, body)
                       FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': '
                  || regexp_replace(body, '([\\#<])', '\\\1', 'g') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, coalesce('=' || lang, '') AS tree, doc_id, n_chars,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
         -- CRC-32, byte by byte and bit by bit
         list_reduce(list_transform(range(0, length(doc_id::VARCHAR)),
                                    lambda p: ascii(substr(doc_id::VARCHAR, p + 1, 1))::BIGINT),
                     lambda c, b: list_reduce(range(0, 8),
                       lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295) AS crc
  FROM documents),
l AS (
  SELECT *, sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-'
                          ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END, tail)) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor(crc, 4294967295) % 7 = 0
              THEN sha256(concat(head, strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), tail)) END AS other
  FROM d),
leaves AS (
  SELECT row, tree, doc_id, leaf, coalesce(other, leaf) AS seen,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM l),
nodes(tree, k, i, n, digest) AS (
  SELECT tree, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT tree, any_value(k) + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, i // 2),
subs AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops(k, i, n, digest) AS (
  SELECT 0, i, n, subroot FROM subs
  UNION ALL
  SELECT any_value(k) + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i))
  FROM tops WHERE n > 1 GROUP BY i // 2),
path(row, tree, k, i, proof, fold) AS (
  SELECT row, tree, 0, i, '', seen FROM leaves
  UNION ALL
  SELECT p.row, p.tree, p.k + 1, p.i // 2, p.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN p.i % 2 = 0 THEN p.fold || coalesce(s.digest, '') ELSE s.digest || p.fold END)
  FROM path p JOIN nodes o ON o.tree = p.tree AND o.k = p.k AND o.i = p.i AND o.n > 1
  LEFT JOIN nodes s ON s.tree = p.tree AND s.k = p.k AND s.i = xor(p.i, 1)),
ends AS (
  SELECT p.row, s.subroot, s.i, p.proof, p.fold FROM path p
  JOIN nodes o ON o.tree = p.tree AND o.k = p.k AND o.n = 1 JOIN subs s ON s.tree = p.tree),
climb(row, subroot, k, i, proof, fold) AS (
  SELECT row, subroot, 0, i, proof, fold FROM ends
  UNION ALL
  SELECT p.row, p.subroot, p.k + 1, p.i // 2, p.proof || coalesce(s.digest, ''),
         sha256(CASE WHEN p.i % 2 = 0 THEN p.fold || coalesce(s.digest, '') ELSE s.digest || p.fold END)
  FROM climb p JOIN tops o ON o.k = p.k AND o.i = p.i AND o.n > 1
  LEFT JOIN tops s ON s.k = p.k AND s.i = xor(p.i, 1))
SELECT e.doc_id, e.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256,
       c.fold AS folded_root, c.fold = t.digest AS verified
FROM climb c JOIN tops t ON t.k = c.k AND t.n = 1 JOIN leaves e USING (row)
"""

_OP13 = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
pieces AS (
  SELECT lang, [x for x in string_split_regex(p, '[\x20\x09]+') if x <> ''] AS ws
  FROM (SELECT lang, unnest(ps) AS p FROM t)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
        FROM pieces, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
w AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (
  SELECT lang, m, phrase, a, ws, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k + 1:m], ' ') AS q
  FROM (SELECT *, unnest(range(1, m)) AS k FROM w)),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n,
         (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase
                            ORDER BY 1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a), k) AS cut
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p
              JOIN f r ON r.lang = c.lang AND r.phrase = c.q
              JOIN total t ON t.lang = c.lang),
around AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + s - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS i
          FROM w, (SELECT unnest(range(2, 5)) AS s) WHERE s < m))
  GROUP BY ALL),
alone AS (
  SELECT s.* FROM scored s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE cut = 1 AND coalesce(100 * longer < 100 * a, TRUE)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM alone)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op1_quality_rules": _OP1, "op2_url_filters": _OP2, "op9_substring_dedup": _OP9,
           "op10_chat_formatting": _OP10, "op11_merkle_manifest": _OP11,
           "op13_phrase_collocation_mining": _OP13}
