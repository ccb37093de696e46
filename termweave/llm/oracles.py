"""DuckDB SQL for the queries that SQL can express."""

from termweave.llm import chat_windows, fair_mix, host_rules

WORD = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {}

ORACLES["op7_host_rules"] = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
spans AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM base WHERE len(w) >= 8),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS run FROM spans),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs),
places AS (SELECT DISTINCT doc_id, i + unnest(range(8)) AS p FROM again WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT b.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < {host_rules.MIN_WORDS} OR 100 * n_repeat_words > {host_rules.REPEAT_PERCENT} * n_words AS base_failed FROM m),
marked AS (
  SELECT *, base_failed OR n_symbols > 0.3 * greatest(n_words, 1) OR word_chars > 14 * greatest(n_words, 1)
            OR word_chars < 2 * greatest(n_words, 1) OR 10 * n_dup_lines > 3 * n_words AS failed FROM judged),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM marked GROUP BY source),
mean AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS m, sum(n) AS n FROM hosts),
spread AS (
  SELECT any_value(mean.m) AS m, greatest((sum(h.n * (h.f / h.n - mean.m) ** 2) - sum(mean.m * (1 - mean.m)))
         / greatest(any_value(mean.n), 1), 1e-6) AS e FROM hosts h, mean),
prior AS (SELECT m, least(greatest(m * (1 - m) / e - 1, 1), 1000) AS k FROM spread)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND (f + m * k) / (n + k) <= {host_rules.HOST_LIMIT} AS kept
FROM marked JOIN hosts h ON marked.source IS NOT DISTINCT FROM h.source, prior"""

ORACLES["op8_chat_windows"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         len(regexp_extract_all(text, {WORD})) + 1 AS tokens FROM rows),
placed AS (
  SELECT *, i = 1 AND role = 'system' AS sys,
         coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         greatest({chat_windows.BUDGET} - coalesce(first_value(CASE WHEN role = 'system' THEN tokens END)
                  OVER (PARTITION BY conv_id ORDER BY i), 0), 2) AS room FROM numbered),
halved AS (
  SELECT *, floor(room * {chat_windows.HISTORY_SHARE}) AS history,
         greatest(floor((room - floor(room * {chat_windows.HISTORY_SHARE})) / 2), 1) AS half FROM placed),
spanned AS (SELECT *, floor(before / half) AS span, tokens > half AS long FROM halved),
opened AS (
  SELECT *, (i = 1 OR lag(sys) OVER c OR lag(long) OVER c OR long OR lag(span) OVER c <> span)
            AND (NOT sys OR lead(i) OVER c IS NULL) AS opens FROM spanned WINDOW c AS (PARTITION BY conv_id ORDER BY i)),
windowed AS (
  SELECT *, greatest(sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY i) - 1, 0) AS win FROM opened),
shown AS (
  SELECT *, max(win) OVER (PARTITION BY conv_id) AS last,
    CASE WHEN lead(opens, 1) OVER c AND NOT sys AND tokens <= lead(history, 1) OVER c THEN lead(win, 1) OVER c END AS a,
    CASE WHEN lead(opens, 2) OVER c AND NOT sys AND tokens + lead(tokens, 1) OVER c <= lead(history, 2) OVER c
         THEN lead(win, 2) OVER c END AS b
  FROM windowed WINDOW c AS (PARTITION BY conv_id ORDER BY i)),
counted AS (
  SELECT *, CASE WHEN sys THEN last
                 ELSE (a IS NOT NULL AND a <> win)::INT + (b IS NOT NULL AND b <> win AND b IS DISTINCT FROM a)::INT END AS again,
         length(role) + len(regexp_extract_all(role, '<\\*\|'))
         + length(text) + len(regexp_extract_all(text, '<\\*\|')) + {len(chat_windows.SEP + chat_windows.END)} AS chars
  FROM shown)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum((1 + again) * (chars + {len(chat_windows.START)}))::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id"""

ORACLES["op9_ngram_join"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
                        GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b WHERE 100 * c >= 85 * (s.n + t.n - c)),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

ORACLES["op10_fair_mix"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size, md5('0|' || doc_id) AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, {fair_mix.MAX_REPEATS}.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
caps AS (
  SELECT *, cap / w AS level, sum(cap) OVER c AS caps, sum(w) OVER c AS ws FROM s WINDOW c AS (ORDER BY cap / w, rank)),
levels AS (
  SELECT *, ((SELECT sum(n) FROM s)::DOUBLE - (caps - cap)) / ((SELECT sum(w) FROM s) - (ws - w)) AS water FROM caps),
water AS (SELECT arg_min(water, (level, rank)) AS water FROM levels WHERE level > water),
t AS (SELECT source, n, least(cap, w * coalesce((SELECT water FROM water), 1e300)) AS target FROM s),
q AS (
  SELECT d.*, n AS source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS upto,
         row_number() OVER (ORDER BY d.source NULLS LAST, key, doc_id, size) AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT r, k, size, (k * source_size + upto)::DOUBLE / target AS finish
  FROM (SELECT *, unnest(range(least(ceil(target / source_size), {fair_mix.MAX_REPEATS})::BIGINT)) AS k FROM q WHERE size > 0 AND target > 0)),
mixed AS (SELECT r, sum(size) OVER (ORDER BY finish, r, k) AS total FROM copies),
times AS (SELECT r, count(*) AS n FROM mixed WHERE total <= (SELECT sum(n) FROM s) GROUP BY r)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken FROM q LEFT JOIN times USING (r)"""

ORACLES["op12_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES["op13_prefix_trie"] = r"""
WITH RECURSIVE bits(n, v, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM own), tab),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
seqs AS (
  SELECT c.conv_id, coalesce(s, []) AS s
  FROM convs c LEFT JOIN (
    SELECT conv_id, list({'r': role, 't': text} ORDER BY part, i) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)),
members AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS depth, s FROM seqs),
keyed AS (SELECT conv_id, n, depth, s[1:depth] AS p FROM members),
nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[-1].t) END AS saved
  FROM keyed GROUP BY depth, p),
named AS (SELECT *, row_number() OVER () AS id FROM nodes),
linked AS (SELECT a.*, b.id AS parent, b.conv_id AS parent_conv_id FROM named a LEFT JOIN named b ON b.depth = a.depth - 1 AND b.p = a.p[1:a.depth - 1]),
kids AS (SELECT parent AS id, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
flat AS (SELECT l.id, l.parent, l.saved, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids k USING (id)),
up(top, id) AS (SELECT id, id FROM flat UNION ALL SELECT f.parent, u.id FROM up u JOIN flat f ON f.id = u.top WHERE f.parent IS NOT NULL),
sums AS (
  SELECT u.top AS id, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens
  FROM up u JOIN flat f ON f.id = u.id GROUP BY u.top)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, f.n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
FROM linked l JOIN flat f USING (id) JOIN sums s USING (id)"""
