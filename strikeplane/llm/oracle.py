"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""WITH s AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3.0::DOUBLE AS cap FROM src),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, f.level * w), cap) AS target FROM l, f),
n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS k, length(bin(size)) AS m FROM s),
c AS (SELECT n.source, m, sum(size)::BIGINT AS words, any_value(target) AS target FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY n.source, m),
cl AS (SELECT *, (target - 3.0::DOUBLE * coalesce(sum(words) OVER o, 0)) / (sum(words * m) OVER (PARTITION BY source) - coalesce(sum(words * m) OVER o, 0)) AS level FROM c WINDOW o AS (PARTITION BY source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cc AS (SELECT source, arg_max(level, m) AS c FROM cl WHERE level * m <= 3.0::DOUBLE GROUP BY source),
e AS (SELECT cl.source, m, coalesce(least(3.0::DOUBLE, cc.c * m), 3.0::DOUBLE) AS e, words, target FROM cl LEFT JOIN cc ON cl.source IS NOT DISTINCT FROM cc.source),
el AS (SELECT *, target - sum(floor(e) * words) OVER (PARTITION BY source) AS words_left FROM e),
p AS (SELECT n.*, t.source_size, t.target, floor(el.e)::BIGINT AS whole, el.e - floor(el.e) AS frac, el.words_left, (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source LEFT JOIN el ON n.source IS NOT DISTINCT FROM el.source AND n.m = el.m AND n.size > 0),
b AS (SELECT *, CASE WHEN frac > 0 THEN coalesce(sum(CASE WHEN frac > 0 THEN size END) OVER (PARTITION BY source, frac > 0 ORDER BY (u / (1 - u)) / (frac / (1 - frac)), doc_id::VARCHAR || ':' || size || ':' || k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM p)
SELECT doc_id, size, source_size, target, (size * (coalesce(whole, 0) + CASE WHEN before + size / 2 <= words_left THEN 1 ELSE 0 END))::BIGINT AS taken FROM b"""

OP3 = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.rid <> q.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP5 = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
p AS (SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS letter,
  CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 7 + length(url_encode(role)) END + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 9 AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, regexp_full_match(string_agg(letter, '' ORDER BY turn, role, text), 's?(ua)*u?') AS valid FROM p GROUP BY conv_id"""


def _canonical(x: str) -> str:
    pattern = licenses.DROPPED_LINE.replace("'", "''")
    out = rf"' ' || replace(trim(regexp_replace(regexp_replace(lower({x}), '{pattern}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' '"
    for other, one in licenses.EQUIVALENT:
        out = f"replace({out}, ' {other.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
    return f"sha256(trim(replace({out}, '  ', ' ')))"


_KNOWN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in licenses.KNOWN)
OP7 = rf"""WITH known AS (SELECT {_canonical('t')} AS digest, min(i) AS license_id FROM (VALUES {_KNOWN}) k(i, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT rid, t, true AS whole FROM d UNION ALL SELECT rid, t, false FROM (SELECT rid, unnest(string_split(t, chr(10))) AS t FROM d) WHERE regexp_matches(t, '\p{{L}}')),
f AS (SELECT rid, min(license_id) FILTER (whole) AS license_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole) AS notices, count(*) FILTER (NOT whole) AS n FROM (SELECT rid, whole, {_canonical('t')} AS digest FROM u) JOIN known USING (digest) GROUP BY rid)
SELECT d.doc_id, f.license_id, coalesce(f.notices, '') AS notices, coalesce(f.n, 0)::BIGINT AS n_notices FROM d LEFT JOIN f USING (rid)"""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS m FROM d), g AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM t),
one AS (SELECT w, count(*) AS n FROM t GROUP BY w), own1 AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL), two AS (SELECT c, w, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL), own2 AS (SELECT doc_id, c, w, count(*) AS n FROM g WHERE c IS NOT NULL GROUP BY ALL),
tot AS (SELECT sum(n) AS words, count(*) AS v FROM one),
s AS (SELECT g.doc_id, ln(one.n - own1.n + 1) - ln(tot.words - m + tot.v + 1) AS low, two.n - own2.n AS pair, oc.n - ownc.n AS context, g.c FROM g JOIN one ON g.w = one.w JOIN own1 ON own1.doc_id = g.doc_id AND own1.w = g.w LEFT JOIN two ON two.c = g.c AND two.w = g.w LEFT JOIN own2 ON own2.doc_id = g.doc_id AND own2.c = g.c AND own2.w = g.w LEFT JOIN one oc ON oc.w = g.c LEFT JOIN own1 ownc ON ownc.doc_id = g.doc_id AND ownc.w = g.c, tot),
z AS (SELECT doc_id, sum(CASE WHEN c IS NULL THEN low WHEN pair > 0 THEN ln(pair) - ln(context) ELSE ln(0.4::DOUBLE) + low END) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(z.score, 0), 4) + 0.0::DOUBLE AS log_score FROM d LEFT JOIN z USING (doc_id)"""

OP11 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
o AS (SELECT conv_id, list({'key': key, 'words': words} ORDER BY turn NULLS FIRST, key) AS turns FROM k GROUP BY conv_id),
c AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295) % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, d, d = len(turns) AS ends, md5(array_to_string(list_transform(turns[1:d], lambda x: x.key), '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.key), '')) END AS parent, turns[d].words AS words
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(words), 0) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
q AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.node, sum(n.saved) AS saved, count(*) FILTER (q.n_children IS NULL) AS n_leaves FROM (SELECT DISTINCT u.node AS node, v.node AS below FROM m u JOIN m v ON u.conv_id = v.conv_id AND u.d <= v.d) a JOIN n ON n.node = a.below LEFT JOIN q ON q.parent = n.node GROUP BY a.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(q.n_children, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN n p ON p.node = n.parent LEFT JOIN q ON q.parent = n.node"""

OP12 = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS x FROM w),
n AS (SELECT min(rid) AS node, min(doc_id) AS least, x FROM d WHERE len(x) > 0 GROUP BY x),
e AS (SELECT node, len(x) AS n, unnest(x) AS g FROM n),
l AS (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node <> b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a, min(n.least) AS component FROM r JOIN n ON n.node = r.b GROUP BY r.a)
SELECT d.doc_id, len(d.x)::BIGINT AS n_shingles, CASE WHEN len(d.x) = 0 THEN d.doc_id ELSE c.component END AS component_id FROM d LEFT JOIN n ON n.x = d.x LEFT JOIN c ON c.a = n.node"""

OP13 = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_AZ}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(k)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS m FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.m IS NULL OR 100::HUGEINT * o.m < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def _op1(alpha: float = 0.05, delta: float = 0.05) -> str:
    n = len(quality.RULES)
    ladder = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, steps in quality.RULES.items() for i, c in enumerate(steps))
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    value = "CASE rule WHEN 'symbol_share' THEN symbol_share WHEN 'dup_line_share' THEN dup_line_share WHEN 'repeat_share' THEN repeat_share ELSE capital_share END"
    failed = f"coalesce((SELECT count(*) FROM chosen c WHERE c.lang IS NOT DISTINCT FROM j.lang AND {value} > c.cutoff), 0)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM win) WHERE k > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS n_ascii_letters FROM w LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {share('n_symbols', 'word_chars')} AS symbol_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share, {share('n_capitals', 'n_ascii_letters')} AS capital_share FROM m),
h AS (SELECT j.*, q.quality = 1 AS good FROM j JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) q USING (doc_id) WHERE NOT base_failed),
ladder AS (SELECT * FROM (VALUES {ladder}) l(rule, i, cutoff)),
k AS (SELECT lang, rule, i, cutoff, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad, count(*) FILTER (good AND {value} > cutoff) AS k, count(*) FILTER (NOT good AND {value} > cutoff) AS kb FROM h, ladder GROUP BY ALL),
p AS (SELECT *, n_good > 0 AND (CASE WHEN k >= n_good THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n_good + 1) - lgamma(x + 1) - lgamma(n_good - x + 1) + x * ln({alpha / n!r}::DOUBLE) + (n_good - x) * ln(1 - {alpha / n!r}::DOUBLE)))) END) <= {delta}::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) * {n}) AS fine FROM k),
g AS (SELECT *, min(fine::INT) OVER (PARTITION BY lang, rule ORDER BY i) AS so_far, kb / greatest(1, n_bad) - {quality.GOOD_WEIGHT}::DOUBLE * k / greatest(1, n_good) AS gain FROM p),
chosen AS (SELECT lang, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, i) AS r FROM g WHERE so_far = 1 AND gain > 0) WHERE r = 1),
f AS (SELECT *, {failed}::INT AS n_rules_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_ascii_letters, base_failed, NOT base_failed AND n_rules_failed = 0 AS kept, n_rules_failed FROM f"""


OP1 = _op1()
