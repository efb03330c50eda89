"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from . import chat, licenses, mixing
from .quality import MARKS, RULES, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = []
    for r in RULES:
        tests += [f"{r.measure} >= {float(r.low)!r}"] if r.low is not None else []
        tests += [f"{r.measure} <= {float(r.high)!r}"] if r.high is not None else []

    def share(a: str, b: str) -> str:
        return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0e0 END"

    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 7, 0))) AS i FROM d)),
twice AS (SELECT doc_id, s FROM windows GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (doc_id, s)) GROUP BY doc_id),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_bangs,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
    len(list_filter(w, lambda x: lower(rtrim(x, '{MARKS}')) IN ({stop}))) AS n_stop_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_adjacent,
    len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦·][\x20\x09-\x0D]'))) AS n_bullet_lines
  FROM d LEFT JOIN covered USING (doc_id)),
m AS (
  SELECT doc_id, {share('n_repeat_words', 'n_words')} AS repeat_ratio, {share('word_chars', 'n_words')} AS mean_word_chars,
    {share('n_adjacent', 'n_words')} AS adjacent_ratio, {share('n_symbols', 'n_words')} AS symbol_ratio, {share('n_bangs', 'n_words')} AS bang_ratio,
    {share('n_upper', 'word_chars')} AS upper_ratio, {share('n_alpha_words', 'n_words')} AS alpha_word_ratio,
    {share('n_stop_words', 'n_words')} AS stop_word_ratio, {share('n_dup_lines', 'n_lines')} AS dup_line_ratio,
    {share('n_ellipsis_lines', 'n_lines')} AS ellipsis_line_ratio, {share('n_bullet_lines', 'n_lines')} AS bullet_line_ratio
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(tests)} AS kept
FROM c JOIN m USING (doc_id)"""


def mix_sources() -> str:
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    marks = " + ".join(f"(strlen(t) - strlen(replace(t, '{c}', '')))" for c in "#*$%&|<>!")
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(t))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)
    / greatest(0.1e0, 1e0 - CASE WHEN strlen(t) > 0 THEN 10e0 * ({marks}) / strlen(t) ELSE 0e0 END) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, {weights}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w,
    {mixing.MOST} * source_size AS cap FROM s),
a AS (
  SELECT *, {mixing.SHARE}e0 * (sum(source_size) OVER ()) AS total, sum(w) OVER () AS ws,
    coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS ahead
  FROM w WINDOW before AS (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap <= w * ((total - caps) / (ws - ahead)) AS capped FROM a),
g AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    w * ((total - coalesce(sum(cap) FILTER (capped) OVER (), 0)) / (ws - coalesce(sum(w) FILTER (capped) OVER (), 0))) END AS target
  FROM f),
p AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, passes + CASE WHEN before + size / 2e0 < target - passes * source_size THEN 1 ELSE 0 END AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c"""


def chat_format(control: str) -> str:
    esc = r"regexp_replace({}, '<(\|+)', '<|\1', 'g')"
    role = esc.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{control}'), (-1, 1, 'assistant', '{control}')),
t AS (
  SELECT *, row_number() OVER o - 1 AS n, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.MARK_TOKENS} AS tokens,
    {len(chat.START) + 1 + len(chat.STOP)} + length({role}) + length({esc.format('text')}) AS chars
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
w AS (SELECT *, floor((before + tokens - 1) / {chat.FRESH}) AS w FROM b),
opens AS (SELECT conv_id, w, min(n) AS o, min(before) AS f FROM w GROUP BY conv_id, w),
context AS (
  SELECT t.conv_id, t.chars FROM w t JOIN opens USING (conv_id) WHERE t.n = 0 AND t.role = 'system' AND opens.o > 0
  UNION ALL
  SELECT t.conv_id, t.chars FROM w t JOIN opens USING (conv_id)
  WHERE t.n BETWEEN opens.o - {chat.HISTORY_TURNS} AND opens.o - 1 AND opens.f - t.before <= {chat.HISTORY_TOKENS}
    AND NOT (t.n = 0 AND t.role = 'system')),
extra AS (SELECT conv_id, sum(chars) AS chars FROM context GROUP BY conv_id),
own AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS learnt, sum(chars) AS chars
  FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
  CAST(own.chars + coalesce(extra.chars, 0) AS BIGINT) AS formatted_chars
FROM own LEFT JOIN extra USING (conv_id)"""


def license_scan() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    rows, tell = [], []
    for k, ((label, text), sets) in enumerate(zip(licenses.TEMPLATES, licenses.telling(), strict=True)):
        words = sorted(set(text.split()))
        rows.append(f"({k}, '{label}', {words}, {math.ceil(licenses.CONTAINS * len(words))}, {len(words)})")
        tell += [f"({k}, {x})" for x in sets]
    step = licenses.BLOCK // 2
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(p, label, k) AS (VALUES {phrases}),
starts AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
hits AS (SELECT doc_id, label, i FROM starts JOIN phrases ON array_to_string(w[i + 1:i + k], ' ') = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM hits GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(w[s + 1:s + {licenses.BLOCK}]) AS w
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 1 - {step}, 0) + 1, {step})) AS s FROM d)),
templates(k, label, words, need, n) AS (VALUES {", ".join(rows)}),
tell(k, one_of) AS (VALUES {", ".join(tell)}),
near AS (
  SELECT * FROM (SELECT doc_id, k, w, label, need, n, len(list_intersect(w, words)) AS common FROM blocks, templates)
  WHERE common >= need),
more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(common AS DOUBLE) / n) AS share
  FROM near ANTI JOIN tell ON near.k = tell.k AND NOT list_has_any(near.w, tell.one_of) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN base.labels IS NOT NULL THEN 1e0 ELSE coalesce(share, 0e0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


def exact_dedup() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH told AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM told"""


def collocations(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cuts = " UNION ALL ".join(f"SELECT *, {k} AS k FROM often WHERE len(words) > {k}" for k in range(1, longest))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
langs AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
sizes AS (SELECT unnest(range(1, {longest + 1})) AS size),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE len(w) >= size),
often AS (
  SELECT lang, w[i:i + size - 1] AS words, count(*) AS a FROM places GROUP BY lang, words HAVING count(*) >= {least}),
cuts AS ({cuts}),
scored AS (
  SELECT c.lang, c.words, c.a, k, f.a AS l, g.a AS r, n,
    CAST((1000::HUGEINT * c.a * n) // (f.a::HUGEINT * g.a) AS BIGINT) AS score
  FROM cuts c JOIN often f ON f.lang = c.lang AND f.words = c.words[1:k]
    JOIN often g ON g.lang = c.lang AND g.words = c.words[k + 1:] JOIN langs ON langs.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
longer AS (
  SELECT lang, a, words[1:len(words) - 1] AS words FROM often WHERE len(words) > 2
  UNION SELECT lang, a, words[2:] FROM often WHERE len(words) > 2),
free AS (SELECT *, array_to_string(words, ' ') AS phrase FROM best b ANTI JOIN longer USING (lang, words, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY rank <= {top}"""
