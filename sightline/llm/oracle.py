"""SQL (DuckDB) for the rows of those queries that SQL can express."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')"

OP3 = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'),
                lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 1 THEN ws WHEN len(ws) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS held
  FROM docs),
items AS (SELECT rid, doc_id, unnest(held) AS item FROM sets),
sizes AS (SELECT rid, doc_id, len(held) AS n FROM sets),
pairs AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS n_both FROM items a JOIN items b ON a.item = b.item AND a.rid < b.rid GROUP BY 1, 2),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM pairs JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least ON a = doc_id
"""

OP6 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
places AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
windows AS (SELECT rid, p, ws[p] || ' ' || ws[p+1] || ' ' || ws[p+2] || ' ' || ws[p+3] || ' ' || ws[p+4] AS g FROM places),
twice AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
inside AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS steps(k) GROUP BY rid),
counts AS (
  SELECT rid, doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN dups USING (rid) LEFT JOIN inside USING (rid)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
      OR word_chars > 20 * n_words AS mild_failed
  FROM counts),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed OR mild_failed) AS bad FROM judged WHERE source IS NOT NULL GROUP BY source),
fit AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM hosts),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM fit),
rates AS (SELECT source, n, m, s, (bad + m * s) / (n + s) AS rate FROM hosts, prior),
verdicts AS (SELECT source, rate + sqrt(rate * (1 - rate) / (n + s + 1)) >= m AS rejected FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(rejected, true) AND mild_failed) AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""

_KEY = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?"
)
_SECRETS = {
    "assign": (_KEY + "([A-Za-z0-9+/_.=-]+)", f"length(regexp_replace(m, '^{_KEY}', '')) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"),
    "hex": ("[0-9a-f]+", "length(m) >= 24"),
    "identifier": (
        "([Uu]ser(_?[Nn]ame|_?[Ii][Dd])?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9_.@-]{3,}", "true"),
    "secret": ("[A-Za-z0-9+/_-]+", "length(m) >= 20 AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"),
    "endpoint": ("(https?|s?ftp|ssh|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D\"''<>]+", "true"),
}
_FOUND = "\nUNION ALL\n".join(
    f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s AS "start", s + length(m) AS "end" FROM (
    SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS s FROM (
      SELECT rid, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM d))) WHERE {good}"""
    for rank, (kind, (pattern, good)) in enumerate(_SECRETS.items())
)


def _within(kinds: str, reach: int) -> str:
    return (
        f"(coalesce(max(\"end\") FILTER (kind IN ({kinds})) OVER (PARTITION BY rid ORDER BY \"start\" RANGE BETWEEN UNBOUNDED PRECEDING"
        f" AND CURRENT ROW) > \"start\" - {reach}, false) OR coalesce(min(\"start\") FILTER (kind IN ({kinds})) OVER (PARTITION BY rid"
        f" ORDER BY \"start\" RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < \"end\" + {reach}, false))"
    )


OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
marked AS (SELECT *, {_within("'assign', 'access', 'hex'", 0)} AS overlapped FROM found),
clear AS (SELECT rid, rank, kind, "start", "end" FROM marked WHERE kind IN ('assign', 'access', 'hex') OR NOT overlapped),
near AS (
  SELECT *, {_within("'access', 'identifier'", 200)} AS near_identifier, {_within("'assign', 'hex', 'secret'", 200)} AS near_secret,
    {_within("'endpoint'", 200)} AS near_endpoint FROM clear),
spans AS (
  SELECT * FROM near WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'identifier' AND near_secret)
    OR (kind = 'secret' AND (near_identifier OR near_endpoint)) OR (kind = 'endpoint' AND near_identifier AND near_secret)),
listed AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || "start"::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY "start", rank) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (rid)
"""

OP10 = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS ws FROM documents),
places AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
windows AS (SELECT rid, doc_id, p, md5(array_to_string(ws[p:p+49], ' ')) AS g FROM places),
late AS (SELECT rid, p FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT rid, p + k AS p FROM late, range(50) AS steps(k)),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""

_PLAIN = (
    "string_split_regex(regexp_replace(translate(lower(coalesce(text, '')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), "
    f"'^{GAP}|{GAP}$', '', 'g'), '{GAP}')"
)
_MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6))


def _seeds(table: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {n} AS mask, p, {' || chr(10) || '.join(f'ws[p + {k}]' for k in mask)} AS seed FROM "
        f"(SELECT {key}, ws, unnest(range(1, len(ws) - {mask[-1] - 1})) AS p FROM {table} WHERE len(ws) > {mask[-1]})"
        for n, mask in enumerate(_MASKS)
    )


OP4 = f"""
WITH d AS (SELECT doc_id, text, {_PLAIN} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT DISTINCT item_id, {_PLAIN} AS ws FROM benchmark),
found AS (
  SELECT DISTINCT x.doc_id, y.item_id, x.p - y.p AS "start"
  FROM ({_seeds("d", "doc_id")}) x JOIN ({_seeds("b", "item_id")}) y ON x.mask = y.mask AND x.seed = y.seed),
agree AS (
  SELECT doc_id, item_id, "start", least(20, len(b.ws)) AS n_compared,
    list_transform(range(greatest(-"start", 0), least(len(b.ws), len(d.ws) - "start")),
      lambda i: CASE WHEN b.ws[i + 1] = d.ws[i + 1 + "start"] THEN 1 ELSE 0 END) AS same
  FROM found JOIN d USING (doc_id) JOIN b USING (item_id)),
best AS (
  SELECT doc_id, item_id, "start", n_compared, CASE WHEN len(same) < n_compared THEN 0 ELSE
    list_max(list_transform(range(1, len(same) - n_compared + 2), lambda k: list_sum(same[k:k + n_compared - 1]))) END AS n_agreeing
  FROM agree)
SELECT doc_id, item_id, "start", n_agreeing::INT AS n_agreeing, n_compared::INT AS n_compared FROM best WHERE 100 * n_agreeing >= 80 * n_compared
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
phrases AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM places, (VALUES (1), (2), (3)) AS sizes(size)
  WHERE i + size - 1 <= len(ws)),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS a FROM phrases GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, a FROM f WHERE size > 1 AND a >= 10),
inner_parts AS (
  SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a AS longer FROM candidates WHERE size = 3),
kept AS (
  SELECT * FROM candidates ANTI JOIN (SELECT i.lang, i.phrase FROM inner_parts i JOIN candidates c USING (lang, phrase)
    WHERE 100 * i.longer >= 50 * c.a) USING (lang, phrase)),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
