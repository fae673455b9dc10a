"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"

OP2 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, 2 * source_size AS cap,
         CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
r AS (
  SELECT *, sum(cap) OVER (ORDER BY ratio, place) AS caps,
         sum(weight) OVER (ORDER BY ratio, place) AS weights,
         sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weights
  FROM f),
l AS (
  SELECT *, (1.5 * CAST(all_words AS DOUBLE) - CAST(caps - cap AS DOUBLE))
            / CAST(all_weights - weights + weight AS DOUBLE) AS level
  FROM r),
top AS (
  SELECT level AS lambda_ FROM l WHERE level * weight <= cap ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT source, source_size,
         coalesce(least(lambda_ * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM l LEFT JOIN top ON true),
u AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(floor(t.target) AS BIGINT) // greatest(t.source_size, 1) AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - start, 0), size)
            AS BIGINT) AS taken
FROM u
"""

_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower_words(column: str) -> str:
    text = _LOWER.format(f"coalesce({column}, '')")
    return f"list_filter(string_split_regex({text}, '{_ALNUM}'), lambda w: w <> '')"


OP3 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_lower_words('text')} AS w FROM benchmark),
iw AS (
  SELECT item, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p
  FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM iw),
lengths AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, row_number() OVER () AS r, {_lower_words('text')} AS w FROM documents),
dw AS (
  SELECT r, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS p FROM d CROSS JOIN lengths),
hits AS (
  SELECT dw.r, dw.p, dw.n, win.item
  FROM dw JOIN win ON dw.n = win.n AND win.words = array_to_string(dw.w[dw.p : dw.p + dw.n - 1], ' ')),
places AS (
  SELECT r, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits))
  GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP4 = """
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':'
                               || coalesce(md5(text), '')), 15) AS BIGINT) AS h
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY h) - 1 AS copy FROM d),
tried AS (SELECT *, unnest(range(0, 61)) AS depth FROM n),
sized AS (
  SELECT *, h >> (60 - depth) AS prefix,
         sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS total
  FROM tried),
best AS (
  SELECT doc_id, h, copy, any_value(n_bytes) AS n_bytes,
         min(depth) FILTER (WHERE total <= 67108864) AS depth
  FROM sized GROUP BY doc_id, h, copy)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
  'b' || CASE WHEN depth = 0 THEN ''
    ELSE left(lpad(CAST(CAST(h AS BIT) AS VARCHAR)[5:], 60, '0'), coalesce(depth, 60)) END
  || CASE WHEN depth IS NULL
     THEN '-' || CAST(copy // greatest(67108864 // greatest(n_bytes, 1), 1) AS VARCHAR)
     ELSE '' END AS shard
FROM best
"""

OP7 = f"""
WITH p AS (
  SELECT page_id,
    {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, p, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule,
         arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""

_RATES = ("symbol_rate", "line_rate", "repeat_rate", "long_rate")
_EPSILON = (0.02, 0.02, 0.02, 0.1)
# Of repeated lines and words only the documents that have some.
_VALUES = [f"CASE WHEN {r} > 0 THEN {r} END" if r in ("line_rate", "repeat_rate") else r for r in _RATES]


def _quartile(value: str, share: float) -> str:
    listed = f"list_sort(list({value}) FILTER (WHERE ({value}) IS NOT NULL))"
    return f"{listed}[CAST(greatest(ceil(count({value}) * {share}), 1) AS INT)]"


def _fences(level: str, least: int) -> str:
    return ", ".join(
        f"CASE WHEN count({v}) >= {least} THEN {_quartile(v, 0.75)} + greatest("
        f"8.0 * ({_quartile(v, 0.75)} - {_quartile(v, 0.5)}), CAST({e} AS DOUBLE)) END AS {r}_{level}"
        for r, v, e in zip(_RATES, _VALUES, _EPSILON)
    )


def _within(rate: str) -> str:
    language = f"CASE WHEN {rate}_l IS NULL THEN {rate}_a ELSE least({rate}_l, 1.5 * {rate}_a) END"
    fence = f"CASE WHEN {rate}_s IS NULL THEN {language} ELSE least({rate}_s, 1.5 * ({language})) END"
    return f"coalesce({rate} <= {fence}, true)"


OP10 = f"""
WITH d AS (
  SELECT doc_id, lang, source, row_number() OVER () AS r, coalesce(text, '') AS t, {_WORDS} AS w
  FROM documents),
x AS (
  SELECT *, list_filter(string_split(t, chr(10)),
                        lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM d),
tri AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM x)),
rep AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q
        FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM tri) WHERE k > 1)
  GROUP BY r),
c AS (
  SELECT x.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM x LEFT JOIN rep ON x.r = rep.r),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1) AS symbol_rate,
    n_dup_lines / greatest(n_lines, 1) AS line_rate,
    n_repeat_words / greatest(n_words, 1) AS repeat_rate,
    word_chars / greatest(n_words, 1) AS long_rate
  FROM c),
ok AS (SELECT * FROM m WHERE NOT base_failed),
by_source AS (SELECT lang, source, {_fences('s', 100)} FROM ok GROUP BY 1, 2),
by_lang AS (SELECT lang, {_fences('l', 100)} FROM ok GROUP BY 1),
by_all AS (SELECT {_fences('a', 1)} FROM ok)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(map(_within, _RATES))} AS kept
FROM m
LEFT JOIN by_source s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source
LEFT JOIN by_lang l ON m.lang IS NOT DISTINCT FROM l.lang
LEFT JOIN by_all ON true
"""

_PLAIN = f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_SPACE}'), lambda w: w <> '')"

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_PLAIN} AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[p : p + 3], ' ') || ' ' || least(len(w), 4) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least_ USING (r)
"""

def _crc32(value: str) -> str:
    """crc32 of a string by the table ``t`` of a joined row."""
    octets = (
        f"list_transform(range(octet_length(encode({value}))),"
        f" lambda i: CAST('0x' || substr(hex(encode({value})), 2 * i + 1, 2) AS BIGINT))"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}),"
        " lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"
    )


_CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key,
         unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run
  FROM documents),
hashed AS (SELECT run, {_crc32("key || ':' || run")} AS h FROM runs CROSS JOIN crc),
kept AS (
  SELECT CASE WHEN h % 31 = 0
              THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
              ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, count(*) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS k FROM words),
gaps AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM gaps a JOIN gaps b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, g.word, g.n FROM words w JOIN gaps g ON w.word = g.rest
  UNION SELECT g.word, w.word, w.n FROM words w JOIN gaps g ON w.word = g.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other,
         max(other_n) AS other_n
  FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN other_n >= 10 * w.n THEN other END AS form,
         CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL
  SELECT way.word, forms.word, forms.form FROM way JOIN forms ON forms.word = way.next)
SELECT word, forms.form, way.at AS root, n, n_near, form_n
FROM forms JOIN way USING (word) WHERE way.next IS NULL
"""


def _leaf(text: str) -> str:
    def part(value: str) -> str:
        value = f"CAST({value} AS VARCHAR)"
        return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"

    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS now
  FROM documents CROSS JOIN crc),
s AS (
  SELECT source, count(*) AS m, row_number() OVER (ORDER BY source IS NOT NULL, source) - 1 AS place
  FROM d GROUP BY source),
leaves AS (
  SELECT doc_id, leaf, now, place AS tree, m,
         row_number() OVER (PARTITION BY place ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS p
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
low AS (
  SELECT tree, 0 AS level, p, m, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, level + 1, p // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY p))
  FROM low WHERE m > 1 GROUP BY tree, level, p // 3, m),
subroots AS (SELECT tree, level, h FROM low WHERE m = 1),
top AS (
  SELECT 0 AS level, tree AS p, (SELECT count(*) FROM s) AS m, h FROM subroots
  UNION ALL
  SELECT level + 1, p // 3, (m + 2) // 3, sha256(string_agg(h, '' ORDER BY p))
  FROM top WHERE m > 1 GROUP BY level, p // 3, m),
nodes AS (
  SELECT tree, level, p, m, h FROM low WHERE m > 1
  UNION ALL SELECT -1, level, p, m, h FROM top WHERE m > 1),
runs AS (
  SELECT tree, level, p // 3 AS q, list(h ORDER BY p) AS hs FROM nodes GROUP BY tree, level, p // 3),
sides AS (
  SELECT n.tree, n.level, n.p,
         array_to_string(hs[1 : n.p % 3], '') AS before, array_to_string(hs[n.p % 3 + 2 :], '') AS after
  FROM nodes n JOIN runs r ON r.tree = n.tree AND r.level = n.level AND r.q = n.p // 3),
climb AS (
  SELECT l.tree AS own, l.p AS place, l.tree, 0 AS level, l.p, l.m, l.now AS h, '' AS proof FROM leaves l
  UNION ALL
  SELECT c.own, c.place,
         CASE WHEN c.m > 1 THEN c.tree ELSE -1 END,
         CASE WHEN c.m > 1 THEN c.level + 1 ELSE 0 END,
         CASE WHEN c.m > 1 THEN c.p // 3 ELSE c.tree END,
         CASE WHEN c.m > 1 THEN (c.m + 2) // 3 ELSE (SELECT count(*) FROM s) END,
         CASE WHEN c.m > 1 THEN sha256(before || c.h || after) ELSE c.h END,
         CASE WHEN c.m > 1 THEN c.proof || before || after ELSE c.proof END
  FROM climb c LEFT JOIN sides USING (tree, level, p)
  WHERE c.m > 1 OR c.tree >= 0),
ends AS (SELECT own, place, h, proof FROM climb WHERE tree = -1 AND m = 1),
root AS (SELECT h AS root FROM top WHERE m = 1)
SELECT l.doc_id, l.leaf, u.h AS subroot, root, sha256(e.proof) AS proof_sha256,
       e.h AS folded_root, e.h = root AS verified
FROM leaves l JOIN ends e ON e.own = l.tree AND e.place = l.p
JOIN subroots u ON u.tree = l.tree CROSS JOIN root
"""

OP13 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k,
         max(page_id) OVER (PARTITION BY html) AS last
  FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND k > 1 THEN last END AS refers_to
FROM r
"""


ORACLES = {
    "op2_mix_sources": OP2,
    "op3_decontaminate": OP3,
    "op4_shards": OP4,
    "op7_url_filter": OP7,
    "op8_jaccard_join": OP8,
    "op10_quality_rules": OP10,
    "op11_spelling_variants": OP11,
    "op12_merkle_proofs": OP12,
    "op13_warc_revisits": OP13,
}
