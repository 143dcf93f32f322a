"""DuckDB SQL with the rows of the queries of this subpackage, for small tables: plain definitions, no method."""

from __future__ import annotations

from lodestrata.llm import line_dedup

_CLOSURE = r"""
reach AS (
  SELECT DISTINCT a AS node, a AS low FROM links
  UNION
  SELECT links.a, reach.low FROM reach JOIN links ON links.b = reach.node
), least AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
"""

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|20'), 1, 3))::INT AS bucket
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS rest, (sum(weight) OVER f)::BIGINT AS weights
  FROM sources
  WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), clamps AS (
  SELECT *, 3 * source_size * weights <= weight * rest AS clamped FROM ordered
), free AS (
  SELECT rest AS r, weights AS w FROM clamps WHERE NOT clamped ORDER BY weights DESC LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE (weight * r)::DOUBLE / w END AS target
  FROM clamps LEFT JOIN free ON true
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), buckets AS (
  SELECT source, bucket, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) - sum(size) / 2 AS middle
  FROM sized GROUP BY source, bucket
), cuts AS (
  SELECT e.source, e.source_size, e.target, e.whole, max(CASE WHEN middle <= target - whole * source_size THEN bucket END) AS cut
  FROM buckets b JOIN epochs e ON b.source IS NOT DISTINCT FROM e.source GROUP BY ALL
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN bucket <= cut AND whole < 3 THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""

# Links (a, b) come in both directions.
OP1_SQL = rf"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), {_CLOSURE}, counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN least ON node = vec_id
"""

OP4_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS s
  FROM words
), kinds AS (SELECT s, min(doc_id) AS k, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT k, n, unnest(s) AS token FROM kinds),
common AS (
  SELECT a.k AS a, b.k AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.k <> b.k GROUP BY a.k, b.k
), links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)), {_CLOSURE}
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(least(kinds.k, low), doc_id) AS component_id
FROM sets LEFT JOIN kinds ON sets.s = kinds.s LEFT JOIN least ON node = kinds.k
"""

OP5_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, list_slice(w, s, s + 9) AS win
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT len(win) AS m FROM wins),
runs AS (
  SELECT doc_id, s, m, list_slice(w, s, s + m - 1) AS run
  FROM dw, lens, unnest(range(1, len(w) - m + 2)) AS t(s) WHERE len(w) >= m
), hits AS (
  SELECT doc_id, s, m, item_id FROM runs JOIN wins ON run = win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, m FROM hits), unnest(range(s, s + m)) AS t(p) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Two lines within k edits agree in one of k + 1 parts of the shorter, somewhere; that only saves comparisons.
OP7_SQL = rf"""
WITH lines AS (
  SELECT doc_id, no, trim(l, ' ' || chr(9) || chr(13)) AS line, l FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL)
), firsts AS (
  SELECT line, length(line) AS n, min({{'d': doc_id, 'no': no}}) AS place FROM lines WHERE length(line) >= {line_dedup.EXACT_CHARS} GROUP BY line
), near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON abs(a.n - b.n) <= {line_dedup.EDITS} AND a.place < b.place
  WHERE a.n >= {line_dedup.NEAR_CHARS} AND b.n >= {line_dedup.NEAR_CHARS}
    AND (contains(b.line, substr(a.line, 1, a.n // 3)) OR contains(b.line, substr(a.line, 1 + a.n // 3, a.n // 3)) OR contains(b.line, substr(a.line, 1 + 2 * (a.n // 3))))
    AND levenshtein(a.line, b.line) <= {line_dedup.EDITS}
), judged AS (
  SELECT doc_id, no, l, length(lines.line) >= {line_dedup.EXACT_CHARS} AND (near.line IS NOT NULL OR {{'d': doc_id, 'no': no}} > place) AS gone
  FROM lines LEFT JOIN firsts ON lines.line = firsts.line LEFT JOIN near ON lines.line = near.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(l, chr(10) ORDER BY no) FILTER (gone IS NOT TRUE) AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

# Bytes are pairs of hexadecimal digits.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
starts AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS piece FROM d, unnest(range(0, n - 49)) AS t(i)),
first AS (SELECT piece, min(doc_id) AS low FROM starts GROUP BY piece HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, i FROM starts JOIN first USING (piece) WHERE low < doc_id),
runs AS (
  SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
      SELECT *, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1))::INT AS new FROM hits))
  GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM runs
  UNION ALL SELECT runs.doc_id, max(hi), any_value(n) FROM runs JOIN d ON d.doc_id = runs.doc_id GROUP BY runs.doc_id
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _any_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_RULES = (
    ("assign", f"({_any_case('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("bearer", f"{_any_case('bearer')}\\x20+[A-Za-z0-9._~+/=-]{{20,}}", 0, 0),
    ("url", "[A-Za-z][A-Za-z0-9+.-]*://[^\\s:/@]{1,256}:[^\\s:/@]{1,256}@", 0, 0),
)
_SPANS = " UNION ALL ".join(
    f"""SELECT doc_id, {no} AS no, '{kind}' AS kind, (list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0))::BIGINT AS s,
  length(m[i]) AS n FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d),
  unnest(range(1, len(m) + 1)) AS u(i) WHERE length(v[i]) >= {least}"""
    for no, (kind, pattern, group, least) in enumerate(_RULES)
)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({_SPANS}),
listed AS (
  SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, no) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k)
), frequent AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT * FROM frequent WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, c, array_to_string(ws[:c], ' ') AS head, array_to_string(ws[c + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, h.a AS l, t.a AS r, 2000000::HUGEINT * cuts.a // (h.a + t.a) AS score, c
  FROM cuts JOIN frequent h ON h.lang = cuts.lang AND h.phrase = head JOIN frequent t ON t.lang = cuts.lang AND t.phrase = tail
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), parts AS (
  SELECT lang, array_to_string(ws[o : o + w - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - w + 2)) AS o FROM candidates, (SELECT unnest(range(2, 4)) AS w) WHERE w < k)
), longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY lang, phrase
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, encode(l.phrase)) AS rank
  FROM least l LEFT JOIN longer ON longer.lang = l.lang AND longer.phrase = l.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
