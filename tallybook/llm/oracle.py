"""SQL that recomputes the queries SQL can express, by plain joins instead of the operators' methods."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT doc_id, coalesce({_WORDS}, []) AS w, row_number() OVER () AS r FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM phrases
), grams AS (
  SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)
), found AS (
  SELECT g.r, g.k, g.n, p.item FROM grams g JOIN phrases p ON g.phrase = p.phrase AND g.n = p.n
), hit AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS line FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(line, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

LINE_DEDUP = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, text, k, array_to_string(list_slice(lines, k, k + 2), chr(10)) AS key
  FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS k FROM d WHERE len(lines) >= 3)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, text, k) AS nth
  FROM windows WHERE replace(replace(key, chr(10), ''), ' ', '') <> ''
), covered AS (
  SELECT DISTINCT doc_id, text, unnest([k, k + 1, k + 2]) AS line FROM ranked WHERE nth > 1
), cut AS (
  SELECT doc_id, text, list(line) AS gone FROM covered GROUP BY ALL
)
SELECT o.doc_id,
       CASE WHEN c.gone IS NULL THEN o.text ELSE coalesce(array_to_string(
         list_transform(list_filter(range(1, len(string_split(o.text, chr(10))) + 1), lambda x: NOT list_contains(c.gone, x)),
                        lambda x: string_split(o.text, chr(10))[x]), chr(10)), '') END AS text,
       CASE WHEN o.text IS NULL THEN 0 ELSE len(string_split(o.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(c.gone), 0)::BIGINT AS n_removed
FROM documents o LEFT JOIN cut c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.text = c.text
"""

JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN hash(w) ELSE hash(w[k], w[k + 1], w[k + 2]) END AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM w WHERE len(w) > 0)
), each AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.other
), least_of AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT w.doc_id, (SELECT count(*) FROM sets WHERE sets.doc_id = w.doc_id)::BIGINT AS n_shingles, component_id
FROM w JOIN least_of USING (doc_id)
"""

#: CRC-32 by its table: bytes come as hexadecimal pairs of the UTF-8 text.
_CRC_TABLE = """
SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS tbl
"""


def _crc32(text: str, table: str = "tbl") -> str:
    return f"""xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
      list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])))"""


PERIODIC_RUNS = f"""
WITH crc AS ({_CRC_TABLE}), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w, len(w) AS n,
         {_crc32("doc_id::VARCHAR")} AS h
  FROM documents, crc
), planted AS (
  SELECT *, (h // 10) AS g, h % 10 = 0 AND n > 0 AS hit FROM d
), placed AS (
  SELECT *, CASE WHEN hit THEN g % n END AS a FROM planted
), units AS (
  SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS u FROM placed
), w AS (
  SELECT r, n, i, w[CASE WHEN hit AND i >= a THEN a + (i - a) % u ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM units)
), pairs AS (
  SELECT x.r, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT r, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY r, p, island
), runs AS (
  SELECT r, start, length, min(p) AS period FROM stretches
  WHERE length >= greatest(6, 4 * p) GROUP BY r, start, length
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), lines AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS line
  FROM runs GROUP BY r
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) = 1
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (r) LEFT JOIN longest USING (r) LEFT JOIN kept USING (r)
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h FROM runs, crc
), spoiled AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM holes x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word, x.n FROM holes x JOIN v ON x.rest = v.word
), counted AS (
  SELECT word, count(*) AS n_near FROM near GROUP BY word
), best AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(other)) = 1
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN best.n >= 2 * v.n THEN other END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n
  FROM v LEFT JOIN counted USING (word) LEFT JOIN best USING (word)
), reached AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT reached.word, forms.word, forms.form FROM reached JOIN forms ON forms.word = reached.next
)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN reached r ON r.word = f.word AND r.next IS NULL
"""

SQL = {
    "op1_top_k_search": TOP_K,
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op7_line_dedup": LINE_DEDUP,
    "op9_ngram_jaccard_join": JACCARD,
    "op12_periodic_runs": PERIODIC_RUNS,
    "op13_spelling_variants": SPELLING_VARIANTS,
}
