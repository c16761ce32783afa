"""SQL (of DuckDB) for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUFFIX_ARRAY_DEDUP = """
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text, encode(coalesce(text, '')) AS b FROM documents
), windows AS MATERIALIZED (
  SELECT r, i, md5_number(b[i + 1:i + 400]) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS i FROM docs WHERE octet_length(b) >= 400)
), hits AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), runs AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e FROM (
    SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits
  ) GROUP BY r, run
), gone AS (
  SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans, string_agg(s || ',' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY r
), pieces AS (
  SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS i, s AS j FROM runs
  UNION ALL SELECT r, max(e), octet_length(any_value(b)) FROM runs JOIN docs USING (r) GROUP BY r
), kept AS (
  SELECT r, sha256(unhex(coalesce(string_agg(h, '' ORDER BY i), ''))) AS sha,
    decode(unhex(coalesce(string_agg(regexp_extract(regexp_replace(h, '^(?:[89AB].)+', ''), '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})?$', 1), '' ORDER BY i), ''))) AS t
  FROM (SELECT r, i, hex(b[i + 1:j]) AS h FROM pieces JOIN docs USING (r) WHERE j > i) GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN n_removed IS NULL THEN sha256(b) ELSE coalesce(sha, sha256(''::BLOB)) END AS kept_sha256, coalesce(spans, '') AS spans,
  CASE WHEN n_removed IS NULL THEN text ELSE coalesce(kept.t, '') END AS kept_text
FROM docs LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

QUALITY_RULES = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)
), twice AS (
  SELECT r, v, unnest(list(i)) AS i FROM windows GROUP BY r, v HAVING count(*) > 1
), repeats AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) FROM twice) GROUP BY r
), lines AS MATERIALIZED (
  SELECT r, host, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS c,
    regexp_replace(trim(lower(line), ' '), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
  FROM (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM docs)
), held AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM lines WHERE c > 0 GROUP BY r
), frequent AS (
  SELECT host, norm FROM lines WHERE c > 0 GROUP BY host, norm HAVING count(DISTINCT r) > 5
), removed AS (
  SELECT r, sum(c) AS c FROM lines JOIN frequent USING (host, norm) WHERE c > 0 GROUP BY r
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(held.n - held.d, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.c, 0)::BIGINT AS removed_chars
  FROM docs LEFT JOIN held USING (r) LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT *, NOT base_failed AND NOT (word_chars - removed_chars < 0.5 * word_chars) AS kept FROM failed
"""

WARC = """
WITH pages_ AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place, max(page_id) OVER (PARTITION BY h) AS best FROM pages_
)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN best END AS refers_to
FROM placed
"""

EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS MATERIALIZED (
  SELECT r, vec_id, label, v FROM good
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(r, o) AS (
  SELECT r, r FROM usable UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.o = links.a
), lows AS (
  SELECT r, min(vec_id) AS low FROM reach JOIN (SELECT r AS o, vec_id FROM usable) USING (o) GROUP BY r
), counts AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(low, vec_id) AS kept
FROM good LEFT JOIN lows USING (r) LEFT JOIN counts USING (r)
"""

SUBSTRING_DEDUP = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), windows AS MATERIALIZED (
  SELECT r, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), hits AS (
  SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS MATERIALIZED (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hits
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM docs) ANTI JOIN gone USING (r, i) GROUP BY r
), removed AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(encode(coalesce(t, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

IMPORTANCE_RESAMPLING = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {ALNUM_WORDS} AS w FROM documents
), words AS MATERIALIZED (
  SELECT r, unnest(w) AS word FROM docs
), wanted AS MATERIALIZED (
  SELECT unnest({ALNUM_WORDS}) AS word FROM benchmark
), tables AS MATERIALIZED (
  SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
), buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 10000 AS b
  FROM (SELECT word FROM words UNION SELECT word FROM wanted), tables
), source AS (
  SELECT b, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY b
), target AS (
  SELECT b, count(*) AS t FROM wanted JOIN buckets USING (word) GROUP BY b
), gains AS MATERIALIZED (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source FULL JOIN target USING (b)
), weights AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (b) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), runs AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
), counts AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, w FROM candidates
), scored AS (
  SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
  JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE around IS NULL OR 100 * around < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""

DECONTAMINATION = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {ALNUM_WORDS} AS w FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, w, least(len(w), 10) AS k FROM (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0
), wanted AS MATERIALIZED (
  SELECT DISTINCT item, k, md5_number(array_to_string(w[i:i + k - 1], ' ')) AS h FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), places AS (
  SELECT r, i, k, md5_number(array_to_string(w[i:i + k - 1], ' ')) AS h
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k)
), hits AS MATERIALIZED (
  SELECT * FROM places SEMI JOIN wanted USING (k, h)
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits JOIN wanted USING (k, h)) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

SQL = {
    "op1_suffix_array_dedup": SUFFIX_ARRAY_DEDUP, "op5_quality_rules": QUALITY_RULES, "op7_warc": WARC,
    "op8_embedding_near_dedup": EMBEDDING_NEAR_DEDUP, "op10_substring_dedup": SUBSTRING_DEDUP, "op11_importance_resampling": IMPORTANCE_RESAMPLING,
    "op12_collocations": COLLOCATIONS, "op13_decontamination": DECONTAMINATION,
}
