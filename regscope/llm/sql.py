"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * (i // 8) + 1, 2))::BIGINT"
    bits = f"[({byte} >> (i % 8)::BIGINT) & 1 for i in range(8 * octet_length(encode({text})))]"
    return (f"xor(list_reduce([4294967295::BIGINT] || {bits}, "
            f"lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)")


SQL = {
    "op2_warc": r"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed)
SELECT page_id, payload_bytes,
       translate(to_base(('0x' || substr(hex, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 11, 10))::BIGINT, 32, 8)
              || to_base(('0x' || substr(hex, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(hex, 31, 10))::BIGINT, 32, 8),
              '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN first END AS refers_to
FROM firsts""",
    "op8_mix_plan": r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM totals),
levels AS (
  SELECT *, cap / w AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM chosen)), cap) AS target FROM levels),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) AS copies,
       (floor(rate)::BIGINT + (draw < rate - floor(rate))::BIGINT) * size AS taken
FROM rated""",
    "op9_nearest": r"""
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
  FROM documents),
hashed AS (SELECT w, count(*) AS c, {_crc32("d || ':' || w")} AS h FROM runs WHERE length(w) >= 7 GROUP BY d, w),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut SEMI JOIN words ON words.word = cut.rest
  UNION SELECT rest, word FROM cut SEMI JOIN words ON words.word = cut.rest),
ranked AS (
  SELECT near.word, other, words.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS place
  FROM near JOIN words ON words.word = near.other),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
chain AS (
  SELECT word, word AS at, form AS further FROM formed
  UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = chain.further)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain ON chain.word = f.word AND chain.further IS NULL""",
    "op12_periodic_runs": rf"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id, {_crc32("coalesce(doc_id::VARCHAR, '')")} AS h,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, len(w)::BIGINT AS n FROM documents),
placed AS (
  SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 1 + (n - CASE WHEN n > 0 THEN (h // 10) % n END) // (3 + (h // 10) % 8) AS p FROM split),
texts AS (
  SELECT row, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0 THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] for i in range(n)] ELSE w END AS w
  FROM placed),
words AS (SELECT row, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
grams AS (  -- every run holds 16 words that are the same a period later
  SELECT row, i, string_agg(word, ' ') OVER span AS gram, count(*) OVER span AS c
  FROM words WINDOW span AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
repeats AS (
  SELECT a.row, a.i, b.i - a.i AS q
  FROM (SELECT row, i, hash(gram) AS g FROM grams WHERE c = 16) a JOIN (SELECT row, i, hash(gram) AS g FROM grams WHERE c = 16) b
    ON a.row = b.row AND a.g = b.g AND a.i < b.i),
islands AS (
  SELECT row, q, min(i) AS start, count(*) + 15 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM repeats) GROUP BY row, q, island),
runs AS (  -- a multiple of the smallest period has the same stretch
  SELECT row, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM islands GROUP BY row, start, length
  HAVING length >= greatest(24, 3 * min(q))),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length / period DESC, start, period) AS place FROM runs) WHERE place = 1),
listed AS (
  SELECT row, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row = words.row AND i >= r.start + r.period AND i < r.start + r.length) GROUP BY row)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start, b.length, b.period, b.length * 1000 // b.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN best b USING (row) LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)""",
    "op13_exact_top_k": r"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]), 0)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
