"""DuckDB SQL for the operators that SQL can express, from their definitions."""

OP9 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
n AS (
  SELECT doc_id, text_sha256,
         max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256, doc_id) AS copy
  FROM d)
SELECT doc_id, keep_id, group_size,
       doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256
FROM n
"""

# CRC-32 over the bytes of the text, with the table of its polynomial built by its rule.
OP3 = """
WITH RECURSIVE t(i, step, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END
  FROM t WHERE step < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE step = 8),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                        lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
d AS (
  SELECT doc_id, size,
         xor(list_reduce(b, lambda c, x: xor(tab[xor(c % 256, x) + 1], c // 256), 4294967295::BIGINT),
             4294967295) AS text_crc32,
         coalesce(doc_id::VARCHAR, 'null') AS key
  FROM bytes, tab),
draws AS (
  SELECT key, s, ('0x' || substr(md5(key || ':' || s), 1, 13))::BIGINT AS u
  FROM (SELECT DISTINCT key FROM d), range(41) r(s)),
won AS (
  SELECT key, arg_max(s, u) FILTER (s < 40) AS shard, arg_max(s, u) AS grown_shard
  FROM draws GROUP BY key)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (
         PARTITION BY shard
         ORDER BY substr(md5(concat_ws(':', key, size, text_crc32)), 1, 3),
                  doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown_shard::INTEGER AS grown_shard
FROM d JOIN won USING (key)
"""

# Without redirects or canonical links in the pages, aliases are the urls of one normal form.
OP10 = r"""
WITH p AS (
  SELECT page_id, url, strpos(url, '://') > 0 AS ok,
         substr(url, strpos(url, '://') + 3) AS rest FROM pages),
q AS (
  SELECT page_id,
         CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         CASE WHEN ok THEN regexp_extract(url, '^[^#?]*\?([^#]*)', 1) END AS query
  FROM p),
n AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') AS bare,
         regexp_replace(path, '/+$', '') AS stem,
         array_to_string(list_filter(string_split(query, '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS kept
  FROM q),
own AS (
  SELECT page_id, host, path, bare, stem, kept, query IS NOT NULL AS ok, host AS h, path AS x FROM n
  UNION ALL
  SELECT NULL, NULL, NULL, bare, stem, kept, true, bare, stem FROM n WHERE query IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (h = 'example.net' OR h LIKE '%.example.net') AND starts_with(x, '/en/') THEN 'example.net/en/'
    WHEN (h = 'example.com' OR h LIKE '%.example.com') AND starts_with(x, '/de/') THEN 'example.com/de/'
    WHEN (h = 'org' OR h LIKE '%.org') AND starts_with(x, '/fr/') THEN 'org/fr/'
    WHEN (h = 'net' OR h LIKE '%.net') AND starts_with(x, '/') THEN 'net/' END AS rule
  FROM own),
said AS (
  SELECT bare, stem, kept,
         coalesce(bool_or(rule IN ('example.net/en/', 'org/fr/')), false) AS allowed,
         coalesce(bool_or(rule IN ('net/', 'example.com/de/')), false) AS blocked
  FROM ruled WHERE ok GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN r.rule IS NOT NULL THEN 'block'
            WHEN s.blocked AND NOT s.allowed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN said s
  ON r.ok AND r.bare = s.bare AND r.stem = s.stem AND r.kept = s.kept
WHERE r.host IS NOT NULL
"""

OP1 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS n,
         unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
                               lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS s
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lens WHERE len(w) >= n),
text AS (
  SELECT s.r, s.n, s.i, array_to_string(w.w[s.i:s.i + s.n - 1], ' ') AS s FROM spots s JOIN w USING (r)),
hit AS (SELECT t.r, t.n, t.i, win.item_id FROM text t JOIN win ON t.n = win.n AND t.s = win.s),
words AS (
  SELECT r, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (
  SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP5 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
         row_number() OVER (PARTITION BY h, page_id) AS copy FROM p),
f AS (SELECT *, page_id IS NOT DISTINCT FROM last AND copy = 1 AS first FROM g)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
         ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT first THEN last END AS refers_to
FROM f
"""


def _op12(k: int = 16, rounds: int = 3) -> str:
    """Centroid rounds, unrolled: ``a<r>`` assigns, ``c<r>`` averages."""
    parts = [
        """v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v AS m
  FROM v QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d * 1000 + c) AS c, min(d) AS d
  FROM (SELECT row, vec_id, v, c,
               list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d
        FROM v, c{r})
  GROUP BY row)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS (
  SELECT c, coalesce(n, m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS n FROM (
      SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i)
    GROUP BY c) USING (c))"""
            )
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance,
       sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(list_aggregate(m, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP12 = _op12()

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // l))))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term), total
  GROUP BY item_id, row, doc_id)
SELECT item_id,
       row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
