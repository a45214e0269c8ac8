"""DuckDB SQL that checks the queries it can express."""

from __future__ import annotations

from weftline.llm.hosts import HOST_LIMIT, LEAST_LIMIT, LEAST_SPREAD, MOST_SPREAD, SPREADS
from weftline.llm.licenses import PHRASES, SHARE, TEMPLATES

HOST_RULES = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id
), rows AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated AS r USING (doc_id)
), judged AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM rows
), hosts AS (
  SELECT source, count(*)::DOUBLE AS docs, sum(base_failed::INT)::DOUBLE AS failures FROM judged GROUP BY source
), whole AS (
  SELECT sum(docs) AS n, sum(failures) / sum(docs) AS m, count(*) AS k,
         sum(failures * failures / docs) AS squares, sum(docs * docs) AS sizes FROM hosts
), moments AS (
  SELECT m, squares - n * m * m AS spread, m * (1 - m) AS noise, k,
         m * (1 - m) * (n - sizes / n - (k - 1)) AS room FROM whole
), prior AS (
  SELECT m, 1 / least(greatest(CASE WHEN room > 0 THEN (spread - noise * (k - 1)) / room ELSE {LEAST_SPREAD!r} END,
                               {LEAST_SPREAD!r}), {MOST_SPREAD!r}) - 1 AS weight FROM moments
), verdicts AS (
  SELECT source, (failures + m * weight) / (docs + weight) <= least(greatest({HOST_LIMIT!r}, (1 + m) / 2),
         greatest({LEAST_LIMIT!r}, m + {SPREADS} * sqrt(m * (1 - m) / (weight + 1)))) AS host_ok FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND host_ok) AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


CAPTURES = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


#: Pages whose article stands in an article element, as in the given tables.
PAGE_TEXTS = """
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x:
         trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))) AS blocks
  FROM a
), t AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


INFILLED = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents
), x AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS e FROM d
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
              WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, left(t, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def resampled(buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> str:
    """CRC-32 byte by byte over each different word."""
    words = """SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM {table}"""
    return f"""
WITH tab AS (
  SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
         CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS tab FROM range(256) AS r(v)
), dw AS ({words.format(key='doc_id', table='documents')}
), bw AS ({words.format(key='item_id', table='benchmark')}
), spelled AS (
  SELECT w, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT) AS bytes
  FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
         xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % {buckets} AS bucket FROM spelled, tab
), dc AS (
  SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket
), bc AS (
  SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket
), gain AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(bc.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets})
         / ((coalesce(dc.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {buckets}))))::BIGINT AS g
  FROM range({buckets}) AS r(b) LEFT JOIN dc ON dc.bucket = b LEFT JOIN bc ON bc.bucket = b
), weighed AS (
  SELECT doc_id, count(*) AS n, sum(g) AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0)
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT)::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS r,
         count(*) OVER (PARTITION BY n_features >= {least_words}) AS all_of FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {least_words} AND r <= {percent} * all_of // 100 THEN r END::BIGINT AS rank FROM ranked
"""


def licenses() -> str:
    """Every block of lines against every template, without any filter; phrases by their places among the words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS spot, {quoted(label)} AS label FROM places WHERE "
        + " AND ".join(f"w[i + {k}] = {quoted(x)}" for k, x in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES
    )
    return f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), {upper}) AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM d
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w
), base AS ({phrases}
), templates AS (
  SELECT id, label, list_distinct(regexp_extract_all(translate(body, {upper}), '{word}')) AS words
  FROM (VALUES {templates}) AS v(id, label, body)
), lines AS (
  SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)
), blocks AS (
  SELECT doc_id, list_distinct(regexp_extract_all(l[i] || CASE WHEN regexp_matches(l[i + 1], '{word}') THEN chr(10) || l[i + 1] ||
         CASE WHEN regexp_matches(l[i + 2], '{word}') THEN chr(10) || l[i + 2] ELSE '' END ELSE '' END, '{word}')) AS held FROM lines
), met AS (
  SELECT doc_id, label, len(list_intersect(words, held)) / len(words) AS contained,
         len(list_intersect(words, held)) >= ceil({SHARE} * len(words) - 1e-9) AS enough
  FROM blocks, templates
), hits AS (
  SELECT doc_id, label, contained FROM met WHERE enough
), b AS (
  SELECT doc_id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM base GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM hits) GROUP BY doc_id
), s AS (
  SELECT doc_id, max(contained) AS best FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word,
       hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
"""
