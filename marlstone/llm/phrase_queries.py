"""Registered queries of phrases, fingerprints and resampling by chunks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, fingerprints, resampling

PHRASE_WORDS = 3
PHRASE_COUNT = 10
INSIDE_PERCENT = 50
TOP_PHRASES = 2000
DRAWN_PERCENT = 25
DRAWN_WORDS = 20
FEATURE_WORDS = 2
FEATURE_BUCKETS = 10_000
DRAW_SEED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), PHRASE_WORDS, PHRASE_COUNT, INSIDE_PERCENT, TOP_PHRASES)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), DRAWN_PERCENT, DRAWN_WORDS, FEATURE_WORDS, FEATURE_BUCKETS, DRAW_SEED)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), q AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p
), w AS (
  SELECT lang, id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM q
), s AS (
  SELECT lang, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM w WINDOW v AS (PARTITION BY id ORDER BY i)
), f AS (
  SELECT lang, x AS p, 1 AS size, count(*) AS f FROM s GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y, 2, count(*) FROM s WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, 3, count(*) FROM s WHERE z IS NOT NULL GROUP BY ALL
), o AS (
  SELECT lang, p, f, string_split(p, ' ') AS ws FROM f WHERE size > 1 AND f >= {PHRASE_COUNT}
), c AS (
  SELECT lang, p, f AS a, unnest(range(1, len(ws))) AS k, ws FROM o
), h AS (
  SELECT lang, p, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM c
), d AS (
  SELECT h.lang, h.p, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM h JOIN f AS l ON l.lang = h.lang AND l.p = h.first JOIN f AS r ON r.lang = h.lang AND r.p = h.rest
), e AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), t AS (
  SELECT lang, q AS p, max(f) AS most
  FROM (SELECT lang, f, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS q FROM o WHERE len(ws) = 3) GROUP BY ALL
), n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (
  SELECT e.lang, e.p AS phrase, a, l, r, score FROM e LEFT JOIN t ON t.lang = e.lang AND t.p = e.p
  WHERE most IS NULL OR 100 * most < {INSIDE_PERCENT} * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM g JOIN n USING (lang) QUALIFY rank <= {TOP_PHRASES}
"""
_OP12 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents
), e AS (
  SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d
), c AS (
  SELECT doc_id, t, n, x, left(t, (n - n // 2)::BIGINT) || left(x, (n // 2)::BIGINT) AS y FROM e
), a AS (
  SELECT t, strlen(t) AS size, row_number() OVER () AS id FROM (SELECT t FROM c UNION SELECT y FROM c)
), h AS (
  SELECT id, regexp_extract_all(hex(encode(t)), '..') AS l FROM a
), b AS (
  SELECT id, ('0x' || unnest(l))::BIGINT AS v, generate_subscripts(l, 1) AS i FROM h
), r AS (
  SELECT id, v + 256 * lead(v) OVER w + 65536 * lead(v, 2) OVER w AS triplet FROM b WINDOW w AS (PARTITION BY id ORDER BY i)
), k AS (
  SELECT id, (triplet * {fingerprints.TRIPLET_MIX} % 4294967296) >> {fingerprints._SHIFT} AS bucket, count(*) AS m FROM r WHERE triplet IS NOT NULL GROUP BY ALL
), z AS (
  SELECT a.id, size, list(coalesce(m, 0) ORDER BY s.bucket) AS counts
  FROM a CROSS JOIN range({fingerprints.BUCKETS}) AS s(bucket) LEFT JOIN k ON k.id = a.id AND k.bucket = s.bucket GROUP BY a.id, size
), q AS (
  SELECT id, counts, list_sort(counts) AS o, least(255, floor({fingerprints.LENGTH_STEPS} * log2(size + 1)))::BIGINT AS step FROM z
), g AS (
  SELECT id, step, list_transform(counts, lambda m: (m > o[{fingerprints.BUCKETS // 4}])::INT + (m > o[{fingerprints.BUCKETS // 2}])::INT + (m > o[{3 * fingerprints.BUCKETS // 4}])::INT) AS codes FROM q
), f AS (
  SELECT a.t, step, codes, lower(lpad(hex(step), 2, '0') || array_to_string(list_transform(range(1, {fingerprints.BUCKETS}, 2), lambda i: hex(codes[i] * 4 + codes[i + 1])), '')) AS print
  FROM g JOIN a USING (id)
), j AS (
  SELECT doc_id, n, y, own.print AS p, ed.print AS ep,
         list_sum(list_transform(list_zip(own.codes, ed.codes), lambda u: abs(u[1] - u[2]))) + least({fingerprints.LENGTH_BOUND}, abs(own.step - ed.step)) AS de,
         list_sum(list_transform(list_zip(own.codes, nx.codes), lambda u: abs(u[1] - u[2]))) + least({fingerprints.LENGTH_BOUND}, abs(own.step - nx.step)) AS dn,
         least({fingerprints.BOUND}, list_sum(own.codes) + list_sum(ed.codes)) + {fingerprints.LENGTH_BOUND} AS be,
         least({fingerprints.BOUND}, list_sum(own.codes) + list_sum(nx.codes)) + {fingerprints.LENGTH_BOUND} AS bn
  FROM c JOIN f AS own ON own.t = c.t JOIN f AS ed ON ed.t = c.y JOIN f AS nx ON nx.t = c.x
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(y) AS edited_sha256, p AS fingerprint, ep AS edited_fingerprint,
       1 - least(be, de)::DOUBLE / be AS near_edited, 1 - least(bn, dn)::DOUBLE / bn AS near_next
FROM j
"""

# The checksum of every distinct feature, byte by byte, with a table made from its polynomial.
_OP13 = f"""
WITH x AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc
), q AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), u AS (
  SELECT side, id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM q
), v AS (
  SELECT side, id, a, lead(a) OVER (PARTITION BY side, id ORDER BY i) AS b FROM u
), o AS (
  SELECT side, id, unnest(CASE WHEN b IS NULL THEN [a] ELSE [a, a || ' ' || b] END) AS feature FROM v
), c AS (
  SELECT side, id, feature, count(*) AS n FROM o GROUP BY ALL
), h AS (
  SELECT feature, list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda y: ('0x' || y)::BIGINT) AS bytes
  FROM (SELECT DISTINCT feature FROM c)
), k AS (
  SELECT feature, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) % {FEATURE_BUCKETS} AS bucket
  FROM h, x
), n AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c JOIN k USING (feature) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + {FEATURE_BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + {FEATURE_BUCKETS})::DOUBLE)))::BIGINT AS gain FROM n
), m AS (
  SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM c JOIN k USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY id
), z AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight
  FROM q LEFT JOIN m USING (id) WHERE side = 'd'
), y AS (
  SELECT doc_id, n_words, n_features, weight,
         weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{DRAW_SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM z
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_words >= {DRAWN_WORDS}
)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= {DRAWN_PERCENT} * n // 100 THEN rank END AS rank
FROM y LEFT JOIN r ON r.doc_id = y.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op11_collocations, op12_fingerprints, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": _OP11, "op12_fingerprints": _OP12, "op13_resampling": _OP13}
