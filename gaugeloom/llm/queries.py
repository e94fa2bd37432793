"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, ivfpq, linededup, mixing, neardup, phrases, quality, sharding, suffixdedup, tokens, toxicity, warc, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_quality, op3_suffix_dedup, op4_toxicity, op5_token_counts, op6_neighbours, op7_mixing, op8_near_duplicates, op9_decontamination, op10_warc, op11_collocations, op12_source_divergence, op13_line_dedup, pipeline)
    return {f.__name__: f for f in own}


#: The checksum of each text in SQL: a table of 256 remainders, then a fold over the bytes in hexadecimal.
_OP1 = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT r.i, 0, r.i FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
),
remainders AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, text, (octet_length(encode(text)) + 1)::BIGINT AS size,
    CASE WHEN length(h) = 0 THEN 0 ELSE xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) END AS text_crc32
  FROM texts, remainders
),
names(level, name, w) AS (
  SELECT 'region', 'region:g' || i, 4.0 FROM range(2) AS r(i) UNION ALL SELECT 'region', 'region:g+8', 1.0
  UNION ALL SELECT 'rack', 'rack:k' || i, 2.0 FROM range(4) AS r(i)
  UNION ALL SELECT 'shard', 'shard:' || i, 1.0 FROM range(8) AS r(i)
),
draws AS (
  SELECT doc_id, level, name, -ln((('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || name), 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0) / w AS d
  FROM (SELECT DISTINCT doc_id FROM documents), names
),
region AS (
  SELECT doc_id, (arg_min(name, d) FILTER (WHERE name <> 'region:g+8'))[9:]::INT AS g, arg_min(name, d) = 'region:g+8' AS grown
  FROM draws WHERE level = 'region' GROUP BY doc_id
),
rack AS (
  SELECT doc_id, any_value(grown) AS grown, arg_min(name, d)[7:]::INT AS k
  FROM draws JOIN region USING (doc_id) WHERE level = 'rack' AND right(name, 1)::INT // 2 = g GROUP BY doc_id
),
placed AS (
  SELECT doc_id, any_value(grown) AS grown, arg_min(name, d)[7:]::INT AS shard
  FROM draws JOIN rack USING (doc_id) WHERE level = 'shard' AND right(name, 1)::INT // 2 = k GROUP BY doc_id
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, p.shard,
  (row_number() OVER (PARTITION BY p.shard ORDER BY left(md5(coalesce(s.doc_id::VARCHAR, 'null') || '/' || s.text_crc32 || '/slot'), 3), s.doc_id, s.text_crc32, s.size) - 1)::BIGINT AS slot,
  CASE WHEN p.grown THEN 8 ELSE p.shard END AS grown_shard
FROM sums s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

_OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS "full" FROM per
),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum("full") OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level,
    row_number() OVER (ORDER BY "full" / weight, encode(source) NULLS LAST) AS place
  FROM weighed WINDOW w AS (ORDER BY "full" / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chosen AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= "full"),
goals AS (SELECT source, source_size, least(weight * coalesce((SELECT level FROM chosen), 0.0), "full") AS target FROM weighed),
plan AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid, floor(target + 1e-6)::BIGINT AS quota,
    (quota // greatest(source_size, 1)) * ceil(source_size / 1024.0)::BIGINT + ceil((quota % greatest(source_size, 1)) / 1024.0)::BIGINT AS slots FROM goals
),
shares AS (SELECT sid, slots, sum(slots) OVER (ORDER BY sid)::DOUBLE AS upto, greatest(sum(slots) OVER (), 1)::DOUBLE AS "all" FROM plan WHERE slots > 0),
points AS (SELECT i, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE AS x FROM range((SELECT coalesce(sum(slots), 0)::BIGINT FROM plan)) AS r(i)),
drawn AS (
  SELECT sid, slots, i AS slot, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank
  FROM points JOIN shares ON x - floor(x) >= (upto - slots) / "all" AND x - floor(x) < upto / "all"
),
missing AS (
  SELECT sid, unnest(range(have, slots)) AS rank FROM (SELECT s.sid, any_value(s.slots) AS slots, count(d.slot) AS have FROM shares s LEFT JOIN drawn d ON d.sid = s.sid GROUP BY s.sid) WHERE have < slots
),
schedule AS (
  SELECT sid, rank, slot FROM drawn WHERE rank < slots
  UNION ALL SELECT sid, rank, (SELECT sum(slots) FROM plan)::BIGINT + rank FROM missing
),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.quota, g.sid,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR || '/', 'null//') || s.size || '/7'), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS "offset"
  FROM sized s JOIN plan g ON s.source IS NOT DISTINCT FROM g.source
),
taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size) + greatest(0, least("offset" + size, quota % source_size) - "offset") END::BIGINT AS taken FROM placed
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM taken t LEFT JOIN schedule c ON c.sid = t.sid AND c.rank = t."offset" // 1024
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i + 1:i + m], ' ') AS g FROM (SELECT *, unnest(range(len(w) - m + 1)) AS i FROM items)),
starts AS (SELECT doc_id, i, m, array_to_string(w[i + 1:i + m], ' ') AS g FROM (SELECT d.*, l.m, unnest(range(len(w) - l.m + 1)) AS i FROM d, (SELECT DISTINCT m FROM windows) l WHERE len(w) >= l.m)),
hits AS (SELECT s.doc_id, s.i, s.m, x.item_id FROM starts s JOIN windows x USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY body)
SELECT p.page_id, octet_length(p.body)::BIGINT AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (body)
"""

_OP11 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(len(w))) AS i FROM pieces),
grams AS (SELECT lang, m, w[i + 1:i + m] AS g FROM starts, range(1, 6) AS x(m) WHERE i + m <= len(w)),
f AS (SELECT lang, m, g, array_to_string(g, ' ') AS phrase, count(*)::HUGEINT AS c FROM grams GROUP BY lang, m, g HAVING count(*) >= 100),
cuts AS (SELECT lang, m, g, phrase, c AS a, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
sides AS (
  SELECT x.lang, x.phrase, x.m, x.a, x.k, l.c AS l, r.c AS r, t.n, (1000 * x.a * t.n) // (l.c * r.c) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:x.k] JOIN f r ON r.lang = x.lang AND r.g = x.g[x.k + 1:x.m] JOIN totals t ON t.lang = x.lang
),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (
  SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f y ON y.lang = s.lang AND y.m > s.m AND 100 * y.c >= 100 * s.c
  WHERE s.m >= 2 AND contains(' ' || y.phrase || ' ', ' ' || s.phrase || ' ')
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest ANTI JOIN gone USING (lang, phrase)
) WHERE rank <= 2000
"""

_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
g AS (
  SELECT x.lang, x.source, coalesce(v.v, 0)::HUGEINT AS v, coalesce(v.n, 0) AS lang_n, coalesce(s.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (g.lang_n + 2 * g.v) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE cnt > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

_OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (
  SELECT r, doc_id, lines, list_transform(lines, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys
  FROM d
),
common AS (SELECT key FROM (SELECT r, unnest(list_distinct(keys)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
x AS (
  SELECT doc_id, len(lines) AS n, list_filter(list_zip(lines, keys), lambda p: NOT list_contains(coalesce(gone, []), p[2])) AS kept
  FROM k LEFT JOIN (SELECT r, list(key) AS gone FROM (SELECT r, unnest(list_distinct(keys)) AS key FROM k) JOIN common USING (key) GROUP BY r) USING (r)
)
SELECT doc_id, n::BIGINT AS n_lines, (n - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(list_transform(kept, lambda p: p[1]), chr(10)), '')) AS kept_sha256 FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _OP1, "op7_mixing": _OP7, "op9_decontamination": _OP9, "op10_warc": _OP10, "op11_collocations": _OP11, "op12_source_divergence": _OP12, "op13_line_dedup": _OP13}
