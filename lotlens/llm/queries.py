"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, exact_dedup, jaccard_join, mixing, pii, quality, resample, sharding, substring_dedup, suffix_dedup,
               vector_codes, vector_join, warc)
from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.hit_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, read_table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mix_report(read_table(spark, sf_dir, "documents"))
    return report.withColumn("target", F.round("target", 6))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")) \
        .drop("n_words")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_pii, op3_quality_rules, op4_jaccard_join, op5_suffix_dedup, op6_decontaminate,
    op7_warc_revisits, op8_mix_sources, op9_jump_shards, op10_exact_dedup, op11_vector_join, op12_importance_resample,
    op13_vector_codes)}

OP1_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM doc_words WHERE len(words) >= 13)),
repeated AS (
  SELECT w.doc_id, w.i FROM windows w
  JOIN (SELECT passage, min(doc_id) AS first_doc FROM windows GROUP BY passage) f USING (passage)
  WHERE f.first_doc < w.doc_id),
removed AS (
  SELECT doc_id, list(DISTINCT place) AS places
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS place FROM repeated) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(places, k)),
                                  lambda k: words[k]) END AS kept_words
  FROM doc_words d LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept_words, ' '), '')) AS kept_sha256 FROM kept
"""

OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
         array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS passage
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
        FROM item_words WHERE len(words) > 0)),
places AS (
  SELECT d.doc_id, n, i, array_to_string(d.words[i : i + n - 1], ' ') AS passage
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n) d),
hits AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w USING (n, passage)),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP7_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, payload, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  (((('0x' || substr(hex, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT) >> (15 - i % 4 * 5)::BIGINT) & 31) + 1, 1)),
         '') AS digest
  FROM payloads),
groups AS (SELECT payload, max(page_id) AS original FROM payloads GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM coded JOIN groups USING (payload)
"""

OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1.0 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM sums),
-- hand out by weight, round by round; who is above the cap gets the cap and leaves
rounds AS (
  SELECT 0 AS k, source, source_size, weight, false AS capped, 0.0::DOUBLE AS target FROM ranked
  UNION ALL
  SELECT k + 1, source, source_size, weight, capped OR share > 3 * source_size,
         CASE WHEN capped OR share > 3 * source_size THEN 3 * source_size ELSE share END
  FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))
              * weight / sum(weight) FILTER (NOT capped) OVER () AS share
    FROM rounds) WHERE k < 40),
targets AS (SELECT source, source_size, target FROM rounds WHERE k = 40),
taken AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM taken
"""

OP10_SQL = """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents d
JOIN (SELECT coalesce(text, '') AS content, max(doc_id) AS keep_id, count(*) AS group_size
      FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.content
"""

OP11_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
copies AS (SELECT label, v, count(*) AS n FROM able GROUP BY label, v)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id) AS n_links,
       (SELECT min(y) FROM reach WHERE x = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(y) FROM reach WHERE x = e.vec_id) AS kept, coalesce(c.n, 1) AS n_copies
FROM embeddings e LEFT JOIN able a USING (vec_id) LEFT JOIN copies c ON a.label = c.label AND a.v = c.v
"""

# rank is a double here: a nullable bigint of Spark is one too once it is a pandas column
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
bags AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
grams AS (
  SELECT side, id, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT side, id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM bags, range(1, 4) t(n) WHERE len(words) >= n)),
hashed AS MATERIALIZED (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, bytes),
                               lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT gram, entries, list_transform(range(1, octet_length(encode(gram)) + 1),
                                             lambda i: ('0x' || substr(hex(encode(gram)), 2 * i - 1, 2))::BIGINT) AS bytes
        FROM (SELECT DISTINCT gram FROM grams), crc_table)),
features AS (SELECT side, id, bucket, count(*) AS n FROM grams JOIN hashed USING (gram) GROUP BY side, id, bucket),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM features GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM counts, totals),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS able,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM bags LEFT JOIN weights USING (id) WHERE side = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER () // 100 AS most FROM scored WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END::DOUBLE AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _op13_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """K-means round by round: a table of codebooks and one of nearest entries for each."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""assigned{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, [d, e]) AS e, min(d) AS d FROM (
    SELECT v.vec_id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts v JOIN books{k} b USING (p)) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""books{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM books{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
      SELECT p, e, j, sum(v.x[j])::BIGINT AS s, count(*) AS n
      FROM parts v JOIN assigned{k} USING (vec_id, p), range(1, len(v.x) + 1) t(j) GROUP BY p, e, j) GROUP BY p, e) m
  ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH able AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM able, range({parts}) t(p)),
books0 AS MATERIALIZED (
  SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS e, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM able ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM assigned{rounds} JOIN able USING (vec_id) GROUP BY vec_id, label),
digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL, "op6_decontaminate": OP6_SQL, "op7_warc_revisits": OP7_SQL, "op8_mix_sources": OP8_SQL,
    "op10_exact_dedup": OP10_SQL, "op11_vector_join": OP11_SQL, "op12_importance_resample": OP12_SQL,
    "op13_vector_codes": _op13_sql()}
