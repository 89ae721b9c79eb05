"""Queries over the driver's tables, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import ann, bpe, langid, lm, mixing, negatives, pages, quality, simhash, spelling, tokenfile, urls, warc
from tideline.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('-', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, '0')), doc_id, size
    ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized
), sources AS (
  SELECT source, sum(size) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
    ((sum(source_size) OVER () * 1.5::DOUBLE - (sum(2.0::DOUBLE * source_size) OVER w - 2.0::DOUBLE * source_size))
      / (sum(weight) OVER () - (sum(weight) OVER w - weight))) AS level
  FROM sources
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size,
    CASE WHEN full_at <= level THEN 2.0::DOUBLE * source_size
      ELSE least(2.0::DOUBLE * source_size, weight * max(level) FILTER (full_at > level) OVER ()) END AS target
  FROM levels
), wanted AS (
  SELECT p.doc_id, p.size, p.start, t.source_size, t.target, round(t.target)::BIGINT AS want
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(size, want - start)) + greatest(0, least(size, want - source_size - start)) END)::BIGINT AS taken
FROM wanted
"""


@query("op1_mixing", MIX_SQL)
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    sized, pieces = mixing.mix(materialize(sizes, "sizes"))
    return mixing.taken_words(sized, pieces).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, folder, "documents"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


WARC_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes, hex, array_to_string(list_transform(string_split(hex, ''),
      lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101',
            '1110', '1111'][position(c IN '0123456789abcdef')]), '') AS b
  FROM hashed
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + substr(b, CAST(5 * i + 1 AS BIGINT), 1)::BIGINT * 16 + substr(b, CAST(5 * i + 2 AS BIGINT), 1)::BIGINT * 8
        + substr(b, CAST(5 * i + 3 AS BIGINT), 1)::BIGINT * 4 + substr(b, CAST(5 * i + 4 AS BIGINT), 1)::BIGINT * 2
        + substr(b, CAST(5 * i + 5 AS BIGINT), 1)::BIGINT, 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first
  FROM bits
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND (page_id IS NULL OR page_id > first) THEN first END AS refers_to
FROM named
"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_url_filters")
def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages")
    return urls.judge(found, urls.fit(urls.labelled_by_rules(found)))


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages")
    return pages.extract(found, pages.fit(found))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_groups(spelling.corpus_words(table(spark, folder, "documents")))


NEGATIVES_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label)


@query("op13_lm_scoring")
def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))
