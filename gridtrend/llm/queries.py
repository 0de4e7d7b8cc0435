"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtrend.llm import curriculum, decontaminate, hard_negatives, host_rules, html_extract, language_id
from gridtrend.llm import one_bit_search, ranked_search, sharding, simhash, suffix_dedup, toxicity, warc
from gridtrend.llm.common import keep, remainder, table

QUERIES = {}
ORACLES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = language_id.learned(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.language(docs, model).alias("m"))
    return found.select("doc_id", "held_out", F.col("m.lang").alias("lang_pred"), "m.score", "m.languages")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.learned(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    scores = docs.select("doc_id", "lang", held_out.alias("held_out"), toxicity.scored(docs, model).alias("score"))
    return scores.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        toxicity.flagged(F.col("score"), F.col("lang"), model).alias("flagged"),
    )


@query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    whole = host_rules.measured(docs).drop("text")
    return host_rules.verdicts(whole).select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "n_links")


@query
def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = curriculum.takes(docs)
    return mixed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.aggregate("__takes", F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("taken"),
        F.floor(F.array_min(F.transform("__takes", lambda x: x["position"])) * 1e6).alias("position_ppm"),
    )


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    numbered = docs.withColumn("__rid", F.monotonically_increasing_id())
    measures = keep(sharding.measured(numbered, "doc_id"))
    return measures.drop("group", "mark").join(sharding.assign(measures), "rid").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "match.*")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        hard_negatives.scaled("embedding").alias("vec"),
    )
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query
def op13_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")
    )
    return one_bit_search.nearest(rows, F.col("id") % 50 == 0)


ORACLES["op12_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), l AS (
  SELECT rid, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l
), tf AS (
  SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS t FROM l) GROUP BY rid, t
), q AS (
  SELECT item_id, text, t, count(*)::BIGINT AS times FROM (
    SELECT item_id, text, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY item_id, text, t
), w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), whole
), m AS (
  SELECT rid, doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM l, whole
), scored AS (
  SELECT item_id, text, rid, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY item_id, text, rid
)
SELECT item_id,
       (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


ORACLES["op11_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.id <> c.id AND len(a.x) = len(c.x) WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


ORACLES["op8_host_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), one AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w
), tri AS (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS t
  FROM one WINDOW o AS (PARTITION BY rid ORDER BY i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri WHERE t IS NOT NULL)
  WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > n_words AS dup_lines,
         word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM m
), rules AS (
  SELECT source, rule, failed FROM f UNPIVOT (failed FOR rule IN (short, repeats, symbols, dup_lines, word_length))
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM rules
  WHERE source IS NOT NULL GROUP BY source, rule
), total AS (
  SELECT rule, sum(n) AS nn, count(*) AS h, sum(n * n) AS sq, sum(x) / sum(n) AS m, sum(x * x / n) AS q
  FROM hosts GROUP BY rule
), spread AS (
  SELECT *, CASE WHEN nn - sq / nn > 0 THEN (q - m * m * nn - (h - 1) * m * (1 - m)) / (nn - sq / nn) ELSE 0 END AS v
  FROM total
), prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(0, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM spread
), bad AS (
  SELECT source FROM hosts JOIN prior USING (rule) GROUP BY source
  HAVING max(round((x + m * k) / (n + k), 9)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source
"""

ORACLES["op6_curriculum"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS place FROM s
), v AS (
  SELECT *, [5.0, 2.0, 1.0][place + 1]::DOUBLE AS weight FROM w
), r AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM v
), p AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_,
         1.5 * sum(source_size) OVER () AS demand
  FROM r
), l AS (
  SELECT arg_min((demand - full_) / free_, k) FILTER (WHERE 2.0 * source_size / weight >= (demand - full_) / free_) AS level FROM p
), t AS (
  SELECT source, place, source_size, least(2.0 * source_size, coalesce(level, 0) * weight)::DOUBLE AS target FROM v, l
), c AS (
  SELECT d.*, place, source_size, target, floor(target)::BIGINT AS wanted,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, d.size, rid
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT rid, place, greatest(0, least(c.size, wanted - (start + k * source_size))) AS words,
         CASE WHEN wanted > 0 THEN (start + k * source_size)::DOUBLE / wanted ELSE 0 END AS part
  FROM c, (VALUES (0), (1)) n(k)
), q AS (
  SELECT rid, words, CASE place
      WHEN 0 THEN 2.0 * (part * 0.75) / (1.0 + sqrt(greatest(0.0, 1.0 + -1.0 * (part * 0.75))))
      WHEN 1 THEN 2.0 * (part * 0.75) / (0.5 + sqrt(greatest(0.0, 0.25 + 1.0 * (part * 0.75))))
      ELSE CASE WHEN part * 0.75 < 0.375
        THEN 2.0 * (part * 0.75) / (0.5 + sqrt(greatest(0.0, 0.25 + 2.0 * (part * 0.75))))
        ELSE 0.5 + 2.0 * (part * 0.75 - 0.375) / (1.0 + sqrt(greatest(0.0, 1.0 + -2.0 * (part * 0.75 - 0.375)))) END
    END AS position
  FROM o WHERE words > 0
)
SELECT c.doc_id, c.size, source_size, target, coalesce(sum(words), 0)::BIGINT AS taken,
       floor(min(position) * 1e6)::BIGINT AS position_ppm
FROM c LEFT JOIN q USING (rid) GROUP BY c.rid, c.doc_id, c.size, source_size, target
"""
