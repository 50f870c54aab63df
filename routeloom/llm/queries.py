"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup, hardnegatives, langid, licenses, linededup, mixing, neardup, packing, quality, tokenfiles, transducer, vptree, whitening
from .common import table, vocabulary

WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_lines", "n_removed_lines", "n_removed_runs", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs, mixing.labelled_documents(docs, table(spark, sf_dir, "labels")), mixing.TARGETS, mixing.GROWTH)
    names = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(sorted(mixing.TARGETS))]
    return rows.select("doc_id", "n_tokens", *names, "rate", "copies", "residual")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


def op11_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(spark, f"{sf_dir}/documents.parquet")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one before anything else."""
    vectors = table(spark, sf_dir, "embeddings")
    return hardnegatives.mine(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fertility, op2_token_counts, op3_license_scan, op4_best_fit, op5_token_files, op6_line_dedup, op7_near_duplicates, op8_soft_mixing, op9_language, op10_nearest, op11_exact_groups, op12_whitening, op13_hard_negatives)}


OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), counted AS (
  SELECT *, len(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> '')) AS n FROM lines
), worded AS (
  SELECT doc_id, i, line, greatest(n, length(line) // {linededup.WORD_LETTERS}) AS w, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM counted WHERE n > 0
), around AS (
  SELECT *, lag(h) OVER o AS h0, lead(w) OVER o AS w1, lead(i) OVER o AS i1, sum(least(w, {linededup.LONG_WORDS})) OVER o AS c
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, c - least(w, {linededup.LONG_WORDS}) AS c0, i1 IS NULL OR w >= {linededup.LONG_WORDS} OR w1 >= {linededup.LONG_WORDS} OR coalesce((h0 * 31 + h) % {linededup.SPREAD} = 0, false) AS ends FROM around
), begun AS (
  SELECT *, coalesce(lag(coalesce(ends, false)) OVER (PARTITION BY doc_id ORDER BY i), true) AS begins FROM ended
), numbered AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM begun
), spans AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM numbered a ASOF JOIN numbered b ON a.doc_id = b.doc_id AND a.c0 + {linededup.LONG_WORDS} <= b.c
  UNION SELECT b.doc_id, a.i, b.i FROM numbered b ASOF JOIN numbered a ON a.doc_id = b.doc_id AND b.c - {linededup.LONG_WORDS} >= a.c0
  UNION SELECT doc_id, min(i), max(i) FROM numbered GROUP BY doc_id, k
        HAVING max(c) - min(c0) >= {linededup.LONG_WORDS} OR max(c) - min(c0) >= {linededup.LEAST_WORDS} AND count(*) > 1
), passages AS (
  SELECT doc_id, a, b, array_to_string(string_split(text, chr(10))[a:b], chr(10)) AS passage FROM spans JOIN documents USING (doc_id)
), later AS (
  SELECT doc_id, a, b FROM passages QUALIFY row_number() OVER (PARTITION BY passage ORDER BY doc_id, a) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), runs AS (
  SELECT doc_id, count(*) AS n_gone, sum((g0 IS NULL OR g0 < i - 1)::INT) AS n_runs FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS g0 FROM gone) GROUP BY doc_id
), rest AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS t FROM lines l SEMI JOIN runs r ON l.doc_id = r.doc_id ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
), sized AS (
  SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id
), joined AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, coalesce(n_runs, 0) AS n_runs, n_gone IS NULL AS same, d.text,
         coalesce(regexp_matches(coalesce(t, ''), '[^\\x20\\x09-\\x0D]'), false) AS has
  , t FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN rest USING (doc_id)
)
SELECT doc_id, n_lines, CAST(CASE WHEN same OR has THEN n_gone ELSE n_lines END AS BIGINT) AS n_removed_lines, CAST(n_runs AS BIGINT) AS n_removed_runs,
       CAST(length(CASE WHEN same THEN text WHEN has THEN t ELSE '' END) AS BIGINT) AS n_chars_left, md5(CASE WHEN same THEN text WHEN has THEN t ELSE '' END) AS text_md5
FROM joined
"""


OP11_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
OP13_SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({hardnegatives.SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % {hardnegatives.EVERY} = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= {hardnegatives.POSITIVES}
), n AS (
  SELECT p.anchor, positive, other, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, other) AS k
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND {hardnegatives.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {hardnegatives.HIGH} * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(k AS INTEGER) AS rank, other AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= {hardnegatives.NEGATIVES}
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op11_exact_groups": OP11_SQL, "op13_hard_negatives": OP13_SQL}
