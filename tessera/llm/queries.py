"""The thin queries of the operators in this subpackage, over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, jaccard, mixing, mpeg, packing, quality, secret_scan, substrings, toxicity, urls
from tessera.llm.calibration import id_remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """3-word shingles, links from 90 of 100 on."""
    return jaccard.jaccard_components(_table(spark, folder, "documents"), n=3, num=90, den=100)


_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS same FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * same >= 90 * (n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.other FROM r JOIN e ON e.a = r.doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from labels of rows whose crc32 remainder by 3 is not 1."""
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    scores = quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels").where(~held_out), label="quality")
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2048 tokens of the byte-level BPE with 50k merges."""
    return packing.pack_documents(_table(spark, folder, "documents"), length=2048)


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Weights 3, 1, 2; 150 % of all words; at most two copies."""
    mixed = mixing.mix(_table(spark, folder, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Fixed rules.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The five fixed rules; what they don't list is allowed."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS rules(host, path, verdict)")
    return urls.judge_urls(_table(spark, folder, "pages"), rules)


OP5_SQL = """
WITH p AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
rules(r_host, r_path, r_verdict) AS (VALUES {values}),
each AS (SELECT DISTINCT host, path FROM h),
fit AS (
  SELECT host, path, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC) AS n
  FROM each JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, h.host, h.path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM h LEFT JOIN fit ON fit.host = h.host AND fit.path = h.path AND n = 1
""".format(values=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(_table(spark, folder, "documents")))


def op7_permutation_ann(spark: SparkSession, folder: str) -> DataFrame:
    """Ten neighbours of each vector whose id is divisible by 100."""
    return ann.nearest(_table(spark, folder, "embeddings"), k=10, every=100)


def op8_mpeg_audio(spark: SparkSession, folder: str) -> DataFrame:
    return mpeg.digests(mpeg.read(mpeg.store(_table(spark, folder, "documents"))))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 20 words."""
    return substrings.digests(substrings.remove_repeats(_table(spark, folder, "documents"), window=20))


OP9_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w)),
late AS (SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM late, range(20) AS r(k)),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
k AS (SELECT doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept FROM t LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from labels of rows whose crc32 remainder by 5 is not 0."""
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    scores = toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels").where(~held_out), label="toxic")
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_classifier, op3_best_fit_packing, op4_source_mix, op5_url_filter, op6_secret_scan, op7_permutation_ann, op8_mpeg_audio, op9_substring_dedup, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op5_url_filter": OP5_SQL, "op9_substring_dedup": OP9_SQL}
