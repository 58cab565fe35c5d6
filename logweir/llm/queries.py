"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import images, jaccard, language, lattice, mixing, packing, pii, quality, repeats, sstable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(divisor: int):
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def held_out(divisor: int, rest: int):
    """Whether nothing is learned from a row for its id; a null id isn't held out, and nothing is learned from its row either."""
    return F.coalesce(remainder(divisor) == rest, F.lit(False)).alias("held_out")


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE r.a = vec_id), vec_id)) AS component_id FROM embeddings
)
SELECT *, vec_id = component_id AS kept FROM c
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train_language(docs.filter(remainder(3) != 1))
    found = language.identify_language(docs, model)
    return found.select("doc_id", held_out(3, 1), "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) AS t(i)
), hit AS (
  SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT doc_id, i + j AS p FROM hit, range(35) AS r(j)
), kept AS (
  SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = w.doc_id AND c.p = t.p)
), k AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM kept GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    """Learned from the labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & (remainder(5) != 0))
    return quality.train_quality(docs.select("doc_id", "text").join(known, "doc_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.systematic_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s
), c AS (
  SELECT *, coalesce(sum(source_size) OVER p, 0) AS full_size, coalesce(sum(w) OVER p, 0) AS full_w,
         sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM r WINDOW p AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((total - 3 * full_size)::DOUBLE / (all_w - full_w), full_w) FILTER ((total - 3 * full_size)::DOUBLE / (all_w - full_w) <= ratio) AS level FROM c
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target,
         ('0x' || substr(md5('mix|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM s, l
), e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS expected,
         (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor((i + 1.0::DOUBLE) * expected + u) - floor(i * expected + u), 3) * size)::BIGINT AS taken
FROM e
"""


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.copies(images.textures(table(spark, sf_dir, "embeddings")))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


#: The pseudonyms' key of the registered queries; an application passes its own secret.
PII_KEY = "registered-query"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lattice_near_dedup, op2_language_id, op3_best_fit_packing, op4_substring_dedup, op5_quality_classifier, op6_jaccard_join, op7_source_mixing, op8_image_copies, op9_token_shards, op10_pii_pseudonyms)}


def oracle_sql() -> dict[str, str]:
    return {"op1_lattice_near_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op7_source_mixing": OP7_SQL}
