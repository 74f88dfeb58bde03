"""The queries of the corpus operators: thin views of the operators' results over their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, embedding_dedup, language_model, licenses, packing, pii, quality, simhash, toxicity, warc
from lattica.llm.common import fold, table


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """(json file, ranks file, split pattern) of a public vocabulary."""
    import public_tokenizers as public

    return str(public.path(f"{name}.json")), str(public.path(f"{name}.tiktoken")), public.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 3) != 1))
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files()).drop("ids")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 5) != 0))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_embedding_dedup, op3_licenses, op4_packing, op5_decontamination, op6_toxicity, op7_language_model,
        op8_simhash, op9_warc, op10_pii,
    )
}
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, list_cosine_similarity(e, e) AS ok, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(src, dst) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.src, l.dst FROM reach r JOIN l ON r.dst = l.src
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.src = e.vec_id) AS n_links,
  (SELECT min(r.dst) FROM reach r WHERE r.src = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(r.dst) FROM reach r WHERE r.src = e.vec_id) AS kept
FROM embeddings e
""",
    "op5_decontamination": """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, i, s.l, array_to_string(w[i : i + s.l - 1], ' ') AS win
  FROM d, (SELECT DISTINCT l FROM bw) s, unnest(range(1, len(w) - s.l + 2)) AS t(i)
), h AS (
  SELECT doc_id, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
""",
    "op9_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32}, 1 + CAST(
    (CAST('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
""",
}
