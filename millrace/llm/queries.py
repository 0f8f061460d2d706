"""Queries of the problems on language-model data, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encoding, harm, history, packing, together
from millrace.session import cut, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = table(spark, sf_dir, "silver")
    return together.pair_counts(silver, "invoice_id", together.clean_item("product_id"), least_pair=5, least_share=500)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = together.strong_pairs(_pairs(spark, sf_dir))
    return strong.select(F.col("item_a").alias("product_id_a"), F.col("item_b").alias("product_id_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of products, however rare."""
    pairs = together.pair_counts(table(spark, sf_dir, "silver"), "invoice_id", together.clean_item("product_id"))
    return pairs.select("item_a", "item_b", "n_together", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicate_arrivals(table(spark, sf_dir, "intake_result"), table(spark, sf_dir, "workbook"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arrival with the first arrival that brought the same set of rows."""
    return history.arrival_sets(table(spark, sf_dir, "intake_result"), table(spark, sf_dir, "workbook"))[0]


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens as placed, with what is wrong about its pieces and their containers (0: nothing)."""
    packed = cut(packing.pack_documents(table(spark, sf_dir, "documents")))
    filled = packed.groupBy("container_id").agg((F.sum("n_tokens") > packing.CAPACITY).cast("int").alias("over"))
    placed = packed.join(filled, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"), F.sum("over").alias("n_over"))
    sizes = encoding.encode_documents(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("_doc"), F.size("ids").alias("_n"))
    joined = placed.join(sizes, F.col("doc_id").eqNullSafe(F.col("_doc")), "full_outer")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("_n") / packing.CAPACITY))
    wrong = F.when(F.col("doc_id").isNull() | F.col("_n").isNull() | (F.col("n_tokens") != F.col("_n")) | (F.col("n_pieces") != pieces) | (F.col("n_over") > 0), 1).otherwise(0)
    return joined.select(F.coalesce("doc_id", "_doc").alias("doc_id"), wrong.alias("wrong"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= harm.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harm.source_rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p4_found, p4_pairs, p5_found, p5_members, p8_ids, p9_containers, p9_fill, p10_found, p10_scores, p10_rates)}

_BASKETS = """
WITH members AS (
  SELECT DISTINCT invoice_id, upper(trim(product_id)) AS item FROM silver WHERE invoice_id IS NOT NULL AND trim(product_id) <> ''),
alone AS (SELECT item, COUNT(*) AS n FROM members GROUP BY ALL),
pairs AS (
  SELECT x.item AS item_a, y.item AS item_b, COUNT(*) AS n_together
  FROM members x JOIN members y ON x.invoice_id = y.invoice_id AND x.item < y.item GROUP BY ALL),
full_pairs AS (
  SELECT p.*, a.n AS n_a, b.n AS n_b, (SELECT COUNT(DISTINCT invoice_id) FROM silver) AS n_baskets
  FROM pairs p JOIN alone a ON a.item = item_a JOIN alone b ON b.item = item_b)
"""
ORACLE = {
    "p4_found": _BASKETS + """SELECT item_a AS product_id_a, item_b AS product_id_b FROM full_pairs
WHERE n_together >= 5 AND n_together * 500 >= n_baskets AND n_together * n_baskets >= 3 * n_a * n_b""",
    "p4_pairs": _BASKETS + """SELECT item_a, item_b, n_together, n_a, n_b,
ROUND(n_together / (CAST(n_a AS DOUBLE) * n_b / n_baskets), 6) AS lift FROM full_pairs""",
    "p5_found": """
WITH sets AS (
  SELECT DISTINCT source_file_id AS f, trim(Invoice) AS i, upper(trim(StockCode)) AS s, TRY_CAST(trim(Quantity) AS DOUBLE) AS q
  FROM workbook WHERE TRY_CAST(trim(Quantity) AS DOUBLE) IS NOT NULL),
sizes AS (SELECT f, COUNT(*) AS n FROM sets GROUP BY ALL),
common AS (
  SELECT a.f AS x, b.f AS y, COUNT(*) AS c FROM sets a JOIN sets b
  ON a.i IS NOT DISTINCT FROM b.i AND a.s IS NOT DISTINCT FROM b.s AND a.q = b.q AND a.f < b.f GROUP BY ALL),
near AS (SELECT x, y FROM common JOIN sizes p ON p.f = x JOIN sizes r ON r.f = y WHERE 5 * c >= 4 * (p.n + r.n - c)),
pairs AS (
  SELECT a.intake_id AS a, b.intake_id AS b FROM intake_result a JOIN intake_result b ON a.file_hash = b.file_hash
  UNION SELECT a.intake_id, b.intake_id FROM intake_result a JOIN intake_result b ON a.content_fingerprint = b.content_fingerprint
  UNION SELECT a.intake_id, b.intake_id FROM near JOIN intake_result a ON a.file_hash = x JOIN intake_result b ON b.file_hash = y)
SELECT DISTINCT LEAST(a, b) AS intake_id_a, GREATEST(a, b) AS intake_id_b FROM pairs WHERE a <> b""",
    "p5_members": """
WITH sets AS (
  SELECT DISTINCT source_file_id AS f, trim(Invoice) AS i, upper(trim(StockCode)) AS s, TRY_CAST(trim(Quantity) AS DOUBLE) AS q
  FROM workbook WHERE TRY_CAST(trim(Quantity) AS DOUBLE) IS NOT NULL),
whole AS (SELECT f, list_sort(list({'i': i, 's': s, 'q': q})) AS rows FROM sets GROUP BY f)
SELECT intake_id, MIN(intake_id) OVER (PARTITION BY rows) AS node FROM intake_result JOIN whole ON f = file_hash""",
    "p9_fill": "SELECT doc_id, 0 AS wrong FROM documents",
}
