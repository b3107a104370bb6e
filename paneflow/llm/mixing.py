"""Mixing sources to target weights, in DataFrame operations only (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Most times that a document is taken.
MOST = 3
#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Sources whose targets are broadcast at most, some MB; more are joined in SALTS parts each.
BROADCAST, SALTS = 50_000, 32


def word_count(text: Column) -> Column:
    """Number of words, maximal runs of other than the six ASCII white-space characters; 0 for null."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit("\t\n\x0b\x0c\r "))), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source of sized (source, size).

    The sources share the total by weight; a share stops at `most` times the source's size and the excess goes to the
    rest by weight. That is one level for all: with the sources in the order of cap by weight, the level is the first
    at which the rest can hold what those before leave. One row a source is sorted in one task, and no documents.
    """
    whole = W.partitionBy()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    ranked = by_source.select("source", "source_size", rank.alias("rank"), weight.cast("long").alias("weight"), cap.alias("cap"))
    order = (F.col("cap") / F.col("weight"), F.col("rank"))
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levels = ranked.select("*", left.alias("left"), F.sum("weight").over(after).alias("rest"))
    holds = F.col("left") * F.col("weight") <= F.col("cap") * F.col("rest")
    level = F.max(F.when(holds, F.col("left").cast("double") / F.col("rest"))).over(whole)
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _with_targets(rows: DataFrame, docs: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """rows (source, draw, ...) with source_size, target and copies.

    The targets are worked out first and counted: few are broadcast, so that no document is shuffled; of many, a source's rows
    are dealt in parts by their draw.
    """
    targets = cut(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, most)).withColumnRenamed("source", "target_source")
    same = rows["source"].eqNullSafe(targets["target_source"])
    if targets.count() <= BROADCAST:
        joined = rows.join(F.broadcast(targets), same, "left")
    else:
        part = F.floor(F.col("draw") * SALTS).cast("int")
        parts = targets.withColumn("target_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(parts, same & (part == F.col("target_part")), "left").drop("target_part")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.least(F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0), F.lit(most)).cast("long")
    return joined.drop("target_source").withColumn("copies", copies)


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source) with size, draw, source_size, target and copies.

    A document is taken floor(rate) times, and once more with the rate's fraction as probability, where rate is its
    source's target by its size. The draw is a hash of seed and doc_id, so reruns agree and rows that repeat a doc_id
    fall alike; for a null doc_id the text is hashed. Null texts have no words; a null source is a source.
    """
    rows = docs.select("doc_id", "text", "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"))
    return _with_targets(rows, docs, weights, most)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as many times as the mixture takes it, with all their columns.

    docs needs doc_id, text and source. Copies are decided as in with_copies. An empty table gives an empty table; in a
    corpus without any word nothing is taken.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", _draw(seed).alias("draw"))
    taken = _with_targets(rows, docs, weights, most).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _draw(seed: str) -> Column:
    """A number from 0 to below 1 for each document."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("none")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, 'none')), 1, 13))::BIGINT / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), r AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
    CAST(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM r
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(CASE WHEN remaining * weight <= cap * rest THEN CAST(remaining AS DOUBLE) / rest END) OVER () * weight) AS target FROM l
), c AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM c
"""
