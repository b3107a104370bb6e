"""Set metrics of a result against the truth, and errors of estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(part: str, whole: str) -> Column:
    """part / whole, 1 where whole is 0."""
    return F.coalesce(F.col(part).cast("double") / F.nullif(F.col(whole), F.lit(0)), F.lit(1.0))


def confusion(result: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn by the columns `by`: rows in both, in the result only, in the truth only. One join of the two sets."""
    by = by or []
    on = [*by, *keys]
    r = result.select(*on).distinct().withColumn("in_result", F.lit(1))
    t = truth.select(*on).distinct().withColumn("in_truth", F.lit(1))
    marks = r.join(t, on, "full").select(*by, F.coalesce("in_result", F.lit(0)).alias("r"), F.coalesce("in_truth", F.lit(0)).alias("t"))
    sums = [F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(n) for n, e in (("tp", F.col("r") * F.col("t")), ("fp", F.col("r") * (1 - F.col("t"))), ("fn", (1 - F.col("r")) * F.col("t")))]
    return marks.groupBy(*by).agg(*sums)


def precision_recall(result: DataFrame, truth: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """confusion with precision, recall (1 where there is nothing to divide by) and f1 (0 without true positives)."""
    c = confusion(result, truth, keys, by).withColumn("found", F.col("tp") + F.col("fp")).withColumn("real", F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", _share("tp", "found")).withColumn("recall", _share("tp", "real"))
    f1 = 2.0 * F.col("tp") / (F.col("found") + F.col("real"))
    return c.withColumn("f1", F.when(F.col("tp") > 0, f1).otherwise(0.0)).drop("found", "real")


def restricted_confusion(result: DataFrame, truth: DataFrame, tumbling_truth: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn where a hit of the truth counts only if the tumbling truth has it as well, and is no false positive otherwise."""
    r = result.select(*keys).distinct()
    real = r.join(truth.select(*keys).distinct(), keys, "left_semi")
    tp = real.join(tumbling_truth.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("tp"))
    fp = r.join(truth.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("fp"))
    fn = truth.select(*keys).distinct().join(r, keys, "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    return tp.crossJoin(fp).crossJoin(fn)  # one row each


def average_relative_error(estimates: DataFrame, estimate: str, truth: str, by: list[str] | None = None) -> DataFrame:
    error = F.avg(F.abs(F.col(estimate) - F.col(truth)).cast("double") / F.col(truth))
    return estimates.groupBy(*(by or [])).agg(error.alias("are"))


def relative_error(estimate: str, truth: str) -> Column:
    return F.abs(F.col(estimate) - F.col(truth)).cast("double") / F.col(truth)


def pivoted(rows: DataFrame, by: str, column: str, values: list[str], measures: list[str]) -> DataFrame:
    """A row for each `by` and a column measure_value for each measure and value of `column`, rounded; null where there is none."""
    cells = [F.max(F.when(F.col(column) == v, F.round(m, 6))).alias(f"{m}_{v}") for m in measures for v in values]
    return rows.groupBy(by).agg(*cells)


def write_report(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header, N/A where there is no value."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in table.columns]
    table.select(*text).coalesce(1).write.mode("overwrite").csv(path, header=True)
