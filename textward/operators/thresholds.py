"""All thresholds at once: what each score would block, from one sort, and the area under the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.functions.columns import col
from textward.streaming.table import folder


def sweep(scored: DataFrame, score: str = "score", label: str = "label", parts: int | None = None) -> DataFrame:
    """For each different score as a threshold (blocked: at or above it): threshold, tp, fp, fn, tn, precision, recall, f1, best, auc.

    Scores are counted first, so ties are one step. Then running sums without a window over all: the steps are
    range-partitioned, counted by partition, and each partition's sums begin with what those above it have in all. ``best``
    marks the thresholds of the largest f1; ``auc`` is that of the ROC curve, exact for ties, null with labels of one kind
    alone. Rows without a score or a label don't count; labels are booleans or numbers, true if not 0.
    """
    spark = scored.sparkSession
    rows = scored.select(col(score).cast("double").alias("threshold"), (col(label).cast("double") != 0).alias("y")).filter("threshold is not null and y is not null")
    steps = rows.groupBy("threshold").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    order = F.desc("threshold")
    steps = steps.repartitionByRange(parts, order) if parts else steps.repartitionByRange(order)
    at = folder(spark) + "/steps"
    steps.sortWithinPartitions(order).withColumn("part", F.spark_partition_id()).write.parquet(at)
    steps = spark.read.parquet(at)
    sums = steps.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))  # a row for each partition
    above = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    all_ = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select("part", zero(F.sum("sp").over(above)).alias("p0"), zero(F.sum("sn").over(above)).alias("n0"), F.sum("sp").over(all_).alias("pos"), F.sum("sn").over(all_).alias("neg"))
    own = W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = steps.withColumns({"cp": F.sum("p").over(own), "cn": F.sum("n").over(own)}).join(F.broadcast(sums), "part")
    run = run.withColumns({"tp": F.col("p0") + F.col("cp"), "fp": F.col("n0") + F.col("cn")})
    # twice the area, in whole numbers: each step's negatives times the positives before and after it
    area = F.sum((F.col("n") * (2 * F.col("tp") - F.col("p"))).cast("decimal(38,0)"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    area, top = run.agg(area, F.max(f1)).first()  # two numbers
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.lit(area).cast("double") / (2.0 * F.col("pos") * F.col("neg")))
    recall = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos"))
    return run.select("threshold", "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"), f1.alias("f1"), (f1 == F.lit(top)).alias("best"), auc.alias("auc"))
