"""Window operators. Global windows only ever see a handful of rows already cut by a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """One row per key, carrying the value of the greatest ``seq``.

    ``max_by`` combines map-side, so a key holding many rows is no bottleneck.
    """
    newest = F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))
    return df.groupBy(key).agg(newest.alias("newest")).select(
        key, F.col("newest.v").alias(value)
    )


def latest_landed(registry: DataFrame) -> DataFrame:
    """Newest landed row per dataset; of equal stamps the later inserted row."""
    rest = [c for c in registry.columns if c not in ("dataset", "uploaded_at", "seq")]
    newest = F.max_by(F.struct("uploaded_at", "seq", *rest), F.struct("uploaded_at", "seq"))
    landed = registry.filter(
        (F.col("pipeline_status") == "landed") & (F.coalesce("dataset", F.lit("")) != "")
    )
    return landed.groupBy("dataset").agg(newest.alias("row")).select("dataset", "row.*")


def concentration_top3_of_top10(merchants: DataFrame) -> DataFrame:
    """Share of the three largest merchants in the ten largest, by amount, in percent."""
    top = merchants.select("total_amount_ugx", "merchant_id").orderBy(
        F.col("total_amount_ugx").desc_nulls_last(), "merchant_id"
    ).limit(10)
    order = Window.orderBy(F.col("total_amount_ugx").desc_nulls_last(), "merchant_id")
    ranked = top.withColumn("rnk", F.row_number().over(order))
    head = F.sum(F.when(F.col("rnk") <= 3, F.col("total_amount_ugx")).otherwise(0))
    return ranked.agg(
        F.round(
            (head * 100).cast("double")
            / F.nullif(F.sum("total_amount_ugx").cast("double"), F.lit(0.0)),
            2,
        ).alias("pct_top3_of_top10")
    )


def share_of_total(points: DataFrame, slices: int = 10) -> DataFrame:
    """Pie slices of charted (ord, label, value) rows: share, start and end fraction."""
    everything = Window.partitionBy()
    total = F.sum("value").over(everything)
    total = F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(total)
    until = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = points.withColumn("share", F.col("value") / total)
    before = F.lag("share_end").over(Window.orderBy("ord"))
    return (
        shared.withColumn("share_end", F.sum("share").over(until))
        .withColumn("share_start", F.coalesce(before, F.lit(0.0)))
        .filter(F.col("ord") < slices)
        .select("ord", "label", "value", "share", "share_start", "share_end")
    )


def scale_to_max(points: DataFrame, value: str = "value") -> DataFrame:
    """Value over the largest charted value, which counts as at least 1."""
    peak = F.greatest(F.lit(1.0), F.max(value).over(Window.partitionBy()))
    return points.withColumn("scaled", F.col(value) / peak)


def ranked(df: DataFrame, k: int, key: Column, *order: Column) -> DataFrame:
    """Top ``k`` rows per group as ``ord`` 1..k; Spark cuts each partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("ord", rank).filter(F.col("ord") <= k)
