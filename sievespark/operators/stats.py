"""Descriptive statistics of measurements, and reports over sets and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population and sample deviation, extremes, the true median, and the values at n/2, n/20 and 19n/20 in order.

    The last three are taken by index, n/2 being the upper median. They are exact percentile aggregates over counted
    values, which combine before the shuffle.
    """
    v = F.col(value)
    # just above the share: the next value in order where n * share is whole
    at = lambda share, name: F.expr(f"percentile_disc({share} + 1e-12D) WITHIN GROUP (ORDER BY `{value}`)").alias(name)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.stddev_samp(v).alias("std_sample"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.median(v).alias("median"), at("0.5D", "upper_median"), at("0.05D", "p5"), at("0.95D", "p95"),
    )


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, by Abramowitz and Stegun's formula 7.1.26 (error below 1.5e-7)."""
    # The formula's coefficients.
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = 1 / (1 + p * x)
    return ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)


def welch(df: DataFrame, by: list[str], value: str, side: Column) -> DataFrame:
    """Welch's statistic of two samples (``side`` true and false) and its two-sided p by the normal law."""
    parts = []
    for name, cond in (("a", side), ("b", ~side)):
        v = F.when(cond, F.col(value))
        parts += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"var_{name}")]
    rows = df.groupBy(*by).agg(*parts)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return rows.select(*by, "n_a", "n_b", "mean_a", "mean_b", t.alias("t"), erfc(F.abs(t) / F.sqrt(F.lit(2.0))).alias("p"))


def _scaled(v: Column, steps: list[tuple[float, str, float]], rest: tuple[str, float]) -> Column:
    out = F.format_string(rest[0], v * rest[1])
    for least, pattern, factor in reversed(steps):
        out = F.when(v >= least, F.format_string(pattern, v * factor)).otherwise(out)
    return F.when(v.isNotNull(), out)


def format_qps(v: Column) -> Column:
    return _scaled(v, [(1e6, "%.1fM", 1e-6), (1e3, "%.0fK", 1e-3)], ("%.0f", 1.0))


def format_seconds(v: Column) -> Column:
    return _scaled(v, [(60, "%.1fmin", 1 / 60), (1, "%.1fs", 1.0), (1e-3, "%.1fms", 1e3)], ("%.0fus", 1e6))


def format_bytes(v: Column) -> Column:
    return _scaled(v, [(1e9, "%.1fGB", 1e-9), (1e6, "%.1fMB", 1e-6), (1e3, "%.1fKB", 1e-3)], ("%.0fB", 1.0))


#: Bounds of the density classes of tags.
DENSITIES = [("rare", 0.0, 0.001), ("uncommon", 0.001, 0.01), ("medium", 0.01, 0.10), ("common", 0.10, 0.50), ("dominant", 0.50, 1.01)]
#: The selectivity classes of queries, which overlap; the first that fits counts.
SELECTIVITIES = [("0.1%", 0.0, 0.005), ("1%", 0.005, 0.05), ("5%", 0.03, 0.08), ("10%", 0.05, 0.15), ("20%", 0.15, 0.30), ("50%", 0.30, 0.60), (">50%", 0.60, 1.01)]


def classed(v: Column, classes: list[tuple[str, float, float]]) -> Column:
    """The first class whose half-open range holds the value."""
    return F.coalesce(*[F.when((v >= low) & (v < high), F.lit(name)) for name, low, high in classes])


def density_report(tags: DataFrame, universe: int) -> DataFrame:
    """(bucket, n_tags, bytes, flat_bytes, compression, avg_seconds) of tags (n_containers, n_bitmap, cardinality, seconds) by density;
    ``seconds`` is what building the tag took."""
    bucket = classed(F.col("cardinality") / universe, DENSITIES)
    size = F.col("n_bitmap") * 8192 + F.col("n_containers") * 9
    flat = -(-universe // 32) * 4
    rows = tags.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_tags"), F.sum(size).cast("long").alias("bytes"), (F.count(F.lit(1)) * flat).alias("flat_bytes"), F.avg("seconds").alias("avg_seconds"))
    return rows.withColumn("compression", F.col("flat_bytes") / F.greatest("bytes", F.lit(1)))


def build_report(runs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, builds, avg_seconds, most_seconds, index_bytes, flat_bytes, compression) of builds (seconds, index_bytes, flat_bytes)."""
    rows = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("builds"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("most_seconds"), F.sum("index_bytes").alias("index_bytes"), F.sum("flat_bytes").alias("flat_bytes")
    )
    return rows.withColumn("compression", F.col("flat_bytes") / F.when(F.col("index_bytes") > 0, F.col("index_bytes")))


def zipf_densities(spark, n: int, alpha: float, high: float = 0.80, low: float = 0.0001) -> DataFrame:
    """(rank, density): weights rank**-alpha, stretched so that the first has ``high`` and the last ``low``."""
    last = float(n) ** -alpha
    weight = F.pow(F.col("rank").cast("double"), F.lit(-alpha))
    return spark.range(1, n + 1).select(F.col("id").alias("rank")).withColumn("density", low + (high - low) * (weight - last) / (1 - last))


def projected_memory(measured: DataFrame, counts: list[int], universe: int) -> DataFrame:
    """(n_tags, flat_bytes, packed_bytes, ratio) of tag counts, from classes (share, ratio): tags of a class are floored."""
    flat = -(-universe // 8)
    rows = measured.select("share", "ratio", F.explode(F.array(*[F.lit(n) for n in counts])).alias("n_tags"))
    each = F.floor(F.floor(F.col("n_tags") * F.col("share") + 1e-9) * flat / F.col("ratio"))
    out = rows.groupBy("n_tags").agg(F.sum(each).cast("long").alias("packed_bytes")).withColumn("flat_bytes", F.col("n_tags").cast("long") * flat)
    return out.select("n_tags", "flat_bytes", "packed_bytes", (F.col("flat_bytes") / F.col("packed_bytes")).alias("ratio"))


def verdict(ratio: Column) -> Column:
    """Which form answers faster: a ratio below 1 is the packed one's, below 1.1 a tie."""
    return F.when(ratio < 1.0, F.lit("PACKED")).when(ratio < 1.1, F.lit("TIE")).otherwise(F.lit("FLAT"))
