"""Falsification: control runs that must find nothing, and the summary that tells them from real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def shuffled(df: DataFrame, columns: list[str], keys: list[str], order: list[str], seed: int) -> DataFrame:
    """``columns`` dealt out anew among a key's rows: marginals stay, alignment in time goes."""
    lead = [*keys, "_nth"]
    by_time = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    draw = F.xxhash64(F.lit(seed), *order)
    by_draw = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(draw, *order))).select(*lead, *columns)
    return by_time.drop(*columns).join(by_draw, lead).select(*df.columns)


def noise(df: DataFrame, columns: list[str], order: list[str], seed: int) -> DataFrame:
    """``columns`` replaced by standard normal draws that depend on seed and order alone, by Box and Muller."""
    out = df
    for i, c in enumerate(columns):
        unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(k), *order), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        out = out.withColumn(c, F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * 3.141592653589793 * unit(1)))
    return out


def summary(runs: DataFrame, value: str = "sharpe", tolerance: float = 0.05) -> DataFrame:
    """By mode: mean, deviation and largest absolute value; whether it parts from the real runs; the leakage gate."""
    s = runs.groupBy("null_mode").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.max(F.abs("oos_corr")).alias("worst_corr"))
    real = s.where("null_mode = 'none'").select(F.col("mean").alias("rm"), F.col("sd").alias("rs"), F.col("n").alias("rn"))
    both = s.crossJoin(F.broadcast(real))
    apart = F.abs(F.col("mean") - F.col("rm")) > 2 * F.sqrt(F.pow("sd", 2) / F.col("n") + F.pow("rs", 2) / F.col("rn"))
    leak = (F.col("null_mode") == "shuffle_target") & (F.col("worst_corr") > tolerance)
    return both.select("null_mode", "n", "mean", "sd", "worst_corr", apart.alias("separable"), leak.alias("leaks"))
