"""Features of order-book snapshots, by array functions within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def book_features(book: DataFrame) -> DataFrame:
    """Mid, spread, imbalance; the share of each level in all size; distance of levels from mid in basis points; depth imbalance."""
    bid, ask = F.col("bid_sizes"), F.col("ask_sizes")
    mid = (F.element_at("bid_prices", 1) + F.element_at("ask_prices", 1)) / 2
    out = book.withColumn("mid", mid).withColumn("spread", F.element_at("ask_prices", 1) - F.element_at("bid_prices", 1))
    out = out.withColumn("all_size", total(F.concat(bid, ask)))
    return out.select(
        "*", ((total(bid) - total(ask)) / F.col("all_size")).alias("imbalance"),
        F.transform(F.concat(bid, ask), lambda v: v / F.col("all_size")).alias("profile"),
        F.transform(F.concat("bid_prices", "ask_prices"), lambda p: (p - F.col("mid")) / F.col("mid") * 1e4).alias("shape"),
        F.zip_with(bid, ask, lambda b, a: (b - a) / (b + a)).alias("depth"),
    )
