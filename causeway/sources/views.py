"""Market views over the star-schema tables, as DataFrames and as the equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

KEYS = ["symbol"]
ORDER = ["ts", "seq"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints of eight symbols; seq orders the prints of a symbol, and notional_c is in whole cents."""
    line = load(spark, sf_dir, "lineitem")
    symbol = F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string"))
    order = Window.partitionBy("symbol").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return line.withColumn("symbol", symbol).select(
        "symbol",
        F.col("l_shipdate").alias("ts"),
        F.row_number().over(order).cast("long").alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("notional_c"),
        F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("N").alias("side"),
        F.to_date("l_shipdate").alias("day"),
    )


def tape_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tape within the day, from events."""
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        (1 + F.col("event_id") % 20).cast("double").alias("size"),
        F.when(kind.isin("purchase", "signup"), "A").when(kind.isin("click", "error"), "B").otherwise("N").alias("side"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("us"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, high, low, close and volume of each symbol and day."""
    return (
        tape(spark, sf_dir).groupBy("symbol", "day").agg(
            F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"), F.sum("size").alias("volume"),
        )
    )


def ext_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second calendar: index level, volatility index and put/call ratio by day."""
    day = F.to_date("o_orderdate").alias("day")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    mean = cents.cast("double") / F.count("*").cast("double") / 100.0
    return load(spark, sf_dir, "orders").groupBy(day).agg(mean.alias("index_close"), (F.lit(10.0) + mean / 10000.0).alias("vix"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled events, on first and fifteenth days: day, type by priority, and magnitude."""
    p = F.col("o_orderpriority")
    pick = lambda *v: F.when(p.startswith("1"), v[0]).when(p.startswith("2"), v[1]).when(p.startswith("3"), v[2]).otherwise(v[3])
    return (
        load(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate").isin(1, 15))
        .select(F.to_date("o_orderdate").alias("event_day"), pick("FOMC", "CPI", "NFP", "OpEx").alias("event_type"), pick(1.0, 0.8, 0.7, 0.6).alias("magnitude"))
        .distinct()
    )


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chain rows: strike, type, greeks and open interest by symbol and day."""
    line = load(spark, sf_dir, "lineitem")
    return line.select(
        F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("day"),
        F.col("l_partkey").alias("strike"), F.when(F.col("l_linestatus") == "O", " Call").otherwise("PUT ").alias("type"),
        F.col("l_discount").alias("gamma"), F.col("l_tax").alias("vanna"), (F.col("l_discount") - F.col("l_tax")).alias("charm"),
        F.col("l_quantity").alias("open_interest"),
        F.concat(F.lit("LOZ3 "), F.when(F.col("l_linestatus") == "O", "C").otherwise("P"), F.col("l_partkey").cast("string")).alias("option"),
        F.when(F.col("l_linenumber") % 2 == 0, 6).otherwise(3).alias("stat_type"),
    )


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book snapshots of five levels, from the vectors."""
    v = F.col("embedding").cast("array<double>")
    size = lambda lo: F.transform(F.slice(v, lo, 5), lambda x: F.abs(x) + 0.01)
    price = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.lit(100.0) + sign * 0.05 * i)
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("symbol"), F.col("vec_id").alias("seq"),
        size(1).alias("bid_sizes"), size(6).alias("ask_sizes"), price(-1).alias("bid_prices"), price(1).alias("ask_prices"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: strategy, dates, profit in per mille and the reason of the exit."""
    line = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.sum(F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long")) / F.count("*") / 100.0).alias("pnl_pct")
    )
    order = load(spark, sf_dir, "orders")
    reason = F.when(F.col("o_orderstatus") == "F", "tp").when(F.col("o_orderstatus") == "O", "sl").otherwise("time_stop")
    return order.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("signal_id"), F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("entry_day"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")).alias("exit_day"), "pnl_pct", reason.alias("exit_reason"),
        (F.col("o_totalprice") / 1e7).alias("risk"),
    )


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility regime of each signal that has one: those of settled orders."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        k.alias("signal_id"), F.to_date("o_orderdate").alias("as_of_day"),
        F.when(k % 7 < 2, "low").when(k % 7 < 5, "normal").otherwise("high").alias("vol_regime"),
        F.when(k % 2 == 0, "realised").otherwise("implied").alias("regime_method"),
    )


#: The same views in DuckDB SQL, each after those it reads.
SQL = {
    "tape": """select symbol, l_shipdate as ts,
      row_number() over (partition by symbol order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq,
      l_extendedprice / l_quantity as price, l_quantity as size, cast(round(l_extendedprice * 100) as bigint) as notional_c,
      case l_returnflag when 'A' then 'A' when 'R' then 'B' else 'N' end as side, cast(l_shipdate as date) as day
      from (select *, 'S' || cast(l_suppkey % 8 as varchar) as symbol from lineitem)""",
    "tape_ev": """select 'E' || cast(user_id % 4 as varchar) as symbol, ts, event_id as seq, 100.0::double + value as price,
      cast(1 + event_id % 20 as double) as size,
      case when event_type in ('purchase', 'signup') then 'A' when event_type in ('click', 'error') then 'B' else 'N' end as side,
      epoch_us(ts) as us from events""",
    "daily": """select symbol, day, min_by(price, seq) as open, max(price) as high, min(price) as low, max_by(price, seq) as close,
      sum(size) as volume from tape group by symbol, day""",
    "ext_daily": """select cast(o_orderdate as date) as day,
      cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / 100.0::double as index_close,
      10.0::double + cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / cast(count(*) as double) / 100.0::double / 10000.0::double as vix
      from orders group by 1""",
    "calendar": """select distinct cast(o_orderdate as date) as event_day,
      case left(o_orderpriority, 1) when '1' then 'FOMC' when '2' then 'CPI' when '3' then 'NFP' else 'OpEx' end as event_type,
      cast(case left(o_orderpriority, 1) when '1' then 1.0 when '2' then 0.8 when '3' then 0.7 else 0.6 end as double) as magnitude
      from orders where day(o_orderdate) in (1, 15)""",
    "chain": """select 'S' || cast(l_suppkey % 8 as varchar) as symbol, cast(l_shipdate as date) as day, l_partkey as strike,
      case l_linestatus when 'O' then ' Call' else 'PUT ' end as type, l_discount as gamma, l_tax as vanna,
      l_discount - l_tax as charm, l_quantity as open_interest,
      'LOZ3 ' || case l_linestatus when 'O' then 'C' else 'P' end || cast(l_partkey as varchar) as option,
      case when l_linenumber % 2 = 0 then 6 else 3 end as stat_type from lineitem""",
    "book": """select 'L' || cast(label as varchar) as symbol, vec_id as seq,
      list_transform(embedding[1:5], lambda x: abs(cast(x as double)) + 0.01::double) as bid_sizes,
      list_transform(embedding[6:10], lambda x: abs(cast(x as double)) + 0.01::double) as ask_sizes,
      list_transform(range(1, 6), lambda i: 100.0::double - 0.05::double * i) as bid_prices,
      list_transform(range(1, 6), lambda i: 100.0::double + 0.05::double * i) as ask_prices from embeddings""",
    "trades": """select o_orderkey as signal_id, o_orderpriority as strategy, cast(o_orderdate as date) as entry_day,
      cast(o_orderdate as date) + cast(o_orderkey % 30 as integer) as exit_day, pnl_pct,
      case o_orderstatus when 'F' then 'tp' when 'O' then 'sl' else 'time_stop' end as exit_reason, o_totalprice / 1e7 as risk
      from orders join (select l_orderkey,
        cast(sum(cast(round((l_discount - l_tax) * 100) as bigint)) as double) / count(*) / 100.0::double as pnl_pct
        from lineitem group by 1) on o_orderkey = l_orderkey""",
    "regimes": """select o_orderkey as signal_id, cast(o_orderdate as date) as as_of_day,
      case when o_orderkey % 7 < 2 then 'low' when o_orderkey % 7 < 5 then 'normal' else 'high' end as vol_regime,
      case when o_orderkey % 2 = 0 then 'realised' else 'implied' end as regime_method from orders where o_orderstatus <> 'P'""",
}
NEEDS = {"daily": ["tape"]}


def with_views(*names: str) -> str:
    """The head of a SQL query that reads these views: 'with ..., '."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in wanted)


def sql_snap(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5::double) / 1e{digits}"
