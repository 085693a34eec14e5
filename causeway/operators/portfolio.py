"""Trades to portfolio figures: attribution by regime, scorecards, health, exits, weights and stress."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from causeway.functions.columns import frame, normal_cdf, ordered, snap
from causeway.operators.asof import as_of


def attribution(trades: DataFrame) -> DataFrame:
    """Profit by strategy and regime, by regime, and in all, in one rollup pass; level 0, 1 and 2."""
    named = trades.select(F.col("vol_regime"), F.col("strategy"), "pnl_pct", "risk")
    return named.rollup("vol_regime", "strategy").agg(
        F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"), F.sum("pnl_pct").alias("total"), F.avg("pnl_pct").alias("mean"),
        F.avg((F.col("pnl_pct") > 0).cast("double")).alias("win_rate"), F.avg("risk").alias("mean_risk"), F.min("pnl_pct").alias("worst"), F.max("pnl_pct").alias("best"),
    )


def profit_factor(pnl: Column) -> Column:
    """Gains over losses; null without losses."""
    return F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) / F.nullif(-F.sum(F.when(pnl < 0, pnl).otherwise(0.0)), F.lit(0.0))


def scorecard(trades: DataFrame, recent: int = 20, breakeven: float = 0.5) -> DataFrame:
    """Each strategy's trailing trades: win rate, profit factor, loss streak, Sharpe and Sortino a year, and health.

    Critical: a streak of five losses, or the last four rolling win rates all below ``breakeven``.
    """
    keys = ["strategy"]
    newest = F.row_number().over(ordered(keys, [F.desc("exit_day"), F.desc("signal_id")]))
    span = trades.groupBy("strategy").agg(
        F.count("*").alias("n_trades"), F.datediff(F.max("exit_day"), F.min("exit_day")).alias("days")
    ).withColumn("per_year", F.when(F.col("days") > 0, F.col("n_trades") / (F.col("days") / 365.25)).otherwise(48.0))
    p = F.col("pnl_pct")
    rate = F.avg((p > 0).cast("double")).over(frame(keys, ["exit_day", "signal_id"], 1 - recent, 0))
    ranked = trades.withColumn("wr", rate).withColumn("nth", newest)
    last = ranked.where(F.col("nth") <= recent).groupBy("strategy").agg(
        F.avg((p > 0).cast("double")).alias("win_rate"), profit_factor(p).alias("profit_factor"), F.avg("pnl_pct").alias("mean"),
        F.stddev_samp("pnl_pct").alias("sd"), F.sqrt(F.avg(F.pow(F.least(p, F.lit(0.0)), 2))).alias("down"),
        F.when(F.count_if(F.col("nth") <= 4) == 4, F.max(F.when(F.col("nth") <= 4, F.col("wr")))).alias("last4"),
        # the slope over time: newest is 1, so the sign turns
        (-F.regr_slope((p > 0).cast("double"), F.col("nth"))).alias("trend"),
    )
    streak = ranked.groupBy("strategy").agg((F.coalesce(F.min(F.when(p > 0, F.col("nth"))), F.count("*") + 1) - 1).cast("long").alias("streak"))
    out = span.join(last, "strategy").join(streak, "strategy")
    year = F.sqrt("per_year")
    out = out.withColumn("sharpe", F.try_divide(F.col("mean"), F.nullif("sd", F.lit(0.0))) * year).withColumn(
        "sortino", F.try_divide(F.col("mean"), F.nullif("down", F.lit(0.0))) * year
    )
    status = (
        F.when((F.col("streak") >= 5) | (F.col("last4") < breakeven), "CRITICAL")
        .when((F.col("sharpe") < 0.5) | (F.col("trend") < 0), "WARNING").otherwise("HEALTHY")
    )
    return out.withColumn("status", status)


def alpha_stats(weekly: DataFrame, keys: list[str], strat: str, bench: str) -> DataFrame:
    """Weekly alpha (x 52), beta and information ratio against a benchmark; nothing below 13 weeks."""
    both = weekly.where(F.col(strat).isNotNull() & F.col(bench).isNotNull())
    fit = both.groupBy(*keys).agg(
        F.count("*").alias("weeks"), F.regr_slope(strat, bench).alias("beta"), F.avg(strat).alias("ms"), F.avg(bench).alias("mb"),
        F.avg(F.col(strat) - F.col(bench)).alias("active"), F.stddev_samp(F.col(strat) - F.col(bench)).alias("track"),
    ).where("weeks >= 13")
    return fit.withColumn("alpha", (F.col("ms") - F.col("beta") * F.col("mb")) * 52).withColumn(
        "info_ratio", F.try_divide(F.col("active"), F.nullif("track", F.lit(0.0))) * F.sqrt(F.lit(52.0))
    )


def inverse_vol_weights(returns: DataFrame, key: str, ret: str) -> DataFrame:
    """Weights in proportion to the inverse of each key's sample deviation; keys are few against rows."""
    sd = returns.groupBy(key).agg(F.stddev_samp(ret).alias("sd")).withColumn("inv", 1.0 / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9))
    return sd.crossJoin(F.broadcast(sd.agg(F.sum("inv").alias("all_inv")))).select(key, (F.col("inv") / F.col("all_inv")).alias("weight"))


def kelly(win_rate: Column, odds: Column, fraction: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), fraction * (odds * win_rate - (1 - win_rate)) / odds)


def regime_scale(regime: Column) -> Column:
    return F.when(regime == "low", 1.0).when(regime == "normal", 0.75).when(regime == "high", 0.5).otherwise(0.75)


def exits(trades: DataFrame, path: DataFrame, take: float, stop: float, most_rows: int) -> DataFrame:
    """The first row of the price path after entry that takes profit, stops a loss, or is the last allowed, in that order.

    ``path``: symbol, day, close. Without a later row the trade ends as end_of_data or, with no price at all, as no_data.
    """
    t = trades.select("signal_id", "symbol", "entry_day")
    numbered = path.withColumn("rn", F.row_number().over(ordered(["symbol"], ["day"])))
    begun = as_of(t.withColumn("day", F.col("entry_day")), {"hit": (numbered, ["rn", "close"])}, ["symbol"], "day", forward=True).where("hit is not null")
    # each trade asks for its own rows by number: an equi-join of ``most_rows`` rows a trade, however far apart the days
    asked = begun.select("signal_id", "symbol", F.col("hit.close").alias("entry"), F.posexplode(F.sequence("hit.rn", F.col("hit.rn") + most_rows)).alias("step", "rn"))
    stepped = asked.join(numbered, ["symbol", "rn"])
    move = F.col("close") / F.col("entry") - 1
    why = F.when(move >= take, "tp").when(move <= -stop, "sl").when(F.col("step") == most_rows, "time_stop")
    marked = stepped.withColumn("move", move).withColumn("why", F.when(F.col("step") > 0, why))
    done = marked.groupBy("signal_id").agg(
        F.min_by(F.struct("day", "move", "why"), F.when(F.col("why").isNotNull(), F.col("step"))).alias("hit"),
        F.max_by(F.struct("day", "move"), "step").alias("last"), F.max("step").alias("steps"),
    )
    return t.join(done, "signal_id", "left").select(
        "signal_id", F.coalesce("hit.day", "last.day").alias("exit_day"), F.coalesce("hit.move", "last.move").alias("move"),
        F.when(F.col("steps").isNull(), "no_data").otherwise(F.coalesce("hit.why", F.lit("end_of_data"))).alias("why"),
    )


#: Fixed values. Scenarios: name, volatility multiplier, cut of the win rate, shock to equity, trades, regime.
SCENARIOS = [
    ("covid_crash_2020", 3.5, 0.20, -0.08, 8, "high"),
    ("rate_hike_2022", 2.0, 0.12, -0.04, 25, "high"),
    ("volmageddon_2018", 4.0, 0.25, -0.12, 5, "high"),
    ("flash_crash_2010", 3.0, 0.15, -0.06, 3, "high"),
    ("gfc_2008", 4.0, 0.30, -0.15, 30, "high"),
    ("mild_correction", 1.5, 0.05, -0.02, 10, "normal"),
]
#: The scenarios of a run before release.
RELEASE_SCENARIOS = [
    ("covid_crash_2020", 3.5, 0.20, -0.08, 15, "high"),
    ("negative_oil_2020", 5.0, 0.25, -0.10, 10, "high"),
    ("volmageddon_2018", 4.0, 0.25, -0.12, 5, "high"),
    ("gfc_2008", 4.0, 0.30, -0.15, 30, "high"),
    ("flash_crash_2010", 3.0, 0.15, -0.06, 3, "high"),
    ("rate_shock_2022", 2.0, 0.12, -0.04, 25, "high"),
]


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts: the same wherever and whenever it is drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def stress(trades: DataFrame, scenarios=SCENARIOS, risk: float = 0.01, ruin: float = -0.5) -> DataFrame:
    """Each strategy's equity through each scenario: a shock, then trades drawn from its own.

    A draw is a winner with the strategy's win rate less the scenario's cut, 5 % at least. Winners are divided by the
    volatility multiplier and losers multiplied, within [-1, 5]; the stake is ``risk`` of equity by the regime's scale.
    Draws come from digests of (scenario, strategy, draw), so each run draws the same. ``recovery`` counts trades from the
    deepest point until equity is whole again, -1 where it never is. ``sharpe`` and ``worst_day`` are those of the path's returns.
    """
    table = trades.sparkSession.createDataFrame(scenarios, "scenario string, vol double, cut double, shock double, n_trades int, regime string")
    rate = trades.groupBy("strategy").agg(F.avg((F.col("pnl_pct") > 0).cast("double")).alias("rate"), F.count_if(F.col("pnl_pct") > 0).alias("wins"), F.count_if(F.col("pnl_pct") <= 0).alias("losses"))
    # at most 90 draws a strategy; a draw names the trade it takes by its number among the strategy's winners or losers
    draw = rate.crossJoin(F.broadcast(table)).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("n_trades"))))
    u = lambda what: uniform(F.lit(what), "scenario", F.coalesce("strategy", F.lit("")), F.col("step").cast("string"))
    draw = draw.withColumn("won", (u("side") < F.greatest(F.lit(0.05), F.col("rate") - F.col("cut"))) & (F.col("wins") > 0))
    draw = draw.withColumn("place", F.floor(u("trade") * F.when(F.col("won"), F.col("wins")).otherwise(F.col("losses"))) + 1)
    own = trades.where("pnl_pct is not null").withColumn("won", F.col("pnl_pct") > 0)
    own = own.withColumn("place", F.row_number().over(ordered(["strategy", "won"], ["exit_day", "signal_id"])).cast("long"))
    own = own.select(F.col("strategy").alias("s"), F.col("won").alias("w"), F.col("place").alias("p"), "pnl_pct")
    got = draw.join(own, F.col("strategy").eqNullSafe(F.col("s")) & (F.col("won") == F.col("w")) & (F.col("place") == F.col("p")), "left")
    raw = F.when(F.col("won"), F.col("pnl_pct") / F.col("vol")).otherwise(F.coalesce("pnl_pct", F.lit(-0.3)) * F.col("vol"))
    got = got.withColumn("pnl", F.greatest(F.lit(-1.0), F.least(F.lit(5.0), raw)))
    stake = risk * regime_scale(F.col("regime"))
    # the stake keeps 1 + stake * pnl above 0; equities are put on a grid so that ties are ties
    through = (1 + F.col("shock")) * F.exp(F.sum(F.log(1 + stake * F.col("pnl"))).over(frame(["scenario", "strategy"], ["step"], None, 0)))
    steps = got.select("scenario", "strategy", "step", "n_trades", "pnl", snap(through, 9).alias("equity"))
    first = rate.crossJoin(F.broadcast(table)).select("scenario", "strategy", F.lit(0).alias("step"), "n_trades", F.lit(None).cast("double").alias("pnl"), snap(1 + F.col("shock"), 9).alias("equity"))
    peak = F.greatest(F.lit(1.0), F.max("equity").over(frame(["scenario", "strategy"], ["step"], None, 0)))
    path = steps.unionByName(first).withColumn("depth", snap(F.col("equity") / peak - 1, 9))
    # the first return is the shock itself
    before = F.coalesce(F.lag("equity").over(ordered(["scenario", "strategy"], ["step"])), F.lit(1.0))
    path = path.withColumn("ret", F.col("equity") / before - 1)
    deepest = F.min(F.struct("depth", "step")).over(frame(["scenario", "strategy"], ["step"], None, None))
    path = path.withColumn("low", deepest)
    back = F.min(F.when((F.col("step") >= F.col("low.step")) & (F.col("equity") >= 1), F.col("step") - F.col("low.step")))
    return path.groupBy("scenario", "strategy").agg(
        F.max("n_trades").alias("n_trades"), (F.max_by("equity", "step") - 1).alias("total"), F.min("depth").alias("max_drawdown"),
        (F.min("depth") > ruin).alias("survived"), F.min("pnl").alias("worst"), F.coalesce(back, F.lit(-1)).cast("int").alias("recovery"),
        F.min("ret").alias("worst_day"), F.when(F.stddev_pop("ret") > 1e-12, F.avg("ret") / F.stddev_pop("ret") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
    )


def deflated_sharpe(sharpe: Column, n: Column, skew: Column, excess: Column, trials: int) -> Column:
    """Chance that a Sharpe ratio, the best of ``trials`` over ``n`` returns, is above what luck alone gives; 0 below two returns.

    Its variance is (1 - skew s + (excess - 1) / 4 s^2) / n, or 1 / n where that is not above 0.
    """
    nd, euler = NormalDist(), 0.5772156649
    best = (1 - euler) * (nd.inv_cdf(1 - 1 / trials) if trials > 1 else 0.0) + euler * nd.inv_cdf(1 - 1 / (trials * math.e))
    var = (1 - skew * sharpe + (excess - 1) / 4 * sharpe * sharpe) / n
    spread = F.sqrt(F.when(var > 0, var).otherwise(1 / n))
    return F.when(n < 2, 0.0).otherwise(normal_cdf((sharpe - spread * best) / spread))
