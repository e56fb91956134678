"""One-step walk-forward back-tests as window expressions: each day is predicted from the actual values before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.exprs import ratio
from gridloom.operators.ranges import month, positions
from gridloom.operators.scan import smoothed

MODELS = ("naive", "seasonal_naive", "moving_average", "linear_trend", "exp_smoothing")
TREND = 180
#: Period, window of the mean and held-out rows of the domain's daily and hourly tasks.
DAILY = {"period": 7, "window": 7, "horizon": 90}
HOURLY = {"period": 24, "window": 24, "horizon": 504}
ALPHA = 0.35


def backtest(series: DataFrame, entity: str, at: str, value: str, horizon: int = 90, period: int = 7, window: int = 7, least: int = 120) -> DataFrame:
    """``entity, at, actual`` of the last ``horizon`` rows of each series, with a column for each model.

    Series of fewer than ``horizon + least`` rows are left out. A row's place in
    its series and the smoothed level before it are found in pieces of the
    series (by month); the other models look back on ``TREND`` rows at most, so
    their windows work on a fixed number of rows a series. The trend is the
    least-squares line over the last 180 rows. Exponential smoothing is that of
    the whole series before the row.
    """
    rows = series.select(entity, at, F.col(value).cast("double").alias("actual")).where("actual is not null")
    rows = positions(rows, [entity], month(at), [at], "place", "length").where(F.col("length") >= horizon + least)
    rows = smoothed(rows, [entity], "place", "actual", ALPHA, "exp_smoothing")
    rows = rows.withColumn("back", F.col("length") - F.col("place")).where(F.col("back") <= horizon + TREND)
    w = Window.partitionBy(entity).orderBy(at)
    rows = rows.withColumn("t", -F.col("back").cast("double"))
    before = w.rowsBetween(-TREND, -1)
    out = rows.withColumns({
        "naive": F.lag("actual", 1).over(w),
        "seasonal_naive": F.coalesce(F.lag("actual", period).over(w), F.lag("actual", 1).over(w)),
        "moving_average": F.avg("actual").over(w.rowsBetween(-window, -1)),
        "slope": F.regr_slope("actual", "t").over(before),
        "mean_y": F.avg("actual").over(before),
        "mean_t": F.avg("t").over(before),
    }).where(F.col("back") <= horizon)
    return out.withColumn("linear_trend", F.coalesce(F.col("mean_y") + F.col("slope") * (F.col("t") - F.col("mean_t")), "naive")).select(entity, at, "actual", *MODELS)


def by_model(wide: DataFrame, keys: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    """A row for each held-out row and model: ``model, predicted, error``."""
    rows = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in models))
    long = wide.select(*keys, "actual", F.explode(rows).alias("x")).select(*keys, "actual", "x.model", "x.predicted")
    return long.withColumn("error", F.col("predicted") - F.col("actual"))


def metrics(where: Column | None = None, suffix: str = "") -> list[Column]:
    """Mean absolute error, root mean square error, symmetric percentage and bias, over rows of ``actual``, ``predicted``, ``error``."""
    e = F.col("error") if where is None else F.when(where, F.col("error"))
    half = (F.abs("actual") + F.abs("predicted")) / 2.0
    off = F.abs(e) / F.when(half == 0, F.lit(1e-9)).otherwise(half)
    return [F.avg(F.abs(e)).alias(f"mae{suffix}"), F.sqrt(F.avg(e * e)).alias(f"rmse{suffix}"), (F.avg(off) * 100.0).alias(f"smape{suffix}"), F.avg(e).alias(f"bias{suffix}")]


#: What a forecast error at or below the middle one means, and one above it.
DEFERRABLE, UNCERTAIN = "forecast_suficiente_para_diferir_capex", "forecast_insuficiente_requiere_refuerzo_o_flex"


def predictability(errors: DataFrame, pressure: DataFrame, entity: str) -> DataFrame:
    """Errors by entity beside its new demand, split at the median error."""
    per = errors.groupBy(entity).agg(F.avg(F.abs("error")).alias("mae")).join(pressure, entity, "left")
    out = per.withColumns({"ev_ratio": F.coalesce(ratio("ev_mean", "demand_mean"), F.lit(0.0)), "industry_ratio": F.coalesce(ratio("industry_mean", "demand_mean"), F.lit(0.0)), "new_ratio": F.coalesce(ratio(F.col("ev_mean") + F.col("industry_mean"), "demand_mean"), F.lit(0.0))})
    middle = out.agg(F.median("mae").alias("median_mae"))
    return out.crossJoin(F.broadcast(middle)).withColumn("decision", F.when(F.col("mae") <= F.col("median_mae"), DEFERRABLE).otherwise(UNCERTAIN))
