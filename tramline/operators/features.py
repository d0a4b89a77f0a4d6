"""Weather consolidation, feature tables, forecasting baselines, metrics and policy scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators.quantiles import exact_quantiles


def merge_groups(groups: list[DataFrame], keys: list[str]) -> DataFrame:
    """Variable groups of one grid, each deduplicated on keys, merged by full outer joins; clashing columns get a suffix."""
    out = None
    for i, g in enumerate(groups):
        g = g.dropDuplicates(keys)
        if out is None:
            out = g
            continue
        g = g.select(*[F.col(c) if c in keys or c not in out.columns else F.col(c).alias(f"{c}_{i}") for c in g.columns])
        out = out.join(g, keys, "full_outer")
    return out


def rolling_sums(df: DataFrame, keys: list[str], at: str, value: str, rows: list[int]) -> DataFrame:
    """Sums of the last n rows, this one included, for each n."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumns({f"{value}_sum_{n}": F.sum(value).over(w.rowsBetween(1 - n, 0)) for n in rows})


def heat_index_c(temp_c: Column, humidity: Column) -> Column:
    """Apparent heat in Celsius by the usual nine-term polynomial; below 27 degrees the temperature itself."""
    t, r = temp_c, humidity
    # Coefficients of the published regression in Celsius (fixed values).
    h = -8.78469475556 + 1.61139411 * t + 2.33854883889 * r - 0.14611605 * t * r - 0.012308094 * t * t - 0.0164248277778 * r * r + 0.002211732 * t * t * r + 0.00072546 * t * r * r - 0.000003582 * t * t * r * r
    return F.when(t < 27, t).otherwise(h)


def lag_features(df: DataFrame, keys: list[str], at: str, value: str, lags: list[int] = (1, 2, 48, 336), window: int = 48) -> DataFrame:
    """Earlier values by rows, and the mean and sample deviation of the `window` rows before this one."""
    w = Window.partitionBy(*keys).orderBy(at)
    past = w.rowsBetween(-window, -1)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags} | {f"{value}_mean_{window}": F.avg(value).over(past), f"{value}_sd_{window}": F.stddev_samp(value).over(past)})


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, minute, dow (Sunday 0), day of year, weekend, peak, monsoon, and the hour's and dow's places on the circle."""
    t = F.col(ts)
    h, d = F.hour(t), times.sunday_zero(t)
    hs, hc = times.cyclic(h + F.minute(t) / 60.0, 24.0)
    ds, dc = times.cyclic(d, 7.0)
    peak = ((h >= 7) & (h < 10)) | ((h >= 17) & (h < 21))
    return df.withColumns({"hour": h, "minute": F.minute(t), "dow": d, "doy": F.dayofyear(t), "is_weekend": d.isin(0, 6), "is_peak": peak, "is_monsoon": times.is_monsoon(t), "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc})


def temporal_split(df: DataFrame, ts: str, train_end, valid_end) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows up to train_end, up to valid_end, and after; rows without a time belong to none."""
    t = F.col(ts)
    return df.where(t <= F.lit(train_end)), df.where((t > F.lit(train_end)) & (t <= F.lit(valid_end))), df.where(t > F.lit(valid_end))


def average_rank(df: DataFrame, value: str, name: str, keys: list[str] = (), descending: bool = False, share: bool = False) -> DataFrame:
    """Ranks with ties at their average place; `share` divides by the rows. Nulls have none.

    Distinct values are ranked by their counts, so that equal rows are never gathered.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = list(keys) or [F.lit(0)]
    order = F.desc(value) if descending else F.asc(value)
    w = Window.partitionBy(*parts).orderBy(order)
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = upto - (F.col("_c") - 1) / 2.0
    total = F.sum("_c").over(Window.partitionBy(*parts))
    ranked = counts.withColumn(name, rank / total if share else rank).drop("_c")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, value]]
    return df.alias("l").join(ranked.alias("r"), cond, "left").select("l.*", F.col(f"r.{name}"))


def mean_in_order(df: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """(keys, name): means of value, added in the stated order of rows.

    So the last digits of a mean don't depend on how rows are dealt: equal sequences have equal
    means, and a mean lies on the same side of a limit in each run.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summed = df.select(*keys, (F.sum(value).over(upto) / F.nullif(F.count(value).over(upto), F.lit(0))).alias(name), F.lead(F.lit(1)).over(w).alias("_next"))
    return summed.where(F.col("_next").isNull()).drop("_next")


def target_encode(train: DataFrame, frames: list[DataFrame], key: str, target: str, order: list[str] | None = None) -> list[DataFrame]:
    """Each frame with the training mean of target by key and that mean's rank share; unseen keys get null.

    With an order, targets are added in it, so that keys with equal sequences of targets tie.
    """
    mean = mean_in_order(train, [key], target, order, f"{key}_mean") if order else train.groupBy(key).agg(F.avg(target).alias(f"{key}_mean"))
    means = average_rank(mean, f"{key}_mean", f"{key}_rank", share=True)
    return [f.join(means, key, "left") for f in frames]


def metrics(df: DataFrame, truth: str, guess: str, keys: list[str] = ()) -> DataFrame:
    """Rows, MAE, RMSE, symmetric percentage error (0 where both are 0), R2 and correlation, over rows that have both."""
    y, p = F.col(truth), F.col(guess)
    known = df.where(y.isNotNull() & p.isNotNull())
    d = p - y
    smape = F.when(F.abs(y) + F.abs(p) == 0, 0.0).otherwise(200 * F.abs(d) / (F.abs(y) + F.abs(p)))
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(smape).alias("smape"), F.sum(d * d).alias("_sse"), F.var_pop(y).alias("_var"), F.corr(y, p).alias("pearson"))
    return out.withColumn("r2", 1 - F.col("_sse") / F.nullif(F.col("_var") * F.col("n"), F.lit(0.0))).drop("_sse", "_var")


def persistence(df: DataFrame, keys: list[str], at: str, value: str, lag: int = 1) -> DataFrame:
    """Metrics of a forecast by the value `lag` rows before."""
    w = Window.partitionBy(*keys).orderBy(at)
    return metrics(df.withColumn("_p", F.lag(value, lag).over(w)), value, "_p")


def historical_mean(train: DataFrame, test: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Metrics of a forecast by the training mean of the keys."""
    return metrics(test.join(train.groupBy(*keys).agg(F.avg(value).alias("_p")), keys), value, "_p")


def overdispersion(df: DataFrame, value: str) -> DataFrame:
    """Mean, sample variance and their ratio."""
    out = df.agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.withColumn("dispersion", F.col("variance") / F.nullif(F.col("mean"), F.lit(0.0)))


def sequences(df: DataFrame, keys: list[str], at: str, value: str, length: int = 12) -> DataFrame:
    """Rows that have `length` earlier ones, with those values as an array."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("history", F.collect_list(value).over(w.rowsBetween(-length, -1))).where(F.size("history") == length)


def forward_fill(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Nulls take the last known value, and 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0)))


def mode_shift(df: DataFrame, runs: str, regularity: str, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """df with score and tier: frequency capped at its 99th percentile and scaled, plus regularity; tiers split at 0.5 and 0.7, right-closed."""
    found = exact_quantiles(df, runs, [0.99])
    cap = found[0] if found else None
    freq = F.least(F.col(runs) / F.lit(float(cap)), F.lit(1.0)) if cap else F.lit(0.0)
    score = weights[0] * freq + weights[1] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(regularity), F.lit(0.0))))
    tier = F.when(F.col("score") <= 0.5, "T3").when(F.col("score") <= 0.7, "T2").otherwise("T1")
    return df.withColumn("score", score).withColumn("tier", tier)


def co2_savings(df: DataFrame, runs: str, km: str, kg_per_km: float = 0.141, riders_per_car: float = 1.15) -> DataFrame:
    """df with co2_kg, not under 0, and cars_avoided to one decimal."""
    return df.withColumns({"co2_kg": F.greatest(F.lit(0.0), F.col(runs) * F.col(km) * kg_per_km), "cars_avoided": F.round(F.col(runs) / riders_per_car, 1)})


def service_status(demand: DataFrame, direct: DataFrame, transfer: DataFrame, origin: str, dest: str) -> DataFrame:
    """demand with status direct, transfer or gap of its unordered pair."""
    pair = {"_a": F.least(origin, dest), "_b": F.greatest(origin, dest)}
    one = direct.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_one"))
    two = transfer.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_two"))
    joined = demand.withColumns(pair).join(one, ["_a", "_b"], "left").join(two, ["_a", "_b"], "left")
    return joined.withColumn("status", F.when(F.col("_one"), "direct").when(F.col("_two"), "transfer").otherwise("gap")).drop("_a", "_b", "_one", "_two")


def ward_rollup(od: DataFrame, wards: DataFrame, month_of: str | None = None) -> DataFrame:
    """Flow, mean minutes and distinct stops by origin and destination ward (and month); stops without a ward drop."""
    o = wards.select(F.col("stop_id").alias("origin_stop_id"), F.col("ward").alias("origin_ward"))
    d = wards.select(F.col("stop_id").alias("dest_stop_id"), F.col("ward").alias("dest_ward"))
    keys = ["origin_ward", "dest_ward"] + (["month"] if month_of else [])
    src = od.withColumn("month", F.date_trunc("MONTH", month_of).cast("date")) if month_of else od
    return src.join(o, "origin_stop_id").join(d, "dest_stop_id").groupBy(*keys).agg(F.sum("flow").alias("flow"), F.avg("mean_duration_min").alias("mean_duration_min"), F.countDistinct("origin_stop_id").alias("n_origin_stops"), F.countDistinct("dest_stop_id").alias("n_dest_stops"))


def ward_od(od: DataFrame, wards: DataFrame) -> DataFrame:
    """Trips, mean distance and distinct stops between wards by period, month number, monsoon, day of week and month.

    Both ends are joined to their wards; a trip with a stop outside all wards goes.
    """
    end = lambda side: wards.where(F.col("ward").isNotNull()).select(F.col("stop_id").alias(f"{side}_stop_id"), F.col("ward").alias(f"{side}_ward"))
    keys = ["origin_ward", "dest_ward", "period", "month", "is_monsoon", "dow", F.date_trunc("MONTH", "time_bin").cast("date").alias("month_start")]
    both = od.join(end("origin"), "origin_stop_id").join(end("dest"), "dest_stop_id")
    return both.groupBy(*keys).agg(F.sum("flow").alias("trip_count"), F.avg("distance_km").alias("avg_distance_km"), F.countDistinct("origin_stop_id").alias("n_origin_stops"), F.countDistinct("dest_stop_id").alias("n_dest_stops"))


def by_effective_day(df: DataFrame, keys: list[str], ts: str = "ts", start_hour: int = 3) -> DataFrame:
    """Times of each key and effective day (a day that begins at start_hour): number, first and last."""
    return df.where(F.col(ts).isNotNull()).groupBy(*keys, times.effective_day(F.col(ts), start_hour).alias("effective_day")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
