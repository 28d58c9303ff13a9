"""Delay risk and demand forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import clamp, money_sum, ratio, round_to
from harborlight.operators.freight import cheapest_carrier

DECAY_DAYS = 90.0
UNKNOWN_AGE = 180.0
AT_RISK = 0.15
TOP_RISKS = 500


def decay_risk(orders: DataFrame, newest: Column) -> DataFrame:
    """Delay probability per supplier, recent orders weighing more.

    The weight falls by e every 90 days before the newest date. Confidence
    grows with the number of orders.
    """
    seconds = F.unix_seconds(newest.cast("timestamp")) - F.unix_seconds(
        F.col("expected_delivery").cast("timestamp"))
    # greatest skips nulls, so the unknown date is asked for first
    age = F.when(seconds.isNull(), UNKNOWN_AGE).otherwise(F.greatest(seconds / F.lit(86400.0), F.lit(0.0)))
    weight = F.exp(-age / F.lit(DECAY_DAYS))
    late = F.when(rules.is_late(F.col("delay_days")), weight).otherwise(0.0)
    sums = orders.filter(F.col("supplier_id").isNotNull()).groupBy("supplier_id").agg(
        F.count("*").alias("total_orders"),
        F.sum(weight).alias("_weight"),
        F.sum(late).alias("_late"),
        ratio(F.sum("delay_days"), F.count("delay_days")).alias("avg_delay_days"),
    )
    return sums.select(
        "supplier_id",
        "total_orders",
        round_to(F.col("_late") / F.greatest("_weight", F.lit(1e-9)), 6).alias("delay_probability"),
        "avg_delay_days",
        round_to(clamp(1 - 1 / F.sqrt(F.greatest("total_orders", F.lit(1))), 0.0, 1.0), 3).alias("confidence"),
    )


def at_risk_orders(orders: DataFrame, risk: DataFrame, now: Column) -> DataFrame:
    """All undelivered orders of risky suppliers, with the value at risk."""
    left = (
        F.unix_seconds(F.col("expected_delivery").cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    ) / F.lit(86400.0)
    return (
        orders.filter(F.col("status") != "DELIVERED")
        .withColumn("days_to_delivery", round_to(left, 2))
        .join(risk.select("supplier_id", "delay_probability", "confidence", "avg_delay_days"),
              "supplier_id", "left")
        .fillna(0.0, ["delay_probability", "confidence"])
        .withColumn("risk_score", round_to(F.col("order_value") * F.col("delay_probability"), 2))
        .filter(F.col("delay_probability") > AT_RISK)
    )


def top_risks(risks: DataFrame, limit: int = TOP_RISKS) -> DataFrame:
    """The report of the highest values at risk."""
    return risks.orderBy(F.col("risk_score").desc(), F.col("order_id").asc()).limit(limit)


def risk_reason() -> Column:
    """A sentence on why an order is at risk; whole percents."""
    def whole(c: Column) -> Column:
        return F.floor(c + F.lit(0.5)).cast("string")

    return F.concat(
        F.lit("Supplier "), F.col("supplier_id"), F.lit(": "), whole(F.col("delay_probability") * 100),
        F.lit("% weighted delay prob (confidence "), whole(F.col("confidence") * 100),
        F.lit("%), risk_score="), whole(F.col("risk_score")),
    )


def enrich_risks(risks: DataFrame, freight: DataFrame, warehouses: DataFrame) -> DataFrame:
    """At-risk orders with the cheapest carrier to their region and the plant's capacity."""
    carriers = cheapest_carrier(freight).withColumnRenamed("dest_port", "region")
    plants = warehouses.select(F.col("plant_code").alias("supplier_id"), "daily_capacity")
    return risks.join(carriers, "region", "left").join(plants, "supplier_id", "left")


def delay_predictions(orders: DataFrame, suppliers: DataFrame, now: Column) -> DataFrame:
    """Delay score of every open order from trust, mean delay and days left."""
    seconds = F.unix_seconds(F.col("expected_delivery").cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))
    remaining = F.floor(seconds / F.lit(86400.0)).cast("int")
    open_rows = orders.filter(
        ~F.col("status").isin(rules.CLOSED_STATUSES) & F.col("expected_delivery").isNotNull()
    ).withColumn("days_remaining", remaining)
    known = suppliers.select(
        "supplier_id", F.col("name").alias("_name"), "trust_score", "avg_delay_days", F.lit(True).alias("_known"))
    # a known supplier without a score counts as fully trusted; an unknown one gets the default
    trust = F.when(F.col("_known"), F.coalesce("trust_score", F.lit(1.0))).otherwise(0.7)
    mean = F.coalesce("avg_delay_days", F.lit(0.0))
    left = F.col("days_remaining")
    urgency = F.when(left < 0, 2.0).when(left <= 3, 1.5).when(left <= 7, 1.2).otherwise(1.0)
    score = F.least(
        F.lit(0.99),
        clamp(1 - trust, 0.05, 0.95) * F.least(F.lit(2.0), 1 + mean / F.lit(14.0)) * urgency,
    )
    return open_rows.join(known, "supplier_id", "left").withColumn("_p", score).select(
        "order_id", "supplier_id", F.coalesce("_name", "supplier_id").alias("supplier_name"),
        "order_value", "status", "days_remaining", (left < 0).alias("is_overdue"),
        round_to("_p", 3).alias("delay_probability"),
        rules.level_of(F.col("_p"), "CRITICAL", "HIGH", "MEDIUM").alias("risk_level"),
        round_to(trust, 3).alias("supplier_trust"), round_to(mean, 1).alias("supplier_avg_delay_days"),
        F.col("_p").alias("raw_probability"),
    )


def daily_demand(orders: DataFrame, *keys: str, stamp: str = "expected_delivery") -> DataFrame:
    return orders.filter(F.col(stamp).isNotNull()).groupBy(
        *keys, F.to_date(stamp).alias("ds")
    ).agg(money_sum("order_value").alias("y"))


def linear_rule(orders: DataFrame, start: Column, *keys: str, periods: int = 30) -> DataFrame:
    """Mean value growing by a tenth of a percent a day, with a 15 % band; for each key if there are keys."""
    mean = ratio(money_sum("order_value"), F.count("order_value")).alias("base")
    base = orders.groupBy(*keys).agg(mean) if keys else orders.agg(mean)
    n = F.col("n")
    growth = F.col("base") * F.lit(0.001)
    yhat = F.col("base") + growth * n
    return base.select(
        *keys, "base", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("n")
    ).select(
        *keys,
        F.date_format(F.date_add(start.cast("date"), n), "yyyy-MM-dd").alias("ds"),
        round_to(yhat, 2).alias("yhat"),
        round_to(yhat * F.lit(0.85), 2).alias("yhat_lower"),
        round_to(yhat * F.lit(1.15), 2).alias("yhat_upper"),
        round_to(growth * n, 2).alias("trend"),
    )


# 80 % of a normal distribution lies within this many standard deviations
BAND = 1.2815515655446004
MIN_DATES = 10


def trend_forecast(daily: DataFrame, *keys: str, origin: str = "1995-01-01", periods: int = 30) -> DataFrame:
    """A line through the daily series with an 80 % band, one per key.

    The sums behind the fit are whole numbers (days and cents), so the result
    does not depend on the order of rows. Series under ten dates have no fit; ``demand_forecast`` gives
    them the linear rule.
    """
    whole = "decimal(38,0)"
    x = F.datediff(F.col("ds"), F.lit(origin).cast("date")).cast(whole)
    y = (F.col("y").cast("decimal(18,2)") * 100).cast("decimal(18,0)").cast(whole)

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(28,0)")).cast("double")

    rows = daily.select(*keys, "ds", x.alias("x"), y.alias("v"))
    n = F.col("n").cast("double")
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("ds").alias("last"),
        total(F.col("x")).alias("sx"), total(F.col("v")).alias("sy"),
        total(F.col("x") * F.col("x")).alias("sxx"), total(F.col("x") * F.col("v")).alias("sxy"),
        total(F.col("v") * F.col("v")).alias("syy"),
    ).filter(F.col("n") >= MIN_DATES)
    fitted = (
        sums.withColumn("cxx", F.col("sxx") - F.col("sx") * F.col("sx") / n)
        .withColumn("cxy", F.col("sxy") - F.col("sx") * F.col("sy") / n)
        .withColumn("cyy", F.col("syy") - F.col("sy") * F.col("sy") / n)
        .withColumn("slope", F.try_divide(F.col("cxy"), F.col("cxx")))
        .withColumn("level", (F.col("sy") - F.col("slope") * F.col("sx")) / n)
        .withColumn("spread", F.sqrt(F.greatest(
            F.col("cyy") - F.col("slope") * F.col("cxy"), F.lit(0.0)) / (n - 2)))
    )
    step = F.col("step")
    at = F.datediff(F.col("last"), F.lit(origin).cast("date")) + step
    yhat = (F.col("level") + F.col("slope") * at) / 100
    band = F.col("spread") * F.lit(BAND) / 100
    return fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")).select(
        *keys,
        F.date_format(F.date_add("last", step), "yyyy-MM-dd").alias("ds"),
        round_to(yhat, 2).alias("yhat"),
        round_to(yhat - band, 2).alias("yhat_lower"),
        round_to(yhat + band, 2).alias("yhat_upper"),
        round_to(yhat, 2).alias("trend"),
    )


BENDS = 8           # places at which the slope may change
BENT_SHARE = 0.8    # of the series' days, from its first one, hold them
RIDGE = 0.001       # penalty of a change of slope, as a share of its own sum of squares


def solved(matrix: Column, size: int) -> Column:
    """The solution of a linear system whose matrix is symmetric and positive definite, by elimination.

    ``matrix`` has ``size`` rows, each an array of the coefficients and the right side.
    """
    def step(m: Column, k: Column) -> Column:
        pivot_row = F.get(m, k)
        pivot = F.get(pivot_row, k)
        lead = F.transform(pivot_row, lambda v: v / pivot)
        return F.transform(m, lambda row, i: F.when(i == k, lead).otherwise(
            F.zip_with(row, lead, lambda v, w: v - F.get(row, k) * w)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def bent_forecast(daily: DataFrame, *keys: str, periods: int = 30, bends: int = BENDS) -> DataFrame:
    """A trend whose slope may change at ``bends`` places, with an 80 % band, one per key; it goes on with its last slope.

    The places lie evenly over the first ``BENT_SHARE`` of a key's days. The terms are a level, a slope and a hinge
    for each place; changes of slope are held small by a ridge. One aggregate per key gathers the normal equations in whole numbers
    (days and cents), so the order of rows does not matter, and they are solved where they are. Series under ten dates
    have no fit, as in ``trend_forecast``.
    """
    whole = "decimal(38,0)"
    if not keys:
        return bent_forecast(daily.withColumn("_all", F.lit(0)), "_all", periods=periods, bends=bends).drop("_all")
    spans = daily.groupBy(*keys).agg(
        F.min("ds").alias("_first"), F.max("ds").alias("_last"), F.count("*").alias("_n")).filter(F.col("_n") >= MIN_DATES)
    length = F.datediff("_last", "_first")
    places = F.array(*[F.floor(length * F.lit(BENT_SHARE) * F.lit(j) / F.lit(float(bends))).cast("long") for j in range(1, bends + 1)])
    spans = spans.withColumn("_places", places)
    # one row per key on the right
    named = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first", "_last", "_n", "_places")
    rows = daily.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    x = F.datediff("ds", "_first").cast("long")
    size = bends + 2
    terms = [F.lit(1).cast("long"), x, *(F.greatest(x - F.get("_places", F.lit(j)), F.lit(0).cast("long")) for j in range(bends))]
    y = (F.col("y").cast("decimal(18,2)") * 100).cast("decimal(18,0)")
    rows = rows.select(*keys, "_last", "_first", "_n", "_places", *[t.alias(f"t{i}") for i, t in enumerate(terms)], y.alias("v"))

    def total(a: str, b: str) -> Column:
        return F.sum((F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(18,0)")).cast("decimal(28,0)")).cast(whole).cast("double")

    names = [f"t{i}" for i in range(size)]
    sums = [total(names[i], names[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [total(names[i], "v").alias(f"r{i}") for i in range(size)] + [total("v", "v").alias("vv")]
    fitted = rows.groupBy(*keys, "_first", "_last", "_n", "_places").agg(*sums)

    def cell(i: int, j: int) -> Column:
        value = F.col(f"s{min(i, j)}_{max(i, j)}")
        # a place that no day lies behind has an empty term; its change of slope is then zero
        return F.when(value == 0, 1.0).otherwise(value + value * F.lit(RIDGE)) if i == j and i >= 2 else value

    matrix = F.array(*[F.array(*[cell(i, j) for j in range(size)], F.col(f"r{i}")) for i in range(size)])
    fitted = fitted.withColumn("_b", solved(matrix, size))
    explained = F.lit(0.0)
    for i in range(size):
        explained = explained + F.get("_b", F.lit(i)) * F.col(f"r{i}")
    spread = F.sqrt(F.greatest(F.col("vv") - explained, F.lit(0.0)) / (F.col("_n") - 2))
    at = (F.datediff("_last", "_first") + F.col("step")).cast("long")
    yhat = F.get("_b", F.lit(0)) + F.get("_b", F.lit(1)) * at
    for j in range(bends):
        yhat = yhat + F.get("_b", F.lit(j + 2)) * F.greatest(at - F.get("_places", F.lit(j)), F.lit(0).cast("long"))
    band = spread * F.lit(BAND)
    return fitted.select("*", spread.alias("_spread"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")).select(
        *keys,
        F.date_format(F.date_add("_last", F.col("step")), "yyyy-MM-dd").alias("ds"),
        round_to(yhat / 100, 2).alias("yhat"),
        round_to((yhat - band) / 100, 2).alias("yhat_lower"),
        round_to((yhat + band) / 100, 2).alias("yhat_upper"),
        round_to(yhat / 100, 2).alias("trend"),
    )


def demand_forecast(orders: DataFrame, start: Column, *keys: str, periods: int = 30) -> DataFrame:
    """Thirty days for every key: the fitted line, or the linear rule where there are under ten dates."""
    daily = daily_demand(orders, *keys)
    fitted = trend_forecast(daily, *keys, periods=periods).withColumn("method", F.lit("fitted"))
    dates = F.countDistinct(F.to_date("expected_delivery"))
    if keys:
        named = orders.filter(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
        short = named.groupBy(*keys).agg(dates.alias("_dates")).filter(F.col("_dates") < MIN_DATES).select(
            *[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = named.join(short, same, "left_semi")
    else:
        few = orders.agg(dates.alias("n")).scalar() < MIN_DATES
        rows = orders.filter(few)
    ruled = linear_rule(rows, start, *keys, periods=periods).filter(F.col("yhat").isNotNull())
    return fitted.unionByName(ruled.withColumn("method", F.lit("linear")))
