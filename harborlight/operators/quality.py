"""Declared data-quality rules, run in one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules as business
from harborlight.functions.numeric import count_if, ratio, round_to


@dataclass(frozen=True)
class Rule:
    """A rule on one column: not_null, in_set, between, unique or accepted."""

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = field(default_factory=tuple)

    @property
    def name(self) -> str:
        return f"expect_{self.column}_{self.kind}"

    def failures(self) -> Column:
        """Rows that break the rule, as an aggregate."""
        c = F.col(self.column)
        if self.kind == "not_null":
            return count_if(c.isNull())
        if self.kind == "in_set":  # null is not in the set
            return count_if(c.isNull() | ~c.isin(*self.values))
        if self.kind == "accepted":  # null passes
            return count_if(~c.isin(*self.values))
        if self.kind == "between":  # null passes
            low = c < self.low if self.low is not None else F.lit(False)
            high = c > self.high if self.high is not None else F.lit(False)
            return count_if(low | high)
        if self.kind == "unique":
            return F.count(c) - F.countDistinct(c)
        raise ValueError(f"unknown rule kind {self.kind}")


# The rule suites.
ORDER_SUITE = [
    Rule("not_null", "order_id"),
    Rule("between", "delay_days", 0, 365),
    Rule("in_set", "status", values=tuple(business.SUITE_STATUSES)),
]
ORDER_EXPECTATIONS = [
    Rule("not_null", "order_id"),
    Rule("in_set", "status", values=tuple(business.ORDER_STATUSES)),
    Rule("between", "delay_days", 0, 365),
    Rule("between", "inventory_level", 0, 100),
]
SUPPLIER_EXPECTATIONS = [Rule("not_null", "supplier_id"), Rule("between", "trust_score", 0, 1)]
MODEL_TESTS = {
    "fct_shipments": [
        Rule("not_null", "order_id"), Rule("unique", "order_id"), Rule("not_null", "supplier_id"),
        Rule("not_null", "product"), Rule("not_null", "status"),
        Rule("accepted", "status", values=tuple(business.ORDER_STATUSES)),
        Rule("not_null", "order_value"), Rule("between", "order_value", 0),
        Rule("between", "delay_days", 0, 365), Rule("between", "calculated_delay_days", -30, 365),
    ],
    "dim_suppliers": [
        Rule("not_null", "supplier_id"), Rule("unique", "supplier_id"), Rule("not_null", "name"),
        Rule("not_null", "region"), Rule("not_null", "trust_score"), Rule("between", "trust_score", 0, 1),
        Rule("not_null", "total_orders"), Rule("between", "delay_rate_pct", 0, 100),
    ],
    "stg_orders": [
        Rule("not_null", "order_id"), Rule("not_null", "supplier_id"),
        Rule("accepted", "status", values=tuple(business.ORDER_STATUSES)), Rule("not_null", "delay_days"),
    ],
    "stg_suppliers": [
        Rule("not_null", "supplier_id"), Rule("not_null", "name"), Rule("not_null", "trust_score"),
    ],
    "agg_control_tower": [Rule("not_null", "total_shipments"), Rule("not_null", "pipeline_value")],
}


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule whose column exists; all rules share one aggregate."""
    present = [r for r in rules if r.column in df.columns]
    one = df.agg(F.count("*").alias("total"), *[r.failures().alias(f"r{i}") for i, r in enumerate(present)])
    rows = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("failed_count"))
        for i, r in enumerate(present)
    ])
    return one.select("total", F.inline(rows)).select(
        "rule", (F.col("failed_count") == 0).alias("passed"), "failed_count",
        F.col("total").alias("total_count"))


def run_suite(df: DataFrame, rules: Sequence[Rule] = tuple(ORDER_SUITE)) -> DataFrame:
    return evaluate(df, rules)


def from_expectations(suite: dict) -> list[Rule]:
    """Rules from a declared suite (expectation_type + kwargs)."""
    kinds = {
        "expect_column_values_to_not_be_null": "not_null",
        "expect_column_values_to_be_in_set": "in_set",
        "expect_column_values_to_be_between": "between",
        "expect_column_values_to_be_unique": "unique",
    }
    found = []
    for e in suite["expectations"]:
        kw = e["kwargs"]
        found.append(Rule(
            kinds[e["expectation_type"]], kw["column"], kw.get("min_value"), kw.get("max_value"),
            tuple(kw.get("value_set", ()))))
    return found


def invalid_sample(df: DataFrame, column: str, allowed: Sequence[str], k: int = 5) -> DataFrame:
    """The first k distinct values outside the allowed set."""
    c = F.col(column)
    return df.filter(~c.isin(*allowed)).select(column).distinct().orderBy(column).limit(k)


@dataclass(frozen=True)
class Check:
    """A contract check: a measured figure and what it must satisfy."""

    name: str
    measure: Column
    holds: object  # Column -> Column


def contract(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check with the figure seen; one aggregate for all."""
    one = df.agg(*[c.measure.cast("double").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("observed"),
                 F.coalesce(c.holds(F.col(f"c{i}")), F.lit(False)).alias("passed"))
        for i, c in enumerate(checks)
    ])
    return one.select(F.inline(rows))


def _missing(column: str) -> Column:
    return count_if(F.col(column).isNull())


def _duplicates(column: str) -> Column:
    return F.count(column) - F.countDistinct(column)


def _mean(column: str) -> Column:
    return ratio(F.sum(column), F.count(column))


def order_contract(now: Column) -> list[Check]:
    age_hours = (F.unix_seconds(F.first(now).cast("timestamp"))
                 - F.unix_seconds(F.max("created_at").cast("timestamp"))) / F.lit(3600.0)
    status = F.col("status")
    return [
        Check("row_count > 0", F.count("*"), lambda x: x > 0),
        Check("missing_count(order_id) = 0", _missing("order_id"), lambda x: x == 0),
        Check("duplicate_count(order_id) = 0", _duplicates("order_id"), lambda x: x == 0),
        Check("missing_count(supplier_id) = 0", _missing("supplier_id"), lambda x: x == 0),
        Check("missing_count(status) = 0", _missing("status"), lambda x: x == 0),
        Check("invalid_count(status) = 0", count_if(~status.isin(business.ORDER_STATUSES)), lambda x: x == 0),
        Check("avg(delay_days) < 30", _mean("delay_days"), lambda x: x < 30),
        Check("max(delay_days) < 365", F.max("delay_days"), lambda x: x < 365),
        Check("min(unit_price) >= 0", F.min("unit_price"), lambda x: x >= 0),
        Check("min(quantity) >= 1", F.min("quantity"), lambda x: x >= 1),
        Check("freshness(created_at) < 25h", age_hours, lambda x: x < 25),
    ]


def silver_contract() -> list[Check]:
    return [
        Check("row_count > 0", F.count("*"), lambda x: x > 0),
        Check("missing_count(order_id) = 0", _missing("order_id"), lambda x: x == 0),
        Check("duplicate_count(order_id) = 0", _duplicates("order_id"), lambda x: x == 0),
        Check("missing_count(status) = 0", _missing("status"), lambda x: x == 0),
        Check("missing_count(supplier_id) = 0", _missing("supplier_id"), lambda x: x == 0),
        Check("avg(delay_days) between -1 and 90", _mean("delay_days"), lambda x: x.between(-1, 90)),
        Check("min(order_value) >= 0", F.min("order_value"), lambda x: x >= 0),
    ]


def silver_audit(orders: DataFrame) -> DataFrame:
    """Nulls in the keys, wrong status, delay outside -1..365, repeated ids."""
    delay, status = F.col("delay_days"), F.col("status")
    figures = {
        "null_order_id": _missing("order_id"),
        "null_supplier_id": _missing("supplier_id"),
        "null_status": _missing("status"),
        "invalid_status_count": count_if(status.isNull() | ~status.isin(business.ORDER_STATUSES)),
        "delay_days_out_of_range": count_if((delay < -1) | (delay > 365)),
        # every row after the first of its id counts, null ids too
        "duplicate_order_ids": F.count("*") - F.countDistinct("order_id") - F.least(
            _missing("order_id"), F.lit(1)),
    }
    return _figures(orders, figures)


def trust_audit(suppliers: DataFrame) -> DataFrame:
    return _figures(suppliers, {"bad_trust_score_count": count_if(~F.col("trust_score").between(0, 1))})


def bounds_audit(risks: DataFrame) -> DataFrame:
    return _figures(risks, {
        "bad_delay_probability": count_if(~F.col("delay_probability").between(0, 1)),
        "bad_confidence": count_if(~F.col("confidence").between(0, 1)),
    })


def forecast_audit(forecast: DataFrame) -> DataFrame:
    y = F.col("yhat")
    return _figures(forecast, {
        "forecast_bound_violations": count_if(y < F.col("yhat_lower")) + count_if(y > F.col("yhat_upper")),
        "negative_forecasts": count_if(y < 0),
        "negative_lower_bounds": count_if(F.col("yhat_lower") < 0),
    })


def _figures(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    one = df.agg(*[c.alias(n) for n, c in figures.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in figures])
    return one.select(F.inline(rows))


def formula_mismatches(gold: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Rows whose stored costs are off by more than the tolerance; all rows are checked."""
    value, delay = F.coalesce("order_value", F.lit(0.0)), F.coalesce("delay_days", F.lit(0)).cast("double")
    expected = {
        "carrying_cost": value * (delay / F.lit(30.0)) * F.lit(0.02),
        "delay_cost": delay * F.lit(500.0),
    }

    def finding(name: str) -> Column:
        want = expected[name]
        got = F.coalesce(F.when(F.col(name) != 0, F.col(name)), want)
        error = F.abs(got - want) / F.greatest(want, F.lit(1.0))
        return F.when(error > tolerance, F.struct(
            F.lit(name).alias("field"), round_to(want, 2).alias("expected"),
            round_to(got, 2).alias("actual"), round_to(error * 100, 1).alias("error_pct")))

    both = F.filter(F.array(finding("carrying_cost"), finding("delay_cost")), lambda f: f.isNotNull())
    return gold.filter((value > 0) & (delay > 0)).select("order_id", F.inline(both))


def missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns the table lacks, next to the number of rows concerned."""
    absent = [c for c in required if c not in {x.lower() for x in df.columns}]
    names = F.array(*[F.lit(c) for c in absent]) if absent else F.array().cast("array<string>")
    return df.agg(F.count("*").alias("rows")).select(F.explode(names).alias("missing_column"), "rows")
