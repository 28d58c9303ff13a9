"""Writers on the stream of events: routing, and all that is kept of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.operators import deviations as dev
from harborlight.operators import history
from harborlight.streaming import keyed, windows
from harborlight.streaming.running import each_batch, start, start_aggregate, state_rows, table
from harborlight.streaming.validation import dead_letters, with_errors

ORDER_FIELDS = ["order_id", "supplier_id", "product", "region", "quantity", "unit_price", "order_value",
                "delay_days", "status", "inventory_level", "event_time", "event_id"]
UPDATED = ["status", "delay_days", "inventory_level", "event_time", "event_id"]


def route(stream: DataFrame, base: str) -> dict[str, str]:
    """Split each batch into orders, demand signals and dead letters, read once."""
    paths = {name: f"{base}/{name}" for name in ("orders", "demand", "dead_letters")}

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = with_errors(batch).persist()
        try:
            good = checked.filter(F.size("errors") == 0).drop("errors")
            parts = {
                "orders": good.filter(F.col("event_type") == "ORDER"),
                "demand": good.filter(F.col("event_type") == "DEMAND_SPIKE"),
                "dead_letters": dead_letters(checked, F.current_timestamp()),
            }
            for name, rows in parts.items():
                rows.write.mode("overwrite").parquet(f"{paths[name]}/batch_id={batch_id}")
        finally:
            checked.unpersist()

    each_batch(stream, write, base)
    return paths


class OrderWriter:
    """Keeps suppliers, orders, the order log, deviations and statistics up to date.

    Five queries run over the same stream. Valid orders and deviations are appended to tables, each row once. Suppliers
    and orders are sums in Spark's own state, one small row for each: counts, the first event of an order, and its last one; they are
    read from the checkpoint. The order log is read from the appended events. CRITICAL deviations go
    through alert suppression and appear when the watermark has passed them.
    """

    def __init__(self, spark: SparkSession, base: str, horizon: str = keyed.HORIZON):
        self.spark, self.base, self.horizon = spark, base, horizon

    def _path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _found(self, orders: DataFrame) -> DataFrame:
        return dev.all_matches(orders, "supplier_id", "event_time", "event_id").withColumn(
            "deviation_id", F.concat_ws("-", F.lit("DEV"), F.col("event_id"), F.col("type")))

    def run(self, stream: DataFrame) -> None:
        """Take in all that the stream has and stop; call it again for what comes later."""
        checked = with_errors(stream)
        good = (F.size("errors") == 0) & (F.col("event_type") == "ORDER")
        orders = checked.filter(good).select(*ORDER_FIELDS)
        latest = F.max(F.struct("event_time", "event_id", "status", "delay_days", "inventory_level"))
        first = F.min(F.struct("event_time", "event_id", *[c for c in ORDER_FIELDS if c not in UPDATED and c != "order_id"]))
        self.orders_seen = orders
        self.other = self._found(orders).filter(F.col("severity") != "CRITICAL")
        late = self._critical(keyed.with_clock(checked, good))
        self.passed = keyed.accepted_alerts(late, self.horizon)
        queries = [
            start(orders, self._path("events")),
            start(self.other, self._path("deviations")),
            start(self.passed, self._path("accepted")),
            start_aggregate(windows.supplier_sums(orders), self._path("suppliers")),
            start_aggregate(orders.groupBy("order_id").agg(F.count("*").alias("version"), first.alias("first"), latest.alias("last")),
                            self._path("orders")),
        ]
        for query in queries:
            query.awaitTermination()

    @staticmethod
    def _critical(events: DataFrame) -> DataFrame:
        """CRITICAL delays, one for each event at most, and clock events."""
        from harborlight.functions import rules

        return keyed.with_clock(events, rules.delay_severity(F.col("delay_days")) == "CRITICAL")

    def suppliers(self) -> DataFrame:
        return windows.supplier_figures(state_rows(self.spark, self._path("suppliers"), windows.SUPPLIER_STATE))

    def orders(self) -> DataFrame:
        """Each order with its newest status, delay and stock, all else as it was first, and its number of events."""
        rows = self.spark.read.format("statestore").load(f"{self._path('orders')}/state").select(
            "key.order_id", F.col("value.count").alias("version"), F.col("value.min").alias("first"), F.col("value.max").alias("last"))
        return rows.select(
            *[F.col("order_id" if c == "order_id" else f"last.{c}" if c in UPDATED else f"first.{c}").alias(c) for c in ORDER_FIELDS],
            "version")

    def order_events(self) -> DataFrame:
        """The order log: every event with its version, old state and kind of change."""
        return history.order_log(table(self.orders_seen, self._path("events")))

    def deviations(self) -> DataFrame:
        """All deviations but the CRITICAL ones that were held back."""
        events = table(self.orders_seen, self._path("events"))
        passed = table(self.passed, self._path("accepted")).select("event_id")
        critical = self._found(events).filter(F.col("severity") == "CRITICAL").join(passed, "event_id", "left_semi")
        return table(self.other, self._path("deviations")).unionByName(critical)
