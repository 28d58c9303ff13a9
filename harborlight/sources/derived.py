"""Control-tower tables derived from the star-schema test tables.

One class per data folder. Dimensions are joined only when one of their columns
is asked for, and the fact table is read with just the columns those need.
No broadcast hints: Spark broadcasts a dimension when its size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import round_to
from harborlight.operators import deviations as dev
from harborlight.operators import orders as ord_ops
from harborlight.operators import suppliers as sup
from harborlight.sources.layers import built, fingerprint, materialized

RAW_COLUMNS = [
    "order_id", "supplier_id", "product", "region", "quantity", "unit_price", "order_value",
    "expected_delivery", "actual_delivery", "delay_days", "status", "inventory_level",
    "created_at", "_k1", "_k2",
]
ORDER_COLUMNS = RAW_COLUMNS[:13]


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def days(n: Column) -> Column:
    return F.make_dt_interval(n)


ORDER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


class Tables:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._state: str | None = None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @property
    def state(self) -> str:
        """What the files of the order tables look like; listed once per query. No layer reads other tables."""
        if self._state is None:
            self._state = fingerprint(self.spark, *[self.path(n) for n in ORDER_TABLES])
        return self._state

    def layer(self, name: str, build, bucket_by: str | None = None, share=None) -> DataFrame:
        return materialized(self.spark, name, self.folder, build, self.state, bucket_by, share)

    # -- orders -----------------------------------------------------------

    def order_anchor(self) -> Column:
        """Newest expected delivery, standing in for the current time."""
        return self.base("lineitem").agg(F.max("l_shipdate")).scalar()

    def event_anchor(self) -> Column:
        return self.base("events").agg(F.max("ts")).scalar()

    def raw_orders(self, *columns: str, share: tuple[int, int] | None = None) -> DataFrame:
        """One deliberately dirty order row per line item; with ``share`` (k, n) those of the k-th of n parts of the order keys."""
        wanted = list(columns) or RAW_COLUMNS

        def shared(df: DataFrame, key: str) -> DataFrame:
            return df if share is None else df.filter(F.pmod(F.xxhash64(key), F.lit(share[1])) == share[0])

        facts = shared(self.base("lineitem"), "l_orderkey").join(
            shared(self.base("orders"), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderdate"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        if {"supplier_id", "region"} & set(wanted):
            facts = facts.join(
                self.base("supplier").select("s_suppkey", "s_name", "s_nationkey"),
                F.col("l_suppkey") == F.col("s_suppkey"), "left",
            )
        if "region" in wanted:
            facts = facts.join(
                self.base("nation").select("n_nationkey", "n_regionkey"),
                F.col("s_nationkey") == F.col("n_nationkey"), "left",
            ).join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        if "product" in wanted:
            facts = facts.join(
                self.base("part").select("p_partkey", "p_name"),
                F.col("l_partkey") == F.col("p_partkey"), "left",
            )
        gap = F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(40))
        key = (F.col("l_partkey") + F.col("l_linenumber")) % 211
        dirt = (F.col("l_suppkey") + F.col("l_partkey")) % 101
        exprs = {
            "order_id": F.when(key == 0, "").when(
                key != 1, F.concat_ws("-", F.lit("ORD"), "l_orderkey", "l_linenumber")),
            "supplier_id": F.col("s_name"),
            "product": F.col("p_name"),
            "region": F.col("r_name"),
            "quantity": F.col("l_quantity").cast("int"),
            "unit_price": round_to(F.col("l_extendedprice") / F.col("l_quantity"), 2),
            "order_value": F.col("l_extendedprice"),
            "expected_delivery": F.col("l_shipdate"),
            "delay_days": F.when(dirt == 0, -1).when(dirt == 1, 400).when(
                dirt != 2, F.greatest(F.lit(0), gap - 20)),
            "inventory_level": (
                (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 101
            ).cast("double"),
            "created_at": F.col("o_orderdate"),
            "_k1": F.col("l_partkey"),
            "_k2": F.col("l_suppkey"),
        }
        delay = exprs["delay_days"]
        status = (
            F.when(F.col("l_partkey") % 53 == 0, "CRF")
            .when((F.col("o_orderstatus") == "P") & (F.col("l_returnflag") == "R"), "CANCELLED")
            .when(F.col("o_orderstatus") == "P", "PENDING")
            .when(F.col("o_orderstatus") == "O", "IN_TRANSIT")
            .when(delay > 0, "DELAYED")
            .otherwise("DELIVERED")
        )
        exprs["status"] = status
        exprs["actual_delivery"] = F.when(
            status.isin("DELIVERED", "DELAYED"),
            F.col("l_shipdate") + days(F.greatest(F.coalesce(delay, F.lit(0)), F.lit(0))),
        )
        return facts.select(*[exprs[c].alias(c) for c in wanted])

    def bronze_orders(self, *columns: str) -> DataFrame:
        """The raw order rows, read from their layer table."""
        return self.layer("bronze_orders", self.raw_orders, share=lambda k, n: self.raw_orders(share=(k, n))).select(
            *(columns or RAW_COLUMNS))

    def silver_orders(self) -> DataFrame:
        """The cleaned, one-row-per-id orders, read from their layer table.

        They come from the bronze layer if it is there; it is not written for them alone.
        """
        def build() -> DataFrame:
            ready = built(self.spark, "bronze_orders", self.folder, self.state)
            return ord_ops.silver_orders(self.bronze_orders() if ready else self.raw_orders())

        return self.layer("silver_orders", build, bucket_by="order_id")

    def outcome_orders(self) -> DataFrame:
        """Silver orders whose delay depends on region, stock and supplier, with noise from a hash of the id.

        The delays of the order table itself follow a modulus of its keys, of which a model can learn nothing.
        """
        noise = F.conv(F.substring(F.md5(F.concat(F.lit("late"), "order_id")), 1, 8), 16, 10).cast("long")
        chance = (
            F.lit(8) + F.when(F.col("region").isin("ASIA", "AFRICA"), 27).otherwise(0)
            + F.when(F.col("inventory_level") < 30, 30).otherwise(0)
            + F.when(F.substring("supplier_id", -2, 2) < "35", 25).otherwise(0))
        late = noise % 100 < chance
        return self.silver_orders().withColumn("delay_days", F.when(late, (noise % 20 + 1).cast("int")).otherwise(F.lit(0)))

    def staged_orders(self) -> DataFrame:
        return ord_ops.staged_orders(self.bronze_orders(*ORDER_COLUMNS))

    # -- suppliers and networks -------------------------------------------

    def supplier_places(self) -> DataFrame:
        return (
            self.base("supplier")
            .join(self.base("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )

    def suppliers(self) -> DataFrame:
        """Supplier master rows with running statistics; some lack a trust score."""
        risk = sup.supplier_risk(self.silver_orders())
        return (
            self.supplier_places()
            .select("s_suppkey", F.col("s_name").alias("supplier_id"), F.col("r_name").alias("region"))
            .join(risk, "supplier_id", "left")
            .select(
                "supplier_id",
                F.col("supplier_id").alias("name"),
                "region",
                F.when(F.col("s_suppkey") % 17 != 0, F.col("trust_score")).alias("trust_score"),
                "total_orders",
                "delayed_orders",
                "avg_delay_days",
                F.col("s_suppkey").alias("_key"),
            )
        )

    def policies(self) -> DataFrame:
        level = F.element_at(F.array(*[F.lit(x) for x in rules.SEVERITY_RANK]),
                             (F.col("s_suppkey") % 4 + 1).cast("int"))
        return self.base("supplier").select(
            F.col("s_name").alias("supplier_id"),
            level.alias("require_approval_at_severity"),
            (F.lit(20000.0) + F.lit(1000.0) * (F.col("s_suppkey") % 60)).alias(
                "require_approval_above_value"),
        )

    def freight_rates(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.supplier_places().select(
            F.when(key % 23 != 0, F.col("s_name")).alias("carrier"),
            F.col("n_name").alias("orig_port"),
            F.col("r_name").alias("dest_port"),
            F.abs("s_acctbal").alias("min_cost"),
            (key % 15).cast("int").alias("transit_days"),
            F.when(key % 2 == 0, " air ").otherwise("Ground").alias("mode"),
        )

    def wh_capacities(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.base("supplier").select(
            F.when(key % 29 != 0, F.col("s_name")).alias("plant_code"),
            ((key * 37) % 500).cast("int").alias("daily_capacity"),
        )

    def plant_ports(self) -> DataFrame:
        """Which plant ships to which port, read from its layer table."""
        return self.layer("plant_ports", self.derive_plant_ports)

    def derive_plant_ports(self) -> DataFrame:
        """Key pairs are made distinct before the names are joined."""
        pairs = (
            self.base("lineitem").select("l_orderkey", "l_suppkey")
            .join(self.base("orders").select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.base("customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .select("l_suppkey", "c_nationkey").distinct()
        )
        return (
            pairs.join(self.base("supplier").select("s_suppkey", "s_name"),
                       F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.base("nation").select("n_nationkey", "n_name"),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_name").alias("plant_code"), F.col("n_name").alias("port"))
        )

    def port_regions(self) -> DataFrame:
        return self.base("nation").join(
            self.base("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("n_name").alias("port"), F.col("r_name").alias("region"))

    def products_per_plant(self) -> DataFrame:
        return (
            self.base("lineitem").select("l_suppkey", "l_partkey").distinct()
            .join(self.base("part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .select("l_suppkey", "p_brand").distinct()
            .join(self.base("supplier").select("s_suppkey", "s_name"),
                  F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_name").alias("plant_code"), F.col("p_brand").alias("product_id"))
        )

    def constraints(self) -> DataFrame:
        return self.spark.createDataFrame(
            CONSTRAINTS,
            "id int, entity_id string, entity_type string, constraint_type string, "
            "value double, hard_limit boolean",
        )

    # -- deviations and actions -------------------------------------------

    def deviations(self, *keep: str) -> DataFrame:
        """Rule set 3 over silver orders, with the extra order columns asked for."""
        found = dev.all_matches(
            self.silver_orders(), *dict.fromkeys([*keep, "expected_delivery", "_k1", "_k2"])
        )
        return found.withColumn("detected_at", F.col("expected_delivery")).withColumn(
            "executed", F.col("_k1") % 3 == 0
        ).drop(*({"expected_delivery", "_k1", "_k2"} - set(keep)))

    def pending_actions(self) -> DataFrame:
        k1, k2 = F.col("_k1"), F.col("_k2")

        def pick(options: list[str], n: Column) -> Column:
            return F.element_at(F.array(*[F.lit(x) for x in options]), (n % len(options) + 1).cast("int"))

        confidence = F.when(k1 % 10 != 9, (k1 % 100) / F.lit(100.0))
        created = F.col("detected_at") + minutes((k1 % 25 + 5).cast("int"))
        status = pick(["PENDING", "COMPLETED", "CANCELLED", "FAILED"], k2)
        payload = F.to_json(F.struct(
            F.when((k1 + k2) % 3 != 0, F.concat(F.lit("ALT-"), k2.cast("string"))).alias("alternate_supplier_id"),
            F.col("severity"),
            F.col("order_value"),
            F.col("product"),
            confidence.alias("execution_confidence"),
            F.when(k1 % 3 == 0, k1 % 50 + 1).alias("recommended_quantity"),
        ))
        rows = self.deviations("order_value", "product", "_k1", "_k2").filter(
            F.col("severity").isin("HIGH", "CRITICAL")
        )
        return rows.select(
            F.concat(F.lit("ACT-"), F.col("deviation_id")).alias("action_id"),
            "deviation_id",
            pick(["REROUTE", "EXPEDITE", "SAFETY_STOCK", "NOTIFY"], k1).alias("action_type"),
            F.col("recommended_action").alias("description"),
            payload.alias("payload"),
            status.alias("status"),
            confidence.alias("confidence"),
            (k1 % 2 == 0).alias("resolved"),
            created.alias("created_at"),
            F.when(status == "COMPLETED", created + minutes((k2 % 120).cast("int"))).alias("completed_at"),
        )

    # -- events -----------------------------------------------------------

    def stream_events(self, source: DataFrame | None = None) -> DataFrame:
        """Typed order and demand events from the raw event rows (batch or stream)."""
        return typed_events(self.base("events") if source is None else source)

    def lineage_events(self) -> DataFrame:
        e = self.base("events")
        k = F.get_json_object("props", "$.k").try_cast("int")
        inputs = F.to_json(F.array(
            F.concat(F.lit("ds-"), (k % 30).cast("string")),
            F.concat(F.lit("ds-"), ((k + 7) % 30).cast("string")),
        ))
        return e.select(
            F.col("event_id").alias("run_id"),
            F.concat(F.lit("job-"), (F.col("user_id") % 40).cast("string")).alias("job_name"),
            F.when(F.col("event_type").isin("view", "signup"), "START")
            .when(F.col("event_type").isin("click", "purchase"), "COMPLETE")
            .otherwise("FAIL").alias("event_type"),
            inputs.alias("inputs"),
            F.concat(F.lit("ds-"), (F.lit(30) + F.col("user_id") % 40).cast("string")).alias("output"),
            F.col("ts").alias("created_at"),
        )

    def audit_log(self) -> DataFrame:
        def digest(prefix: str, n: Column) -> Column:
            return F.sha2(F.concat(F.lit(prefix), n.cast("string")), 256)

        n = F.col("event_id")
        return self.base("events").select(
            n.alias("id"),
            F.col("ts").alias("created_at"),
            F.when(n == 0, F.repeat(F.lit("0"), 64))
            .when(n % 997 == 5, digest("X", n))
            .when(n % 991 == 7, digest("E", n - 2))
            .otherwise(digest("E", n - 1)).alias("prev_hash"),
            digest("E", n).alias("row_hash"),
        )

    def escalations(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").try_cast("int")
        done = k % 2 == 0
        severity = F.element_at(F.array(*[F.lit(x) for x in rules.SEVERITY_RANK]), k % 4 + 1)
        return self.base("events").filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("id"),
            severity.alias("severity"),
            F.when(done, "RESOLVED").otherwise("OPEN").alias("status"),
            F.col("ts").alias("created_at"),
            F.when(done, F.col("ts") + minutes(k)).alias("resolved_at"),
        )


def typed_events(e: DataFrame) -> DataFrame:
    # inline keeps later filters above the JSON access, which so runs once per event
    number = F.get_json_object("props", "$.k").try_cast("int").alias("_k")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", F.inline(F.array(F.struct(number))))
    k = F.col("_k")
    delay = k % 20
    status = (
        F.when(F.col("event_type") == "view", "PENDING")
        .when(F.col("event_type") == "click", "IN_TRANSIT")
        .when(F.col("event_type") == "error", "BROKEN")
        .when((F.col("event_type") == "purchase") & (delay > 0), "DELAYED")
        .when(F.col("event_type") == "purchase", "DELIVERED")
    )
    regions = F.array(*[F.lit(r) for r in ("NA", "EMEA", "APAC", "LATAM")])
    return e.select(
        F.when(F.col("event_type") == "signup", "DEMAND_SPIKE").when(F.col("event_type") == "clock", "CLOCK")
        .otherwise("ORDER").alias("event_type"),
        "event_id",
        F.col("ts").alias("event_time"),
        F.concat(F.lit("EV-"), F.col("user_id").cast("string"), F.lit("-"),
                 (k % 10).cast("string")).alias("order_id"),
        F.concat(F.lit("SUP-"), (F.col("user_id") % 25).cast("string")).alias("supplier_id"),
        F.concat(F.lit("PROD-"), (k % 14).cast("string")).alias("product"),
        F.element_at(regions, (F.col("user_id") % 4 + 1).cast("int")).alias("region"),
        k.alias("quantity"),
        F.col("value").alias("unit_price"),
        (F.floor(F.col("value") * k * F.lit(1000.0) + F.lit(0.5)) / F.lit(100.0)).alias("order_value"),
        delay.alias("delay_days"),
        status.alias("status"),
        ((k * 37 + F.col("user_id")) % 101).cast("double").alias("inventory_level"),
        F.col("value").alias("forecast_delta_pct"),
        (k % 21).cast("double").alias("current_inventory_days"),
    )


# Our own fixture: constraint rows (id, entity, entity type, constraint type, value, hard limit).
CONSTRAINTS = [
    (1, "*", "GLOBAL", "max_delay_days", 7.0, True),
    (2, "*", "GLOBAL", "min_inventory_level", 20.0, True),
    (3, "*", "GLOBAL", "max_single_supplier_pct", 40.0, True),
    (4, "*", "GLOBAL", "anomaly_value_threshold", 100000.0, False),
    (5, "*", "GLOBAL", "min_trust_score_threshold", 0.70, True),
    (6, "Supplier#000000004", "SUPPLIER", "max_delay_days", 3.0, True),
    (7, "Supplier#000000007", "SUPPLIER", "min_trust_score", 0.95, True),
    (8, "Supplier#000000001", "SUPPLIER", "max_spend_usd", 50000.0, False),
    (9, "ASIA", "REGION", "max_spend_usd", 90000.0, False),
    (10, "EUROPE", "REGION", "max_delay_days", 5.0, True),
    (11, "AFRICA", "REGION", "min_inventory", 10.0, False),
    (12, "small ring", "PRODUCT", "max_delay_days", 2.0, True),
    (13, "red widget", "PRODUCT", "max_spend_usd", 60000.0, False),
    (14, "hot gear", "PRODUCT", "min_inventory_level", 14.0, True),
    (15, "Supplier#000000004", "SUPPLIER", "max_delay_rate_pct", 15.0, True),
    (16, "ASIA", "REGION", "max_avg_delay_days", 3.0, True),
    (17, "Supplier#000000002", "SUPPLIER", "sla_delivery_days", 60.0, True),
    (18, "EUROPE", "REGION", "max_single_supplier_pct", 5.0, True),
    (19, "AMERICA", "REGION", "max_delay_rate_pct", 99.0, False),
    (20, "Supplier#000000003", "SUPPLIER", "min_safety_stock_days", 14.0, True),
    (21, "Supplier#000000001", "SUPPLIER", "probation_flag", 1.0, True),
    (22, "nobody", "SUPPLIER", "max_delay_rate_pct", 10.0, True),
    (23, "small ring", "PRODUCT", "min_safety_stock_days", 14.0, True),
    (24, "ASIA", "REGION", "preferred_carrier_required", 1.0, False),
]
