"""Time the headline queries and print one JSON line.

Layer tables are built first and timed as such; the queries read them. Each
query runs twice and the second, warm run counts. BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Results go to Spark's noop sink, so every row is produced and
none is sent to Python. BENCH_ALL=1 times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harborlight import registry, session  # noqa: E402
from harborlight.sources.derived import Tables  # noqa: E402

WARM_LIMIT = 20.0

HEADLINE = [
    "silver_orders", "supplier_risk", "stg_orders", "fct_shipments", "coerce_orders", "dim_suppliers",
    "upsert_keep_last", "upsert_partial", "dq_suite", "dq_contract_orders", "build_order_event",
    "layer_metrics", "gold_orders", "deviations_v3", "alerts_enriched", "actions_audit", "action_gate",
    "supplier_benchmarks", "supplier_scorecard", "cost_analytics", "decay_risk", "forecasted_risks",
    "delay_predictions", "applicable_constraints", "order_timeline", "rolling_critical",
    "order_event_log", "audit_chain", "lineage_graph", "network_betweenness", "feature_gates",
    "label_encode", "score_drift", "demand_trend_product", "injection_scan", "text_sanitize",
    "stream_supplier_5m", "stream_process_batch", "stream_health", "stream_suppress",
]

MORE = ["ml_score_checks", "ml_split", "medallion_run", "demand_forecast_all", "constraint_report"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    found = registry.all_queries()
    names = list(found) if os.environ.get("BENCH_ALL") else HEADLINE + MORE
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}

    def timed(label: str, job) -> float:
        start = time.perf_counter()
        job()
        times[label] = round(time.perf_counter() - start, 3)
        print(f"{label} {times[label]}", file=sys.stderr, flush=True)
        return times[label]

    t = Tables(spark, folder)
    timed("layer_bronze_orders", t.bronze_orders)
    timed("layer_silver_orders", t.silver_orders)
    timed("layer_plant_ports", t.plant_ports)
    for name in names:
        def job(q=found[name]):
            q(spark, folder).write.format("noop").mode("overwrite").save()

        # the second run is the figure: the first one also compiles
        if timed(name, job) < WARM_LIMIT:
            timed(name, job)
    spark.stop()
    value = sum(v for k, v in times.items() if k not in MORE)
    print(json.dumps({
        "metric": "total_query_time", "value": round(value, 3), "unit": "sec", "not_in_value": MORE,
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
