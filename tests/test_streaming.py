import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from harborlight.operators import history
from harborlight.session import run_dir
from harborlight.sources import topics
from harborlight.streaming import keyed, late, running, stateful, validation, windows, writer

SCHEMA = ("event_id long, event_time timestamp, event_type string, order_id string, supplier_id string, product string, "
          "region string, quantity int, unit_price double, order_value double, delay_days int, status string, inventory_level double")
STATUSES = ["PENDING", "IN_TRANSIT", "DELIVERED", "DELAYED", "CANCELLED"]


def make_events(n, seed=1, suppliers=4, hot=0.4, gap=900):
    """Events in time order; one supplier and one order hold a large share."""
    rng = random.Random(seed)
    at, out = dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(seconds=rng.randrange(gap))
        busy = rng.random() < hot
        out.append((i, at, "ORDER", "O-hot" if busy else f"O{rng.randrange(20)}",
                    "S-hot" if busy else f"S{rng.randrange(suppliers)}", f"P{i % 3}", "EU", 1 + i % 9, 10.0,
                    rng.choice([50.0, 150000.0]), rng.choice([0, 0, 3, 9, 16]), rng.choice(STATUSES),
                    float(rng.randrange(100))))
    return out


CLOCK = (10**9, dt.datetime(2100, 1, 1), "CLOCK", *[None] * 10)


def shuffled(events, parts, seed=4, hours=20):
    """Batches of the events, each event up to so many hours late; at last a clock event."""
    rng = random.Random(seed)
    order = sorted(events, key=lambda e: e[1] + dt.timedelta(seconds=rng.randrange(hours * 3600)))
    size = -(-len(order) // parts)
    return [*(order[p * size:(p + 1) * size] for p in range(parts)), [CLOCK]]


@pytest.fixture(scope="module")
def events():
    return make_events(1200)


def as_stream(spark, events, parts):
    """The events as a stream of that many files, oldest first, one per batch."""
    path = run_dir(spark, "feed")
    size = -(-len(events) // parts)
    for p in range(parts):
        spark.createDataFrame(events[p * size:(p + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return topics.parquet_stream(spark, path, schema, files=1)


def health_by_hand(events):
    count, state, out = {}, {}, {}
    for e in events:
        s, bad = e[4], e[10] > 14 or e[12] < 5
        c, h = count.get(s, 0), state.get(s, "NORMAL")
        if bad:
            c += 1
            if h == "NORMAL" and c >= 2:
                h = "DEGRADING"
            elif h == "DEGRADING" and c >= 5:
                h = "CRITICAL"
        else:
            c = max(0, c - 1)
            if h == "CRITICAL" and c < 3:
                h = "DEGRADING"
            elif h == "DEGRADING" and c == 0:
                h = "NORMAL"
        count[s], state[s] = c, h
        out[e[0]] = (c, h)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_health_equals_going_through_the_events(spark, events, parts):
    """Also with events that come late, within the horizon."""
    got = running.drain(keyed.health(as_batches(spark, shuffled(events, parts))), "h").collect()
    assert {r.event_id: (r.anomaly_count, r.health) for r in got} == health_by_hand(events)
    assert {r.health for r in got} == {"NORMAL", "DEGRADING", "CRITICAL"}


def test_health_waits_for_the_watermark(spark, events):
    """Nothing comes out for events that the watermark has not passed; a restart goes on from the state."""
    path, base = run_dir(spark, "feed"), run_dir(spark, "h")
    seen = []
    for batch in (events[:600], events[600:], [CLOCK]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = topics.parquet_stream(spark, path, spark.read.parquet(path).schema, files=1)
        seen.append({r.event_id for r in running.drain(keyed.health(stream), "h", base).collect()})
    day = dt.timedelta(days=1)
    assert seen[0] == {e[0] for e in events if e[1] <= events[599][1] - day}
    assert seen[1] == {e[0] for e in events if e[1] <= events[-1][1] - day}
    assert seen[2] == {e[0] for e in events}


def accepted_by_hand(events):
    kept, out = {}, set()
    for e in sorted(events, key=lambda e: (int(e[1].timestamp()), e[0])):
        at, mine = int(e[1].timestamp()), kept.setdefault(e[4], [])
        if sum(1 for a in mine if a >= at - 86400) < 5:
            mine.append(at)
            out.add(e[0])
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_suppression_counts_accepted_alerts_only(spark, parts):
    rng = random.Random(5)
    at, alerts = dt.datetime(2024, 1, 1), []
    for i in range(900):
        at += dt.timedelta(seconds=rng.choice([0, 0, 0, 60, 4000]))
        alerts.append((i, at, "ORDER", f"O{i}", "S-hot" if i % 3 else "S1", "P", "EU", 1, 1.0, 1.0, 15, "DELAYED", 50.0))
    want = accepted_by_hand(alerts)
    got = running.drain(keyed.accepted_alerts(as_batches(spark, shuffled(alerts, parts))), "s").collect()
    assert {r.event_id for r in got} == want
    assert 0 < len(want) < len(alerts) / 4


def test_accepted_times_leave_the_state_after_a_day(spark):
    """The state's accepted times, read from the checkpoint before and after the day is over."""
    at = dt.datetime(2024, 1, 1)

    def alert(i, hours):
        return (i, at + dt.timedelta(hours=hours), "ORDER", "O", "S", "P", "EU", 1, 1.0, 1.0, 15, "DELAYED", 50.0)

    path, base = run_dir(spark, "feed"), run_dir(spark, "s")
    held = []
    clocks = [(10**9, at + dt.timedelta(hours=h), *CLOCK[2:]) for h in (30, 48.5, 80)]
    for batch in ([alert(0, 0), alert(1, 1), alert(2, 2)], *([c] for c in clocks)):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = topics.parquet_stream(spark, path, spark.read.parquet(path).schema, files=1)
        running.drain(keyed.accepted_alerts(stream), "s", base)
        rows = spark.read.format("statestore").option("stateVarName", "accepted").load(f"{base}/state")
        held.append(rows.count())
    assert held == [0, 3, 2, 0]


def causes_by_hand(events, horizon=7200):
    last, out = {}, {}
    for e in events:
        if e[12] < 10 and e[4] in last:
            eid, at = last[e[4]]
            if int(e[1].timestamp()) - int(at.timestamp()) <= horizon:
                out[e[0]] = eid
        if e[10] > 7:
            last[e[4]] = (e[0], e[1])
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_causes(spark, events, parts):
    got = running.drain(keyed.causes(as_batches(spark, shuffled(events, parts))), "c").collect()
    assert {r.event_id: r.delay_event for r in got} == causes_by_hand(events)


def as_batches(spark, batches):
    """One file for each batch, whatever the order of times."""
    path = run_dir(spark, "feed")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return topics.parquet_stream(spark, path, spark.read.parquet(path).schema, files=1)


def one(i, hour, delay, stock):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)
    return (i, at, "ORDER", "O", "S", "P", "EU", 1, 1.0, 1.0, delay, "DELAYED", stock)


@pytest.mark.parametrize("older", [None, 24, 56])
def test_an_older_delay_does_not_hide_a_newer_one(spark, older):
    """A delay at 58 h is known; a batch brings an older one and the stock-out at 59 h."""
    batch = [one(3, 59, 0, 5.0)] + ([one(2, older, 9, 50.0)] if older else [])
    found = keyed.causes(as_batches(spark, [[one(1, 58, 9, 50.0)], batch, [CLOCK]]), "100 hours")
    assert {r.event_id: r.delay_event for r in running.drain(found, "c").collect()} == {3: 1}


def test_causes_are_those_of_the_time_of_the_stock_out(spark):
    batches = [[one(0, 20, 9, 50.0)], [one(1, 3, 0, 5.0), one(2, 1, 9, 50.0)], [one(3, 21, 0, 5.0), one(4, 23, 0, 5.0)], [CLOCK]]
    got = running.drain(keyed.causes(as_batches(spark, batches)), "c").collect()
    # the delay at 20 h explains 21 h, not 3 h; the one at 1 h, which came later, explains 3 h
    assert {r.event_id: r.delay_event for r in got} == {1: 2, 3: 0}


def test_suppression_of_late_batches(spark):
    rng, at = random.Random(8), dt.datetime(2024, 1, 1)
    alerts = [(i, at + dt.timedelta(seconds=rng.randrange(5 * 86400)), "ORDER", f"O{i}", f"S{i % 2}", "P", "EU", 1, 1.0, 1.0, 15, "DELAYED", 50.0)
              for i in range(300)]
    batches = [*(alerts[k::3] for k in range(3)), [CLOCK]]
    got = running.drain(keyed.accepted_alerts(as_batches(spark, batches), "6 days"), "s").collect()
    assert {r.event_id for r in got} == accepted_by_hand(alerts)


def test_late_rows_are_recorded(spark, events):
    """The ledger agrees with what the aggregation counted and with what Spark says it dropped."""
    early, held = [e for e in events if e[0] % 7], [e for e in events if not e[0] % 7]
    path, base = run_dir(spark, "feed"), run_dir(spark, "late")
    for batch in (early, held):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = topics.parquet_stream(spark, path, spark.read.parquet(path).schema, files=1)
        ledger = late.record(stream, f"{base}/ledger")
        query = running.start_aggregate(windows.supplier_window_sums(stream), f"{base}/windows")
        query.awaitTermination()
        kept = running.drain_updates(windows.supplier_windows(stream), ["supplier_id", "window_start"], "w", f"{base}/updates")
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    mark = max(e[1] for e in early) - dt.timedelta(days=1)
    floor = [e[1].replace(minute=e[1].minute // 5 * 5, second=0, microsecond=0) for e in held]
    want = {e[0] for e, f in zip(held, floor) if f + dt.timedelta(minutes=5) <= mark}
    assert {r.event_id for r in ledger.filter("late").collect()} == want and want
    assert ledger.count() == len(events)
    assert kept.agg(F.sum("total_orders")).first()[0] == len(events) - len(want)
    assert dropped == len({(e[4], f) for e, f in zip(held, floor) if e[0] in want})  # summed up before they are dropped


def test_windows_from_the_state(spark, events):
    """Sums read from the checkpoint are those of all rows, batch after batch."""
    base = run_dir(spark, "state")
    running.start_aggregate(windows.supplier_window_sums(as_stream(spark, events, 3), "3650 days"), base).awaitTermination()
    got = windows.supplier_window_figures(running.state_rows(spark, base, windows.SUPPLIER_WINDOW_STATE))
    want = windows.supplier_windows(spark.createDataFrame(events, SCHEMA))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def versions_by_hand(events):
    seen, out = {}, {}
    for e in events:
        old = seen.get(e[3])
        if old is None:
            kind, version = "CREATED", 1
        else:
            version = old[2] + 1
            if old[0] != e[11]:
                kind = e[11] if e[11] in ("DELIVERED", "CANCELLED") else "STATUS_CHANGED"
            else:
                kind = "DELAY_UPDATED" if old[1] != e[10] else "SNAPSHOT"
        seen[e[3]] = (e[11], e[10], version)
        out[e[0]] = (version, kind, old[0] if old else None)
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_order_writer_keeps_all_tables(spark, events, parts):
    w = writer.OrderWriter(spark, run_dir(spark, "w"))
    w.run(as_batches(spark, shuffled(events, parts)))
    log = {r.event_id: (r.aggregate_version, r.event_type, r.old_status) for r in w.order_events().collect()}
    assert log == versions_by_hand(events)

    first, last = {e[3]: e for e in reversed(events)}, {e[3]: e for e in events}
    orders = {r.order_id: r for r in w.orders().collect()}
    assert {k: (v.status, v.delay_days, v.event_id) for k, v in orders.items()} == {k: (e[11], e[10], e[0]) for k, e in last.items()}
    assert {k: (v.supplier_id, v.quantity) for k, v in orders.items()} == {k: (e[4], e[7]) for k, e in first.items()}
    assert {k: v.version for k, v in orders.items()} == {k: sum(e[3] == k for e in events) for k in last}

    suppliers = {r.supplier_id: r for r in w.suppliers().collect()}
    for s in {e[4] for e in events}:
        mine = [e for e in events if e[4] == s]
        late_ones = sum(e[10] > 0 for e in mine)
        assert (suppliers[s].total_orders, suppliers[s].delayed_orders) == (len(mine), late_ones)
        assert abs(suppliers[s].avg_delay_days - sum(e[10] for e in mine) / len(mine)) < 1e-9
        assert abs(suppliers[s].trust_score - (1 - 0.5 * late_ones / len(mine))) < 1e-9

    critical = [e for e in events if e[10] > 14]
    passed = {r.event_id for r in w.deviations().filter("severity = 'CRITICAL'").collect()}
    assert passed == accepted_by_hand(critical)


def test_order_writer_goes_on_where_it_stopped(spark, events):
    path, base = run_dir(spark, "feed"), run_dir(spark, "again")
    for batch in (events[:400], events[400:800], [], [CLOCK]):
        if batch:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        w = writer.OrderWriter(spark, base)
        w.run(topics.parquet_stream(spark, path, spark.read.parquet(path).schema, files=1))  # once without anything new
    assert w.order_events().count() == 800
    assert w.suppliers().agg(F.sum("total_orders")).first()[0] == 800
    assert w.orders().agg(F.sum("version")).first()[0] == 800
    assert {r.event_id for r in w.deviations().filter("severity = 'CRITICAL'").collect()} == accepted_by_hand(
        [e for e in events[:800] if e[10] > 14])


def test_window_updates_over_batches_equal_batch_result(spark, events):
    out = running.drain_updates(
        windows.supplier_windows(as_stream(spark, events, 4), "3650 days"), ["supplier_id", "window_start"], "win")
    got = {(r.supplier_id, r.window_start.isoformat()): (r.total_orders, r.delayed_orders) for r in out.collect()}
    want = {}
    for e in events:
        start = e[1].replace(minute=e[1].minute // 5 * 5, second=0, microsecond=0).isoformat()
        n, late = want.get((e[4], start), (0, 0))
        want[(e[4], start)] = (n + 1, late + (e[10] > 0))
    assert got == want


def test_critical_stream_counts_seven_days(spark, events):
    out = windows.critical_delays(spark.createDataFrame(
        [e[:10] + (d,) + e[11:] for e, d in zip(events, (6, 7, 8))], SCHEMA))
    assert sorted(r.delay_days for r in out.collect()) == [7, 8]


def message(spark, **changes):
    good = {"event_type": "ORDER", "order_id": "O", "supplier_id": "S", "product": "P", "region": "EU", "quantity": 1,
            "unit_price": 0.0, "order_value": 0.0, "expected_delivery": "2024-01-01", "delay_days": 0,
            "status": "PENDING", "inventory_level": 100.0}
    import json

    body = {k: v for k, v in {**good, **changes}.items() if v is not None}
    df = spark.createDataFrame([(json.dumps(body),)], "value string")
    return validation.with_errors(validation.parse_json(df)).first().errors


@pytest.mark.parametrize("changes,errors", [
    ({}, []), ({"order_id": None}, ["order_id"]), ({"order_id": ""}, ["order_id"]), ({"quantity": 0}, ["quantity"]),
    ({"status": "BROKEN"}, ["status"]), ({"inventory_level": 100.5}, ["inventory_level"]),
    ({"expected_delivery": None, "delay_days": -1}, ["expected_delivery", "delay_days"]),
    ({"event_type": "OTHER", "quantity": 0}, []), ({"event_type": None, "quantity": 0}, ["quantity"]),
    ({"event_type": "DEMAND_SPIKE", "forecast_delta_pct": 5.0}, []),
    ({"event_type": "DEMAND_SPIKE"}, ["forecast_delta_pct"]),
    ({"event_type": "DEMAND_SPIKE", "forecast_delta_pct": 5.0, "current_inventory_days": -1.0}, ["current_inventory_days"]),
])
def test_event_rules(spark, changes, errors):
    assert message(spark, **changes) == errors


def test_text_that_is_no_json_fails(spark):
    df = spark.createDataFrame([("{bro",), (None,)], "value string")
    assert all(r.errors for r in validation.with_errors(validation.parse_json(df)).collect())


def test_order_log_numbers_a_hot_order_across_slices(spark, events):
    df = spark.createDataFrame(events, SCHEMA)
    for unit in ("HOUR", "DAY", "YEAR"):
        out = history.with_previous(df, "order_id", "event_time", "event_id", ["status"], unit)
        got = {r.event_id: (r.version, r.old_status) for r in out.collect()}
        assert got == {k: (v, o) for k, (v, _, o) in versions_by_hand(events).items()}


def test_replay_keeps_the_last_known_values(spark):
    log = spark.createDataFrame(
        [("O", 1, "PENDING", 0), ("O", 2, None, 4), ("O", 3, "DELAYED", None), ("O", 4, "DELIVERED", 9)],
        "order_id string, aggregate_version long, new_status string, new_delay_days int")
    row = history.state_at(log, 3).first()
    assert (row.status, row.delay_days, row.version) == ("DELAYED", 4, 3)


def test_audit_findings(spark, rows):
    g = "0" * 64
    chain = [(1, g, "a"), (2, "a", "b"), (3, "b", "c"), (4, "b", "d"), (5, "zz", "e"), (6, "f", "f")]
    log = spark.createDataFrame(chain, "id long, prev_hash string, row_hash string")
    got = {r["prev_hash"]: (r["broken"], r["fork"]) for r in rows(history.audit_findings(log))}
    assert got == {"b": (False, True), "zz": (True, False), "f": (True, False)}


def test_lineage(spark):
    runs = spark.createDataFrame(
        [("j", "COMPLETE", '["a","b"]', "c"), ("j", "COMPLETE", '["a"]', "c"), ("j", "FAIL", '["x"]', "y"),
         ("k", "COMPLETE", "not json", None), ("m", "COMPLETE", None, "d")],
        "job_name string, event_type string, inputs string, output string")
    assert {(r.source, r.target) for r in history.lineage_edges(runs).collect()} == {
        ("a", "j"), ("b", "j"), ("j", "c"), ("m", "d")}


def test_health_state_rows_are_per_supplier(spark, events):
    path = stateful.health_path(spark.createDataFrame(events, SCHEMA))
    assert {r.event_id: (r.anomaly_count, r.health) for r in path.collect()} == health_by_hand(events)
    state = {r.supplier_id: (r.anomaly_count, r.health) for r in stateful.health_state(path).collect()}
    hand, last = health_by_hand(events), {e[4]: e[0] for e in events}
    assert state == {s: hand[i] for s, i in last.items()}
