"""Quality rules, features, drift and the network against small hand-made inputs."""

import collections
import datetime as dt
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.operators import asof, features, forecast, graph, learning, quality


def test_rules_on_nulls(spark, rows):
    df = spark.createDataFrame(
        [("a", 5, "DTD"), (None, None, None), ("a", 400, "NOPE")], "order_id string, delay_days int, status string")
    got = {r["rule"]: (r["passed"], r["failed_count"]) for r in rows(quality.run_suite(df))}
    assert got == {"expect_order_id_not_null": (False, 1), "expect_delay_days_between": (False, 1), "expect_status_in_set": (False, 2)}
    extra = [quality.Rule("unique", "order_id"), quality.Rule("accepted", "status", values=("DTD",)), quality.Rule("not_null", "absent")]
    got = {r["rule"]: r["failed_count"] for r in rows(quality.evaluate(df, extra))}
    assert got == {"expect_order_id_unique": 1, "expect_status_accepted": 1}


def test_rules_run_in_one_aggregate(spark):
    df = spark.createDataFrame([("a", 5, "DTD")], "order_id string, delay_days int, status string")
    plan = quality.run_suite(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_silver_audit_counts_repeats_like_a_set(spark, rows):
    df = spark.createDataFrame([("a", "s", "PENDING", 0), ("a", "s", "X", -1), (None, None, None, -2), (None, "s", "DELAYED", 366)],
                               "order_id string, supplier_id string, status string, delay_days int")
    got = {r["metric"]: r["value"] for r in rows(quality.silver_audit(df))}
    assert got == {"null_order_id": 2, "null_supplier_id": 1, "null_status": 1, "invalid_status_count": 2,
                   "delay_days_out_of_range": 2, "duplicate_order_ids": 2}


def test_formula_tolerance(spark, rows):
    df = spark.createDataFrame(
        [("ok", 3000.0, 30, 60.0, 15000.0), ("near", 3000.0, 30, 61.1, 15000.0), ("bad", 3000.0, 30, 62.0, 16000.0), ("none", 0.0, 30, 9.0, 9.0)],
        "order_id string, order_value double, delay_days int, carrying_cost double, delay_cost double")
    got = {(r["order_id"], r["field"]): r["error_pct"] for r in rows(quality.formula_mismatches(df))}
    assert got == {("bad", "carrying_cost"): 3.3, ("bad", "delay_cost"): 6.7}


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "A int, c int")
    assert [r.missing_column for r in quality.missing_columns(df, ["a", "b"]).collect()] == ["b"]
    assert quality.missing_columns(df, ["a"]).count() == 0


def test_gates(spark, rows):
    df = spark.createDataFrame([(float(i), float((i * 7) % 11), None if i < 10 else 1.0) for i in range(100)], "a double, b double, n double")
    feats = {"sum": "a * b", "same": "a * 3", "one": "2", "gap": "n", "inf": "CASE WHEN a = 1 THEN CAST('Infinity' AS DOUBLE) ELSE b END", "big": "a * 1e12"}
    got = {r["feature"]: r["failed_gate"] for r in rows(features.gates(df, feats, ["a", "b"]))}
    assert got == {"sum": None, "same": "novelty", "one": "variance", "gap": "nulls", "inf": "distribution", "big": "distribution"}


def auc_by_hand(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rng = random.Random(3)
    data = [("m", rng.choice([0.1, 0.2, 0.3]), rng.random() < 0.4) for _ in range(300)]
    row = features.auc_by_period(spark.createDataFrame(data, "m string, s double, y boolean"), "m", "s", "y").first()
    assert row.rows == 300 and abs(row.roc_auc - auc_by_hand([d[1] for d in data], [d[2] for d in data])) < 1e-4


def test_drift_decisions(spark):
    auc = spark.createDataFrame([("1", 500, 0.80), ("2", 500, 0.82), ("3", 50, 0.90), ("4", 500, 0.74), ("5", 500, 0.55), ("6", 500, None)],
                                "month string, rows long, roc_auc double")
    got = {r.month: (r.retrain, r.promotion) for r in features.drift(auc, "month").collect()}
    assert got == {"1": (False, "CANDIDATE"), "2": (False, "CANDIDATE"), "3": (False, "TOO_FEW_ROWS"),
                   "4": (True, "NOT_BETTER"), "5": (True, "BELOW_FLOOR"), "6": (False, "BELOW_FLOOR")}


def test_label_codes_are_alphabetical_and_unknown_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("Z",), (None,), ("a",)], "supplier_id string")
    codes = features.label_codes(train, "supplier_id")
    assert {r.supplier_id: r.supplier_id_enc for r in codes.collect()} == {"UNKNOWN": 0, "Z": 1, "a": 2, "b": 3}
    new = spark.createDataFrame([("b",), ("new",)], "supplier_id string")
    got = features.encode(new, ["supplier_id"], {"supplier_id": codes})
    assert {r.supplier_id: r.supplier_id_enc for r in got.collect()} == {"b": 3, "new": 0}


def betweenness_by_hand(edges):
    nodes = sorted({x for e in edges for x in e})
    out = collections.defaultdict(set)
    for u, v in edges:
        if u != v:
            out[u].add(v)

    def paths(s, t):
        """All shortest paths from s to t."""
        level, seen = [[s]], {s}
        while level:
            done = [p for p in level if p[-1] == t]
            if done:
                return done
            level = [p + [v] for p in level for v in out[p[-1]] if v not in seen]
            seen |= {p[-1] for p in level}
        return []

    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                score[v] += 1 / len(found)
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_on_a_graph_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(20)})
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "source string, target string")
    got = {r.id: r.betweenness for r in graph.betweenness(df).collect()}
    want = betweenness_by_hand(edges)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_of_a_long_path(spark):
    edges = [(f"{i:02d}", f"{i + 1:02d}") for i in range(30)]
    got = {r.id: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "source string, target string")).collect()}
    assert all(abs(got[f"{i:02d}"] - i * (30 - i) / (30 * 29)) < 1e-9 for i in range(31))


def test_plant_to_port_edges_have_no_inner_nodes(spark):
    df = spark.createDataFrame([("A", "x"), ("B", "x"), ("A", "x"), ("", "x")], "plant_code string, port string")
    edges = graph.edges(df)
    assert edges.count() == 2
    assert {r.betweenness for r in graph.cascade_risk(edges).collect()} == {0.0}
    deg = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(edges).collect()}
    assert deg == {"plant:A": (0, 1), "plant:B": (0, 1), "port:x": (2, 0)}


def test_delay_model_learns_and_its_metrics_add_up(spark):
    from harborlight.operators import learning

    df = spark.range(4000).select(
        F.concat(F.lit("O"), F.col("id")).alias("order_id"), (F.col("id") % 5).alias("supplier_id_enc"),
        (F.col("id") % 3).alias("region_enc"), (F.col("id") % 50).alias("quantity"),
        F.when(F.col("id") % 7 != 0, 2.5).alias("unit_price"), (F.col("id") % 100).cast("double").alias("order_value"),
        (F.col("id") % 90).cast("double").alias("inventory_level"),
        F.when((F.col("id") % 50 > 30) | (F.col("id") % 11 == 0), 5).otherwise(0).alias("delay_days"))
    rows = learning.labelled(df)
    share = rows.agg(F.avg(F.col("train").cast("int"))).first()[0]
    assert 0.76 < share < 0.84
    assert rows.filter("unit_price IS NULL").count() == 0
    assert learning.train(rows.limit(learning.MIN_ROWS - 1)) is None
    plain = learning.score(None, rows)
    assert plain.columns == ["order_id", "label", "train", "probability", "is_delayed", "confidence"]
    assert {r.confidence for r in plain.collect()} == {"LOW"}
    few = learning.sampled(rows, rows.count() // 2)
    assert 0 < few.count() < rows.count() and learning.sampled(rows, 10**9).count() == rows.count()
    scored = learning.score(learning.train(rows, trees=3), rows).cache()
    m = learning.metrics(scored).first()
    test = scored.filter("NOT train").collect()
    assert m.test_rows == len(test) and m.train_rows + m.test_rows == 4000
    hits = [(r.is_delayed, r.label == 1.0) for r in test]
    assert abs(m.accuracy - sum(a == b for a, b in hits) / len(hits)) < 1e-4
    assert abs(m.precision - sum(a and b for a, b in hits) / sum(a for a, _ in hits)) < 1e-4
    assert abs(m.roc_auc - auc_by_hand([r.probability for r in test], [r.label == 1.0 for r in test])) < 1e-4
    assert m.roc_auc > 0.85
    assert {r.confidence for r in test} <= {"HIGH", "MEDIUM", "LOW"}


def test_a_bent_series_goes_on_with_its_last_slope(spark):
    start = dt.date(2024, 1, 1)
    rows = [("bent", start + dt.timedelta(days=i), 1000.0 + 2 * i + (0 if i < 100 else 30 * (i - 100))) for i in range(200)]
    rows += [("straight", start + dt.timedelta(days=i), 500.0 - i) for i in range(200)]
    rows += [("short", start + dt.timedelta(days=i), 1.0) for i in range(9)] + [(None, start + dt.timedelta(days=i), 7.0) for i in range(20)]
    rows += [("gap", start + dt.timedelta(days=i), 5.0 * i) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 400)]
    daily = spark.createDataFrame(rows, "k string, ds date, y double")
    got = {}
    for r in forecast.bent_forecast(daily, "k").collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {"bent", "straight", "gap", None} and all(len(v) == 30 for v in got.values())
    last = {k: max(v, key=lambda r: r.ds) for k, v in got.items()}
    true = 1000 + 2 * 229 + 30 * 129
    assert abs(last["bent"].yhat - true) < 0.02 * true and last["bent"].ds == str(start + dt.timedelta(days=229))
    line = [r for r in forecast.trend_forecast(daily, "k").collect() if r.k == "bent"]
    assert abs(max(line, key=lambda r: r.ds).yhat - true) > 0.1 * true  # one line misses it
    assert abs(last["straight"].yhat - (500 - 229)) < 0.5 and abs(last[None].yhat - 7) < 0.01
    assert last["bent"].yhat_lower < last["bent"].yhat < last["bent"].yhat_upper
    one = forecast.bent_forecast(daily.filter("k = 'bent'").drop("k")).collect()
    assert len(one) == 30 and {r.yhat for r in one} == {r.yhat for r in got["bent"]}


def test_solved_against_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((6, 6))
    a, b = a @ a.T + np.eye(6), rng.standard_normal(6)
    df = spark.createDataFrame([([[*map(float, row), float(v)] for row, v in zip(a, b)],)], "m array<array<double>>")
    found = df.select(forecast.solved(F.col("m"), 6).alias("x")).first().x
    assert np.allclose(found, np.linalg.solve(a, b))


def plain_betweenness(links):
    """Brandes' walk from every node."""
    out, ids = {}, {x for e in links for x in e}
    for a, b in links:
        out.setdefault(a, []).append(b)
    score = dict.fromkeys(ids, 0.0)
    for s in ids:
        order, before, paths, far = [], {x: [] for x in ids}, dict.fromkeys(ids, 0), {s: 0}
        paths[s], queue = 1, [s]
        while queue:
            u = queue.pop(0)
            order.append(u)
            for v in out.get(u, ()):
                if v not in far:
                    far[v] = far[u] + 1
                    queue.append(v)
                if far[v] == far[u] + 1:
                    paths[v] += paths[u]
                    before[v].append(u)
        share = dict.fromkeys(ids, 0.0)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                score[v] += share[v]
    n = len(ids)
    return {x: v / ((n - 1) * (n - 2)) for x, v in score.items()}


def test_betweenness_from_pivots(spark):
    rng = random.Random(1)
    links = sorted({(f"a{rng.randrange(60)}", f"b{rng.randrange(8)}") for _ in range(120)} | {(f"b{rng.randrange(8)}", f"c{rng.randrange(60)}") for _ in range(120)})
    exact = plain_betweenness(links)
    edges = spark.createDataFrame(links, "source string, target string")
    assert all(abs(r.betweenness - exact[r.id]) < 1e-9 for r in graph.betweenness(edges).collect())
    error = 0.25
    k = graph.pivot_count(len(exact), error)
    assert k < len(exact)
    found = {r.id: r.betweenness for r in graph.sampled_betweenness(edges, error).collect()}
    assert found.keys() == exact.keys() and all(abs(found[x] - exact[x]) <= error for x in exact)
    assert any(found[x] != exact[x] for x in exact)
    assert graph.pivot_count(10_000) < 4000 and graph.pivot_count(10**9) < 6000 and graph.pivot_count(2) == 2


@pytest.mark.parametrize("n", [0, 1, 9, 1003])
def test_split_is_exact_for_each_class(spark, n):
    df = spark.createDataFrame([(f"o{i}", float(i % 7 == 0)) for i in range(n)], "order_id string, label double")
    got = learning.stratified(df, "label", learning.draw_of(F.col("order_id")), "order_id").collect()
    for c in (0.0, 1.0):
        mine = sorted((r for r in got if r.label == c), key=lambda r: (hashlib.md5(r.order_id.encode()).hexdigest()[:8], r.order_id))
        assert [r.train for r in mine] == [i < len(mine) * 8 // 10 for i in range(len(mine))]
    assert len(got) == n


def test_split_with_equal_draws(spark):
    df = spark.createDataFrame([(f"o{i:03d}", "c") for i in range(25)], "order_id string, label string")
    got = learning.stratified(df, "label", F.lit(7).cast("long"), "order_id").collect()
    assert [r.train for r in sorted(got, key=lambda r: r.order_id)] == [i < 20 for i in range(25)]


@pytest.mark.parametrize("parts", [1, 4])
def test_as_of(spark, parts):
    rng = random.Random(parts)
    at = dt.datetime(2024, 1, 1)
    versions = [(rng.choice(["hot", "hot", "hot", "b", None]), at + dt.timedelta(seconds=rng.randrange(5000)), f"v{i:04d}") for i in range(300)]
    rows = [(i, rng.choice(["hot", "hot", "b", "none", None]), at + dt.timedelta(seconds=rng.randrange(5000))) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = asof.latest_before(
            spark.createDataFrame(rows, "id int, k string, at timestamp"), spark.createDataFrame(versions, "k string, made timestamp, name string"),
            ["k"], F.col("at"), F.col("made"), F.col("name"), F.col("name"), "newest").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for i, k, t in rows:
        held = [(m, v) for q, m, v in versions if k is not None and q == k and m <= t]
        want[i] = max(held)[1] if held else None
    assert {r.id: r.newest for r in found} == want and len(found) == 300
    assert sum(v is None for v in want.values()) < 250
