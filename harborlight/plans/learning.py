"""Delay classifier queries. The model is trained once per session and input."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, ratio, round_to
from harborlight.operators import features as feat
from harborlight.operators import learning as ops
from harborlight.oracle import TABLES, rnd
from harborlight.plans.history import FEATURES, GATES, NUMERIC
from harborlight.registry import query
from harborlight.session import app_dir, path_exists


def rows(t):
    """Labelled rows, written once: training passes over them many times."""
    return t.layer("labelled_orders", lambda: ops.labelled(
        feat.encode(t.outcome_orders(), ["supplier_id", "region"])))


def model(t):
    key = f"{t.folder.strip('/').replace('/', '_')}-{t.state}"
    path = app_dir(t.spark, f"delay-model-{key}")
    if not path_exists(t.spark, f"{path}/metadata/_SUCCESS"):
        ops.train(rows(t)).write().overwrite().save(path)
    return PipelineModel.load(path)


@query("ml_train", "K09")
def ml_train(t):
    """Feature importances of the trained model."""
    found = ops.importances(model(t))
    size = rows(t).filter("train").agg(F.count("*")).scalar()
    return t.spark.createDataFrame(found, "feature string, importance double").select(
        "feature", round_to("importance", 6).alias("importance"), size.alias("train_rows"))


@query("ml_score", "K11")
def ml_score(t):
    return ops.score(model(t), rows(t)).drop("train", "label")


@query("ml_metrics", "K10")
def ml_metrics(t):
    return ops.metrics(ops.score(model(t), rows(t)))


TABLES["outcome_orders"] = """
SELECT * REPLACE (CASE WHEN noise % 100 < 8 + CASE WHEN region IN ('ASIA', 'AFRICA') THEN 27 ELSE 0 END
    + CASE WHEN inventory_level < 30 THEN 30 ELSE 0 END + CASE WHEN right(supplier_id, 2) < '35' THEN 25 ELSE 0 END
  THEN noise % 20 + 1 ELSE 0 END::INTEGER AS delay_days)
FROM (SELECT *, ('0x' || substr(md5('late' || order_id), 1, 8))::BIGINT AS noise FROM silver_orders)"""
TABLES["split_orders"] = """
SELECT *, delay_days > 0 AS late, row_number() OVER (PARTITION BY delay_days > 0 ORDER BY substr(md5(order_id), 1, 8), order_id)
  <= floor(count(*) OVER (PARTITION BY delay_days > 0) * 8 / 10) AS train FROM outcome_orders"""


@query("ml_split", "K09", f"""
SELECT train, count(*) AS rows, count(*) FILTER (WHERE late) AS late,
  {rnd("count(*) FILTER (WHERE late)::DOUBLE / count(*)", 4)} AS late_share,
  count(*) FILTER (WHERE late) = (SELECT CASE WHEN s.train THEN floor(n * 8 / 10) ELSE n - floor(n * 8 / 10) END
    FROM (SELECT count(*) AS n FROM outcome_orders WHERE delay_days > 0)) AS exact
FROM split_orders s GROUP BY 1""")
def ml_split(t):
    """Both sides of the split and their classes; the training side has eight tenths of each, to the row."""
    late = count_if(F.col("label") == 1.0)
    every = rows(t).agg(count_if(F.col("label") == 1.0)).scalar()
    wanted = F.floor(every * 8 / 10)
    return rows(t).groupBy("train").agg(
        F.count("*").alias("rows"), late.alias("late"), round_to(ratio(late, F.count("*")), 4).alias("late_share")).withColumn(
        "exact", F.col("late") == F.when(F.col("train"), wanted).otherwise(every - wanted))


@query("ml_score_checks", "K11 K09", """
SELECT count(*) AS rows, count(*) AS in_range, count(*) AS class_agrees, count(*) AS bucket_agrees, true AS varies FROM silver_orders""")
def ml_score_checks(t):
    """How many scores lie in range and agree with their class and bucket: all of them."""
    p, c = F.col("probability"), F.col("confidence")
    near = F.least(F.abs(p - 0.5), F.abs(p - 0.75)) < 0.0001  # rounded at the border
    bucket = F.when(p >= 0.75, "HIGH").when(p >= 0.5, "MEDIUM").otherwise("LOW")
    return ops.score(model(t), rows(t)).agg(
        F.count("*").alias("rows"), count_if(p.between(0, 1)).alias("in_range"),
        count_if(near | (F.col("is_delayed") == (p >= 0.5))).alias("class_agrees"),
        count_if(near | (c == bucket)).alias("bucket_agrees"), (F.countDistinct("probability") > 10).alias("varies"))


@query("ml_metrics_checks", "K10", f"""
SELECT count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE NOT train) AS test_rows,
  {rnd("greatest(count(*) FILTER (WHERE late AND NOT train), count(*) FILTER (WHERE NOT late AND NOT train))::DOUBLE / count(*) FILTER (WHERE NOT train)", 4)} AS majority,
  (SELECT {rnd('(sum(r) FILTER (WHERE late) - count(*) FILTER (WHERE late) * (count(*) FILTER (WHERE late) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE late)::DOUBLE * count(*) FILTER (WHERE NOT late))', 4)}
   FROM (SELECT late, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM (
     SELECT late, (inventory_level < 100)::INT * 6 + (order_value > 10000)::INT * 4 + (quantity > 500)::INT * 3 AS p
     FROM split_orders WHERE NOT train))) AS heuristic_auc,
  true AS beats_majority, true AS beats_heuristic, true AS in_range FROM split_orders""")
def ml_metrics_checks(t):
    """The model against the majority class and the heuristic, on the test side."""
    test = rows(t).filter(~F.col("train"))
    plain = rules.heuristic_probability(F.col("inventory_level"), F.col("order_value"), F.col("quantity"))
    heuristic = feat.auc_by_period(
        test.select(F.lit("all").alias("p"), plain.alias("s"), (F.col("label") == 1.0).alias("late")), "p", "s", "late")
    late = F.avg("label")
    majority = test.agg(F.greatest(late, 1 - late).alias("m"))
    m = ops.metrics(ops.score(model(t), rows(t)))
    figures = [F.col(c) for c in ("accuracy", "precision", "recall", "roc_auc")]
    in_range = figures[0].between(0, 1)
    for f in figures[1:]:
        in_range = in_range & f.between(0, 1)
    share, plain_auc = round_to(majority.scalar(), 4), heuristic.select("roc_auc").scalar()
    return m.select(
        "train_rows", "test_rows", share.alias("majority"), plain_auc.alias("heuristic_auc"),
        (F.col("accuracy") >= share).alias("beats_majority"), (F.col("roc_auc") > plain_auc).alias("beats_heuristic"),
        in_range.alias("in_range"))


TABLES["split_silver"] = """
SELECT row_number() OVER (PARTITION BY delay_days > 0 ORDER BY substr(md5(order_id), 1, 8), order_id)
  <= floor(count(*) OVER (PARTITION BY delay_days > 0) * 8 / 10) AS train FROM silver_orders"""


@query("ml_features_used", "K09 K17 K18 D07", f"""
SELECT feature, passed AS used, (SELECT count(*) FROM split_silver WHERE train) AS train_rows FROM ({GATES})""")
def ml_features_used(t):
    """The feature loop: compute, gate, merge what passes, train with it; ten trees."""
    silver = t.silver_orders()
    gates = feat.gates(silver, FEATURES, NUMERIC)
    passed = sorted(r["feature"] for r in gates.filter("passed").select("feature").collect())  # one row per declared feature
    computed = feat.compute(silver, {n: FEATURES[n] for n in passed})
    merged = feat.merge(feat.encode(silver, ["supplier_id", "region"]), computed)
    data = ops.labelled(merged, passed)
    fitted = ops.train(data, passed, trees=10)
    used = {n for n, _ in ops.importances(fitted, passed)} - set(ops.BASE_FEATURES)
    size = data.filter("train").agg(F.count("*")).scalar()
    return gates.select("feature", F.col("feature").isin(sorted(used)).alias("used"), size.alias("train_rows"))
