import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import forecasting
from larkspur.operators.features import FEATURES, add_time_features
from larkspur.streaming import conformal, features

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scored(spark, seed=8):
    rng = random.Random(seed)
    rows = [(f"s{k}", o, o + h, h, 5.0, 7.0, 9.0, m, round(rng.gauss(7, 5), 2)) for k in range(40) for o in (10, 20, 30, 40) for h in (1, 2) for m in ("a", "b")]
    return spark.createDataFrame(rows, "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string, demand double")


def by_key(df):
    return {(r.target_origin, r.model, r.horizon): tuple(round(x, 9) for x in (r.adjustment, r.local_adjustment, r.pooled_adjustment)) + (r.n,) for r in df.collect()}


def batch(rows, targets):
    """Scores in cells of the whole table."""
    s = forecasting.conformal_scores(rows).withColumn("cell", F.expr(conformal.BUCKET))
    return by_key(forecasting.adjustments_from(s, s.groupBy("model", "horizon", "origin", "cell").agg(F.count(F.lit(1)).alias("n")), targets))


def test_replayed_folds_equal_the_batch_and_survive_a_crash(spark, tmp_path, monkeypatch):
    rows, targets = scored(spark), (20, 40)
    want = batch(rows, targets)
    truth = rows.where("origin < 40").selectExpr("model", "origin", "horizon", "greatest(q10 - demand, demand - q90) as s").collect()
    own = sorted(r.s for r in truth if r.model == "a" and r.horizon == 1)
    assert want[40, "a", 1][1] == round(own[min(len(own), -(-4 * (len(own) + 1) // 5)) - 1], 9)
    at = f"file://{tmp_path}"
    stream = conformal.replay(rows.select("model", "origin", "horizon", "q10", "q90", "demand"), f"{at}/in", (10, 20, 30, 40))
    real, calls = conformal.adjustments_from, []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(conformal, "adjustments_from", failing)
    with pytest.raises(Exception, match="lost"):
        conformal.run(stream, f"{at}/out", targets, f"{at}/check").awaitTermination()
    conformal.run(stream, f"{at}/out", targets, f"{at}/check").awaitTermination()  # goes on from the batch that was lost
    assert by_key(conformal.adjustments(spark, f"{at}/out")) == want
    conformal.run(stream, f"{at}/out", targets, f"{at}/check").awaitTermination()
    assert by_key(conformal.adjustments(spark, f"{at}/out")) == want
    late = rows.where("origin = 10").limit(30).withColumn("demand", F.lit(50.0)).select("model", "origin", "horizon", "q10", "q90", "demand")
    late.coalesce(1).write.parquet(f"{at}/in/fold=late")
    conformal.run(stream, f"{at}/out", targets, f"{at}/check").awaitTermination()
    assert by_key(conformal.adjustments(spark, f"{at}/out")) == batch(rows.select(late.columns).unionByName(late), targets)


def test_buckets_ascend_with_scores(spark):
    xs = sorted([0.0, 1e-300, -1e-300, 1e300, -1e300, *[random.Random(k).gauss(0, 10 ** (k % 9 - 4)) for k in range(400)]])
    got = [r.b for r in spark.createDataFrame([(x,) for x in xs], "score double").orderBy("score").selectExpr(f"{conformal.BUCKET} as b").collect()]
    assert got == sorted(got)


def panel(spark):
    rng = random.Random(2)
    rows = [(f"s{s}", d, float(rng.choice([0, 0, 1, 5, 9])), rng.choice([1.0, 2.0, 0.0])) for s in range(4) for d in range(60)]
    full = spark.createDataFrame(rows, "series_id string, date_idx int, sales double, price double")
    return full.selectExpr("*", "sales as demand", "0 as stockout", "0 as promo", "'c' as category", "'t' as store", "date_idx % 7 as dow", "sales as recovered_demand_mean")


def stream_of(spark, parts, tmp_path, lateness):
    shape = "series_id string, date_idx int, sales double, price double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    days = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    done = features.stream_features(days, lateness=lateness)
    done.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def rounded(df):
    return {(r.series_id, r.date_idx): tuple(round(r[f], 9) + 0.0 for f in FEATURES) for r in df.collect()}


@pytest.mark.parametrize("lateness", [0, 3])
def test_streamed_features_equal_the_windows(spark, tmp_path, lateness):
    p = panel(spark)
    want = rounded(add_time_features(p))
    rows = sorted((r.date_idx, r.series_id, r.sales, r.price) for r in p.collect())
    rng = random.Random(9)
    # Days move up to ``lateness`` places back and some come twice.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] + (rng.uniform(0, lateness) if lateness else 0), k))
    rows = [(rows[k][1], rows[k][0], rows[k][2], rows[k][3]) for k in order]
    parts = [rows[a : a + 80] + rng.sample(rows[:a], min(10, a)) for a in range(0, len(rows), 80)]
    parts.append([(f"s{s}", 60 + lateness, None, None) for s in range(4)])  # the days before are over
    got = stream_of(spark, parts, tmp_path, lateness)
    assert got.where("late = 1").count() == 0 and rounded(got.where("late = 0")) == want


def test_a_day_after_its_turn_is_passed_on(spark, tmp_path):
    parts = [[("s", d, 1.0, 1.0) for d in (5, 6, 7)], [("s", 2, 9.0, 1.0), ("s", 6, 9.0, 1.0), ("s", 8, 1.0, 1.0)]]
    got = {(r.date_idx, r.late): r.lag_1 for r in stream_of(spark, parts, tmp_path, 0).collect()}
    assert got == {(5, 0): 0.0, (6, 0): 1.0, (7, 0): 1.0, (2, 1): None, (8, 0): 1.0}
