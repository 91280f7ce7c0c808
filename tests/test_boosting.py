import random

import numpy as np
import pytest

from larkspur.operators import quantile_boosting as qb
from larkspur.operators.features import build_direct_training_frame, multi_horizon, training_step
from larkspur.operators.ranks import dictionary, encode, ordered


class LocalTrees:
    """The same boosting over arrays in one process, residual quantiles sorted instead of counted."""

    def __init__(self, q, rounds, rate=0.06, depth=3, leaf=12, share=1.0):
        self.q, self.rounds, self.rate, self.depth, self.leaf = q, rounds, rate, depth, leaf

    def grow(self, bins, up, rest, rows, depth):
        best = (1e-12, None, None)
        if depth:
            g = np.where(up, self.q, self.q - 1.0)
            for k in range(bins.shape[1]):
                n = np.cumsum(np.bincount(bins[rows, k], minlength=qb.BINS))
                s = np.cumsum(np.bincount(bins[rows, k], weights=g[rows], minlength=qb.BINS))
                ok = (n >= self.leaf) & (len(rows) - n >= self.leaf)
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (s[-1] - s) ** 2 / np.maximum(len(rows) - n, 1) - s[-1] ** 2 / len(rows), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] is None:
            return float(np.quantile(rest[rows], self.q, method="inverted_cdf"))
        left = bins[rows, best[1]] <= best[2]
        return best[1], best[2], self.grow(bins, up, rest, rows[left], depth - 1), self.grow(bins, up, rest, rows[~left], depth - 1)

    def value(self, tree, bins):
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        return np.where(bins[:, tree[0]] <= tree[1], self.value(tree[2], bins), self.value(tree[3], bins))

    def fit_predict(self, bins, y):
        now = np.full(len(y), np.quantile(y, self.q, method="inverted_cdf"))
        for _ in range(self.rounds):
            rest = y - now
            now = now + self.rate * self.value(self.grow(bins, rest > 0, rest, np.arange(len(y)), self.depth), bins)
        return now


def pinball(y, f, q):
    return float(np.mean(np.maximum(q * (y - f), (q - 1) * (y - f))))


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 3, n)
    y = np.where(x[:, 0] > 0, 10 + 3 * x[:, 1], 2.0) + rng.gamma(2.0, 1.0, n) * (1 + x[:, 3])
    rows = [(int(h), int(rng.integers(0, 20)), float(t), *map(float, r)) for h, t, r in zip(rng.integers(-(2**62), 2**62, n), y, x)]
    return spark.createDataFrame(rows, "row_hash bigint, day int, target double, a double, b double, c double, d double").repartition(5)


def test_loss_within_a_hundredth_of_the_local_fit(spark, fixture):
    columns = ["a", "b", "c", "d"]
    edges = qb.edges_of(fixture, columns)
    rows = qb.checkpointed(qb.binned(fixture, columns, edges, ["row_hash", "day", "target"]))
    fits = [(9, 0.5), (30, 0.1), (30, 0.9)]
    boosting = qb.Boosting(fits, rounds=12, share=1.0, rate=0.2)
    trees = boosting.fit(rows, 4)
    got = rows.toPandas()
    bins = np.frombuffer(b"".join(map(bytes, got.bins)), dtype=np.uint8).reshape(-1, 4)
    for (origin, q), t in zip(fits, trees):
        use = (got.day <= origin).to_numpy()
        y = got.target.to_numpy()[use]
        mine = t.start + 0.2 * sum(leaves[qb.node_of(bins[use], split, 3)] for split, leaves in zip(t.splits, t.leaves))
        local = LocalTrees(q, 12, rate=0.2).fit_predict(bins[use].astype(np.int64), y)
        assert abs(pinball(y, mine, q) / pinball(y, local, q) - 1) < 0.01
        assert pinball(y, mine, q) < 0.8 * pinball(y, np.quantile(y, q), q)


def test_fits_do_not_depend_on_partitions(spark, fixture):
    columns = ["a", "b", "c", "d"]
    edges = qb.edges_of(fixture, columns)
    rows = qb.binned(fixture, columns, edges, ["row_hash", "day", "target"])
    one, other = (qb.Boosting([(30, 0.5)], rounds=7).fit(qb.checkpointed(rows.repartition(n)), 4)[0] for n in (1, 6))
    assert one.start == other.start and all((a == b).all() for a, b in zip(one.leaves, other.leaves))
    assert all((x == y).all() for a, b in zip(one.splits, other.splits) for l, m in zip(a, b) for x, y in zip(l, m))


def test_passes_run_on_all_cores(spark, fixture):
    edges = qb.edges_of(fixture, ["a"])
    rows = qb.binned(fixture.coalesce(1), ["a"], edges, ["row_hash", "day", "target"])
    kept = qb.checkpointed(qb.spread(rows))
    sizes = [n for n in kept.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes) and sum(sizes) == 3000


def test_too_few_rows_are_refused(spark, fixture):
    rows = qb.binned(fixture.limit(50), ["a"], [np.array([0.0])], ["row_hash", "day", "target"])
    with pytest.raises(ValueError, match="not enough"):
        qb.Boosting([(30, 0.5)], rounds=1).fit(rows, 1)


def test_residual_buckets():
    x = np.array([0.0, 1e-12, 1.0, -1.0, 3.7, -1e9, 5e11])
    for v, b in zip(x, qb.bucket_of(x)):
        assert abs(qb.value_of(int(b)) - v) <= 0.011 * abs(v) + 1e-9
    assert (np.diff(qb.bucket_of(np.sort(x))) >= 0).all()


def panel_frame(spark, days=60, series=6):
    rng = random.Random(4)
    shape = "series_id string, date_idx int, sales double, demand double, stockout int, price double, promo int, category string, store string, dow int, recovered_demand_mean double"
    rows = []
    for s in range(series):
        for d in range(days):
            y = float(5 + 3 * (d % 7 == 0) + s + rng.randrange(3))
            rows.append((f"s{s}", d, y, y, 0, 2.0 + s, int(d % 5 == 0), f"c{s % 2}", f"t{s % 3}", d % 7, y))
    return spark.createDataFrame(rows, shape)


def inputs_of(spark, panel):
    from larkspur.operators.features import add_time_features
    from pyspark.sql import functions as F

    out = add_time_features(panel)
    for c in [*qb._EXTRA, "recovery_uncertainty", "recovery_confidence"]:
        out = out.withColumn(c, F.lit(0.25))
    return out


def test_direct_forecasts_know_nothing_after_their_origin(spark):
    panel = panel_frame(spark)
    first = inputs_of(spark, panel)
    got = qb.direct_quantile_forecast(first, (40, 47), 5, rounds=3)
    rows = {(r.series_id, r.origin, r.horizon): r for r in got.collect()}
    assert len(rows) == 6 * 2 * 5
    assert all(0 <= r.q10 <= r.q50 <= r.q90 and r.date_idx == r.origin + r.horizon and r.model == qb.MODEL for r in rows.values())
    changed = inputs_of(spark, panel.selectExpr("series_id", "date_idx", "if(date_idx > 40, sales + 100, sales) as sales", "demand", "stockout", "price", "promo", "category", "store", "dow", "if(date_idx > 40, recovered_demand_mean * 50, recovered_demand_mean) as recovered_demand_mean"))
    later = {(r.series_id, r.origin, r.horizon): r for r in qb.direct_quantile_forecast(changed, (40, 47), 5, rounds=3).collect()}
    assert all(rows[k] == later[k] for k in rows if k[1] == 40) and any(rows[k] != later[k] for k in rows if k[1] == 47)


def test_training_frame_without_a_join_equals_the_joined_one(spark):
    featured = inputs_of(spark, panel_frame(spark, 30, 3)).where("not (series_id = 's1' and date_idx in (11, 12))")
    step = training_step(20, 6)
    plain = spark.sql(step.sql(__import__("larkspur.functions.dialect", fromlist=["SPARK"]).SPARK), featured=featured)
    own = build_direct_training_frame(featured, 20, 6)
    columns = ["series_id", "date_idx", "horizon", "target", "future_dow", "future_price", "future_promo", "lag_7", "roll_std_14"]
    assert sorted(map(tuple, own.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect())) and own.count() > 200
    assert "Join" not in multi_horizon(featured, 6)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("per_range", [7, 1000])
def test_global_ranks_and_running_sums(spark, per_range):
    rng = random.Random(6)
    rows = [(k, rng.randrange(20), rng.randrange(5)) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, g int, w int").repartition(3)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.k: (r.at, r.g) for r in ordered(df, ["g", "k"], "at", per_range=per_range).collect()}
    assert got == {k: (n, g) for n, (k, g, _) in enumerate(order)}
    total, want = 0, {}
    for k, _, w in order:
        want[k] = total
        total += w
    assert {r.k: r.at for r in ordered(df, ["g", "k"], "at", weight="w", per_range=per_range).collect()} == want
    assert ordered(df.limit(0), ["g"], "at").count() == 0


def test_dictionary_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("ä",), ("b",), (None,)], "c string")
    codes = dictionary(df, "c", per_range=2)
    assert {r.c: r.code for r in codes.collect()} == {"a": 1, "b": 2, "ä": 3}
    unseen = spark.createDataFrame([("b",), ("zz",), (None,)], "c string")
    assert sorted(str((r.c, r.k)) for r in encode(unseen, "c", codes, "k").collect()) == ["('b', 2)", "('zz', 0)", "(None, 0)"]
