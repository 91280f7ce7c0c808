import math
import random
import statistics

import pytest

from larkspur.operators import forecasting, panel
from larkspur.operators.order_statistics import group_quantile, order_statistics


def groups(seed=3):
    rng = random.Random(seed)
    kinds = {"wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200), "ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "same": lambda: 4.0, "normal": lambda: rng.gauss(0, 1), None: lambda: rng.random()}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(3000)]
    rows += [("one", 5.0), ("nulls", None), ("nulls", None), ("two", 1.0), ("two", 4.0), ("two", None)]
    rng.shuffle(rows)
    return rows


def test_ranks_over_several_rounds(spark):
    rows = groups()
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    wanted = [(g, max(1, len(v) // 3), max(1, len(v) // 3) + (len(v) > 9)) for g, v in by.items()]
    got = order_statistics(df, ["g"], "x", spark.createDataFrame(wanted, "g string, a bigint, b bigint"), limit=40, n=8)
    assert {r.g: (r.at_a, r.at_b) for r in got.collect()} == {g: (sorted(by[g])[a - 1], sorted(by[g])[b - 1]) for g, a, b in wanted}


@pytest.mark.parametrize("sizes", [{}, {"limit": 40, "n": 8}])
def test_medians(spark, sizes):
    rows = groups(5)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r.m for r in group_quantile(df, ["g"], "x", "m", **sizes).collect()}
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert set(got) == set(by) and all(math.isclose(got[g], statistics.median(v), rel_tol=1e-12) for g, v in by.items())
    assert group_quantile(df.limit(0), ["g"], "x", "m", **sizes).count() == 0


def test_conformal_ranks_equal_the_sorted_scores(spark):
    """Against plain ranks, with brackets of a few values, so that rounds are needed."""
    rng = random.Random(8)
    origins, series, horizon = (10, 20, 30, 40), [f"s{k}" for k in range(60)], 3
    forecast, truth = [], []
    for s in series:
        truth += [(s, day, round(rng.uniform(0, 20), rng.choice([0, 3]))) for day in range(60)]
        for o in origins:
            for h in range(1, horizon + 1):
                for m in ("a", "b"):
                    q = rng.uniform(5, 15)
                    forecast.append((s, o, o + h, h, q - 3.0, q, q + 3.0, m))
    f = spark.createDataFrame(forecast, "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string")
    t = spark.createDataFrame(truth, "series_id string, date_idx int, demand double")
    demand = {(s, d): y for s, d, y in truth}
    got = {(r.target_origin, r.model, r.horizon): r for r in forecasting.conformal_ranks(f, t, (20, 40), limit=8, n=4).collect()}
    rank = lambda v: sorted(v)[min(len(v), math.ceil((len(v) + 1) * 4 / 5)) - 1]
    for target in (20, 40):
        for m in ("a", "b"):
            scores = [(h, max(lo - demand[s, d], demand[s, d] - hi)) for s, o, d, h, lo, _, hi, own in forecast if own == m and o < target]
            for h in range(1, horizon + 1):
                local, pooled, n = rank([x for k, x in scores if k == h]), rank([x for _, x in scores]), sum(k == h for k, _ in scores)
                r = got[target, m, h]
                assert (r.local_adjustment, r.pooled_adjustment, r.n) == (local, pooled, n)
                assert math.isclose(r.adjustment, n / (n + 30) * local + 30 / (n + 30) * pooled)
    assert len(got) == 12


def test_no_window_over_a_week(spark):
    days = panel.impute_prices(spark.createDataFrame([("a|b|c", 0, 1.0, 1.0, 0, None, 0, "b", "a", 0), ("a|b|d", 1, 1.0, 1.0, 0, 3.0, 0, "b", "a", 1)], "series_id string, date_idx int, sales double, demand double, stockout int, price double, promo int, category string, store string, dow int"))
    assert sorted((r.series_id, r.price) for r in days.collect()) == [("a|b|c", 3.0), ("a|b|d", 3.0)]
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
