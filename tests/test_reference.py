"""Golden values, edge semantics and invariants of the reference operators; DuckDB for whole queries."""

import json

import pytest

from larkspur.operators import censoring, closed_loop, evaluation, features, forecasting, gates, lifecycle, panel, simulation
from larkspur.plans import catalogue
from larkspur.sources import sinks

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


def make_panel(spark, values, **more):
    rows = [(s, i, float(v), float(v), 0, 2.0, 0, "c", "st", i % 7) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, date_idx int, sales double, demand double, stockout int, price double, promo int, category string, store string, dow int")


@pytest.mark.parametrize("name", ["mart_daily_demand", "price_imputed", "ladt_states", "tsb", "best_policy", "decision_router", "closed_loop_summary", "reconciled_points"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.oracles()[name])
    columns = [c[0] for c in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert got.columns == columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_training_frame_reaches_the_test_origin(spark):
    """Every day up to TEST with every horizon of which the target is not beyond it."""
    got = catalogue.QUERIES["direct_training_frame"](spark, SF)
    r = got.selectExpr("count(*) as n", "max(date_idx) as day", "max(horizon) as horizon", "max(date_idx + horizon) as last", "count(distinct series_id) as series").first()
    origin, h = catalogue.TEST[0], catalogue.HORIZON
    assert (r.day, r.horizon, r.last) == (origin - 1, h, origin)
    assert r.n == r.series * sum(min(h, origin - d) for d in range(origin))
    test_queries_against_sql(spark, "direct_training_frame")


def test_scenarios_and_draws_are_as_many_as_the_reference_has(spark):
    """120 scenario paths and 30 posterior draws, in the paths, in what is made of them and in the SQL."""
    got = {n: catalogue.QUERIES[n](spark, SF) for n in ("scenario_paths", "scenario_diagnostics", "reconciled_scenarios", "posterior_draws")}
    for n, c, many in (("scenario_paths", "scenario", 120), ("reconciled_scenarios", "scenario", 120), ("posterior_draws", "draw", 30)):
        r = got[n].selectExpr(f"count(distinct {c}) as n", f"min({c}) as least", f"max({c}) as most").first()
        assert (r.n, r.least, r.most) == (many, 0, many - 1), n
    assert got["scenario_diagnostics"].first().n_scenarios == 120
    for n in got:
        test_queries_against_sql(spark, n)


def test_price_golden(spark):
    shape = "series_id string, date_idx int, sales double, demand double, stockout int, price double, promo int, category string, store string, dow int"
    rows = [(f"s1|g|{s}", d, 1.0, 1.0, 0, p, 0, "g", "s1", 0) for s, d, p in (("a", 0, None), ("a", 7, 2.0), ("b", 0, None), ("b", 7, 3.0))]
    got = [r.price for r in panel.impute_prices(spark.createDataFrame(rows, shape)).orderBy("series_id", "date_idx").collect()]
    assert got == [1.0, 2.0, 1.0, 3.0]


def test_zero_ratios_of_the_first_rows(spark):
    """The feature's first row is no zero; the regime's past begins with one."""
    df = censoring.recover_latent_demand(censoring.add_controlled_stockouts(make_panel(spark, {"a": [0, 0, 5, 0, 3, 3, 3, 3]}), rate=0.0))
    got = [round(r.zero_ratio_14, 6) for r in features.add_time_features(df).orderBy("date_idx").collect()]
    assert got[:5] == [0.0, 0.5, round(2 / 3, 6), 0.5, 0.6]


def test_past_only_and_order(spark):
    values = [float((7 * i) % 11) for i in range(60)]
    short, whole = make_panel(spark, {"a": values[:40]}), make_panel(spark, {"a": values}).repartition(5)

    def run(df):
        df = censoring.recover_latent_demand(censoring.add_controlled_stockouts(df, rate=0.3))
        return lifecycle.add_regimes(df).where("date_idx < 40").orderBy("date_idx").collect()

    assert run(short) == run(whole)


def test_recovery_bounds(spark):
    df = censoring.recover_latent_demand(censoring.add_controlled_stockouts(make_panel(spark, {"a": [5 + i % 7 for i in range(80)]}), rate=0.4))
    assert df.where("recovered_demand_mean < sales or (stockout = 0 and recovered_demand_mean != sales)").count() == 0
    d = censoring.recovery_diagnostics(df).first()
    assert d.n_controlled > 5 and d.recovered_mae < d.raw_mae


def test_contracts(spark):
    good = make_panel(spark, {"a": range(12), "b": range(12)})
    assert panel.validate_panel(good) == {"row_count": 24, "series_count": 2, "min_date": 0, "max_date": 11}
    for bad in (good.unionByName(good.limit(1)), good.where("not (series_id = 'a' and date_idx = 5)"), good.where("not (series_id = 'a' and date_idx = 11)"), good.limit(0)):
        with pytest.raises(ValueError):
            panel.validate_panel(bad)


def test_repair_and_conformal(spark):
    f = spark.createDataFrame([("a", 0, 1, 1, 12.0, 10.0, 8.0, "m"), ("a", 0, 2, 2, 1.0, 5.0, 4.0, "m")], "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string")
    assert [(r.q10, r.q50, r.q90) for r in forecasting.repair_quantiles(f).orderBy("horizon").collect()] == [(10.0, 10.0, 10.0), (1.0, 5.0, 5.0)]
    f = spark.createDataFrame([("a", 0, i, 1, 0.0, 10.0, 20.0, "m") for i in range(5)], f.schema)
    truth = spark.createDataFrame([("a", i, y) for i, y in enumerate((9.0, 10.0, 11.0, 10.0, 9.5))], "series_id string, date_idx int, demand double")
    adjust = forecasting.fit_conformal_adjustments(f, truth, (7,))
    assert adjust.first().adjustment < 0
    r = forecasting.apply_conformal_adjustments(f.selectExpr("series_id", "7 as origin", "date_idx", "horizon", "q10", "q50", "q90", "model"), adjust, (7,)).first()
    assert r.q10 > 0 and r.q90 < 20


def test_conformal_folds_count_from_the_next_origin_on(spark):
    """Scores by hand: of n of them, the one of rank ceil((n + 1) * 4 / 5), shrunk by n / (n + 30)."""
    scores = {10: [-3.0, 1.0], 20: [5.0, 2.0], 30: [9.0, 9.0]}  # of horizons 1 and 2
    rows = [("a", o, o + h, h, 100.0, 100.0, 100.0 + 0.0, "m") for o in scores for h in (1, 2)]
    f = spark.createDataFrame(rows, "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string")
    truth = spark.createDataFrame([("a", o + h, 100.0 + abs(scores[o][h - 1])) for o in scores for h in (1, 2)], "series_id string, date_idx int, demand double")
    got = {(r.target_origin, r.horizon): r for r in forecasting.fit_conformal_adjustments(f, truth, (20, 30)).collect()}
    assert {k: (r.n, r.local_adjustment, r.pooled_adjustment) for k, r in got.items()} == {(20, 1): (1, 3.0, 3.0), (20, 2): (1, 1.0, 3.0), (30, 1): (2, 5.0, 5.0), (30, 2): (2, 2.0, 5.0)}
    assert got[30, 2].adjustment == pytest.approx(2 / 32 * 2.0 + 30 / 32 * 5.0)
    applied = forecasting.apply_conformal_adjustments(f, forecasting.fit_conformal_adjustments(f, truth, (20, 30)), (20, 30)).collect()
    assert {(r.origin, r.horizon): r.q90 - 100 for r in applied} == pytest.approx({(o, h): got[o, h].adjustment for o, h in got})
    used = catalogue.QUERIES["conformal_adjustments"](spark, SF).groupBy("target_origin").agg({"n": "max"}).collect()
    n = {r[0]: r[1] for r in used}
    assert n[195] == 2 * n[181] and n[209] == 3 * n[181]


@pytest.mark.parametrize("column, value", [("sales", float("nan")), ("demand", float("inf")), ("price", float("nan")), ("price", None), ("stockout", None), ("dow", None), ("date_idx", None)])
def test_panel_contract_refuses(spark, column, value):
    from pyspark.sql import functions as F

    good = make_panel(spark, {"a": range(12)})
    panel.validate_panel(good)
    bad = good.withColumn(column, F.when(F.col("date_idx") == 5, F.lit(value).cast(good.schema[column].dataType)).otherwise(F.col(column)))
    with pytest.raises(ValueError):
        panel.validate_panel(bad)


@pytest.mark.parametrize("change", ["nan", "inf", "twice", "empty", "no id"])
def test_forecast_contract_refuses(spark, change):
    rows = [("a", 0, h, h, 1.0, 2.0, 3.0, "m") for h in (1, 2)]
    shape = "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string"
    truth = spark.createDataFrame([("a", 1), ("a", 2)], "series_id string, date_idx int")
    forecasting.validate_forecast(spark.createDataFrame(rows, shape), truth)
    bad = {"nan": [rows[0], (*rows[1][:6], float("nan"), "m")], "inf": [rows[0], (*rows[1][:6], float("inf"), "m")], "twice": [*rows, rows[1]], "empty": [], "no id": [*rows, (None, *rows[1][1:])]}[change]
    with pytest.raises(ValueError):
        forecasting.validate_forecast(spark.createDataFrame(bad, shape), truth)


def simulate(spark, q, n, cfg, demand=1.0):
    f = spark.createDataFrame([("seasonal_naive", "a", 0, i, i + 1, *map(float, q[i] if isinstance(q, list) else q)) for i in range(n)], "model string, series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double")
    truth = spark.createDataFrame([("a", i, demand) for i in range(n)], "series_id string, date_idx int, demand double")
    start = spark.createDataFrame([("a", 0.0)], "series_id string, initial_inventory double")
    return simulation.run_open_loop(f, truth, start, cfg).orderBy("date_idx").collect()


def test_open_loop_golden(spark):
    cfg = simulation.InventoryConfig(lead=1, review=1, service=0.5, initial=0.0)
    rows = simulate(spark, [(10, 10, 10), (1, 1, 1), (1, 1, 1), (1, 1, 1)], 4, cfg, 0.0)
    assert rows[0].target_inventory_position == 2.0
    rows = simulate(spark, (2, 3, 4), 5, simulation.InventoryConfig(lead=2, review=1))
    assert [r.decision_eligible for r in rows] == [1, 1, 0, 0, 0] and all(r.order_qty == 0 for r in rows if not r.decision_eligible)
    rows = simulate(spark, (2, 3, 4), 7, simulation.InventoryConfig(lead=1, review=3))
    assert sum(r.is_review_period for r in rows) == 1
    assert rows[1].arrivals == rows[0].order_qty > 0


def test_replay_summary_golden(spark):
    rows = [("p", 1.0, "a", i, s) for i, s in enumerate((1, 1, 0, 1))] + [("p", 1.0, "b", i, s) for i, s in enumerate((0, 1))]
    df = spark.createDataFrame([(*r, 1.0, 1.0, 1.0, 1.0, 1.0) for r in rows], "policy string, recovery_safety double, series_id string, cycle int, stockout int, cost double, lost_sales double, forecast double, latent_demand double, ending_inventory double")
    r = closed_loop.REPLAY_SUMMARY.run(replay=df).first()
    assert (round(r.stockout_rate, 9), r.repeat_stockout_events, r.repeat_stockout_ratio, r.repeat_stockout_share) == (round(4 / 6, 9), 1, 0.25, 0.25)


def test_router_golden(spark):
    def forecast(model, series, q):
        return [(series, 0, i, i + 1, q, q, q, model) for i in range(14)]

    rows = forecast("seasonal_naive", "a", 14.0) + forecast("c", "a", 10.0) + forecast("seasonal_naive", "b", 10.0) + forecast("c", "b", 10.2)
    f = spark.createDataFrame(rows, "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string")
    truth = spark.createDataFrame([(s, i, 10.0) for s in "ab" for i in range(14)], "series_id string, date_idx int, demand double")
    assert {r.series_id: r.selected_model for r in evaluation.learn_series_router(f, truth).collect()} == {"a": "c", "b": "seasonal_naive"}


def test_gate_and_selection():
    assert gates.evaluate_release({})["gate_status"] == "FAIL"
    good: dict = {}
    for c in gates.CHECKS.values():
        at = good
        *path, last = c.path.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = c.least if c.least is not None else c.most
    assert gates.evaluate_release(good)["gate_status"] == "PASS"
    assert gates.evaluate_release(good | {"cost_win_rate": 0.1})["gate_status"] == "ITERATE"
    metrics = {m: {"wape": 0.3, "coverage_80": 0.8, "signed_bias": 0.0, "mean_interval_width": 1.0} for m in ("seasonal_naive", "router")}
    cost = lambda x: {"seasonal_naive": {"total_cost": 100.0}, "router": {"total_cost": x}}
    worst = {"seasonal_naive": {"worst_relative_wape_regression": 0.0}, "router": {"worst_relative_wape_regression": -0.01}}
    assert gates.choose_candidate(metrics, cost(104.0), worst) == "router"
    assert gates.choose_candidate(metrics, cost(108.0), worst) == "seasonal_naive"


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "x.json", {"b": 1, "a": 2})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 2, "b": 1}
    sinks.write_table(spark.range(3), tmp_path / "t")
    sinks.write_table(spark.range(5), tmp_path / "t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 5 and len(sinks.sha256_of(tmp_path / "t")) == 64
    with pytest.raises(FileNotFoundError):
        sinks.publish(tmp_path / "none", tmp_path / "t")


def test_boosted_quantiles(spark):
    """Ordered, complete, and at a quantile's loss no worse than a constant's on rows that were not fitted."""
    import numpy as np

    from larkspur.operators import quantile_boosting as qb
    from larkspur.plans.steps import resolve

    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = 3 * (x[:, 0] > 0) + rng.exponential(size=1500)
    rows = [(int(rng.integers(-(2**62), 2**62)), int(k >= 1000), float(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))]
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "row_hash bigint, day int, target double, a double, b double, c double, d double")
    train = df.where("day = 0")
    edges = qb.edges_of(train, columns)
    fits = [(0, q) for q in (0.1, 0.5, 0.9)]
    trees = qb.Boosting(fits, rounds=20, rate=0.2).fit(qb.checkpointed(qb.binned(train, columns, edges, ["row_hash", "day", "target"])), 4)
    ask = df.where("day = 1").selectExpr("cast(row_hash as string) as series_id", "0 as origin", "0 as date_idx", "0 as horizon", "target", *columns)
    got = qb.scored(qb.binned(ask, columns, edges, ["series_id", "origin", "date_idx", "horizon"]), fits, trees, 0.2, 3).toPandas().set_index("series_id")
    late = {str(r[0]): r[2] for r in rows if r[1]}
    truth = np.array([late[i] for i in got.index])
    assert len(got) == 500
    for q in (0.1, 0.5, 0.9):
        p = got[f"q{int(100 * q)}"].to_numpy()
        loss = lambda p, q=q: np.maximum(q * (truth - p), (q - 1) * (truth - p)).mean()
        assert loss(p) < 0.8 * loss(np.quantile(y[:1000], q)) and abs((truth <= p).mean() - q) < 0.08
    inputs = resolve(catalogue.GRAPH, "direct_inputs", spark, SF)
    rows = qb.direct_quantile_forecast(inputs, catalogue.ORIGINS, catalogue.HORIZON, rounds=2).collect()
    assert len(rows) == 50 * 14 * len(catalogue.ORIGINS) and all(0 <= r.q10 <= r.q50 <= r.q90 for r in rows)


def test_foundation_frames(spark):
    import datetime

    from larkspur.operators import foundation

    df = make_panel(spark, {s: range(60) for s in "abcd"})
    past, ahead = foundation.context_frame(df, 50, "sales"), foundation.future_frame(df, 50, 7)
    assert ahead.count() == 28 and past.agg({"timestamp": "max"}).first()[0] == datetime.date(2000, 2, 20)
    assert ahead.agg({"timestamp": "min"}).first()[0] == datetime.date(2000, 2, 21)
    assert all(len(r.target) == 51 for r in foundation.training_inputs(df, 50, "sales").collect())
    assert foundation.future_frame(df, 59, 7).count() == 28  # nothing known: last values go on
    with pytest.raises(ValueError):
        foundation.future_frame(df, 56, 7)

    def predict(context, future):
        return future.assign(q10=1.0, q50=float(context.target.iloc[-1]), q90=99.0)[["timestamp", "q10", "q50", "q90"]]

    rows = foundation.forecast_with(df, 50, 7, predict, "mock", "sales").collect()
    assert len(rows) == 28 and all(r.q50 == 50.0 and r.date_idx == 50 + r.horizon for r in rows)


def test_selection_and_gate_queries_match_the_functions(spark):
    """The selection as a query against ``choose_candidate``, the gate's rows against ``evaluate_release``."""
    import random

    from larkspur.operators import gates, release

    rng, models = random.Random(5), ["seasonal_naive", "tsb", "reliability_router"]
    for _ in range(6):
        metrics = {m: {"wape": rng.uniform(0.2, 0.26), "mean_interval_width": rng.uniform(1, 1.6)} for m in models}
        inventory = {m: {"fill_rate": rng.uniform(0.9, 0.95), "total_cost": rng.uniform(100, 115), "cost_win_rate_vs_baseline": rng.choice([0.4, 0.6])} for m in models}
        slices = {m: {"worst_relative_wape_regression": 0.0 if m == models[0] else rng.uniform(0, 0.4)} for m in models}
        want = gates.choose_candidate(metrics, inventory, slices)
        frame = lambda rows, names: spark.createDataFrame(rows, names)
        got = release.selection_step().run(
            metrics=frame([(m, *metrics[m].values()) for m in models], "model string, wape double, mean_interval_width double"),
            policies=frame([(m, *inventory[m].values(), 1.0) for m in models], "model string, fill_rate double, total_cost double, cost_win_rate_vs_baseline double, policy_scale double"),
            slices=frame([(m, *slices[m].values()) for m in models[1:]], "model string, worst_relative_wape_regression double"),
        )
        assert [r.selected_model for r in got.collect()] == [want]

    def status(**changed):
        good = {n: c.least if c.least is not None else c.most for n, c in gates.CHECKS.items()} | changed
        nested: dict = {}
        for n, c in gates.CHECKS.items():
            at = nested
            *path, last = c.path.split(".")
            for p in path:
                at = at.setdefault(p, {})
            at[last] = good[n]
        values = spark.createDataFrame([tuple(None if v is None else float(v) for v in good.values())], ", ".join(f"{n} double" for n in good))
        rows = release.gate_step().run(values=values).collect()
        want = gates.evaluate_release(nested)
        assert {r.check_name: bool(r.holds) for r in rows} == want["checks"]
        assert {r.gate_status for r in rows} == {want["gate_status"]}
        return want["gate_status"]

    assert status() == "PASS"
    assert status(candidate_wape=None) == "ITERATE"
    assert status(closed_loop_cost=0.2) == "ITERATE"
    assert status(hierarchy_coherence=1.0) == "FAIL"
