"""Joins that lose rows fail, with the key in the message; summaries held against values by hand."""

import pytest

from larkspur.operators import evaluation, panel, release, simulation

F = "series_id string, origin int, date_idx int, horizon int, q10 double, q50 double, q90 double, model string"
T = "series_id string, date_idx int, demand double, category string, store string, promo int, stockout int, drat_state string"


def forecast(spark, rows):
    return spark.createDataFrame([(s, 9, 9 + h, h, q - 1.0, float(q), q + 1.0, m) for s, h, q, m in rows], F)


def truth(spark, rows):
    return spark.createDataFrame([(s, 9 + h, float(y), "c", "t", 0, 0, "stable") for s, h, y in rows], T)


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_a_forecast_without_truth_fails(spark):
    f = forecast(spark, [("a", 1, 4, "seasonal_naive"), ("a", 2, 5, "seasonal_naive")])
    t = truth(spark, [("a", 1, 4)])
    fails(evaluation.forecast_metrics(f, t), "no truth for a 11")
    fails(evaluation.learn_series_router(f, t), "no truth for a 11")
    fails(evaluation.forecast_metrics(forecast(spark, [("a", 1, 4, "m")]), truth(spark, [("a", 1, 4), ("a", 1, 5)])), "several truths for a 10")
    row = evaluation.forecast_metrics(f, truth(spark, [("a", 1, 4), ("a", 2, 7), ("b", 1, 1)])).first()
    assert (row.n, row.coverage_80) == (2, 0.5) and abs(row.wape - 2 / 11) < 1e-9


def test_a_series_without_metadata_fails(spark):
    f = forecast(spark, [("a", 1, 4, "m"), ("b", 1, 6, "m")])
    fails(evaluation.reconcile_bottom_up(f, truth(spark, [("a", 1, 4)])), "no hierarchy metadata for b")
    nodes = evaluation.reconcile_bottom_up(f, truth(spark, [("a", 1, 4), ("b", 1, 4)]))
    got = {(r.node_id, r.series_id, r.level, r.category, r.store): r.q50 for r in nodes.collect()}
    assert got == {
        ("a", "a", "bottom", "c", "t"): 4.0, ("b", "b", "bottom", "c", "t"): 6.0, ("store:t", "store:t", "store", "ALL", "t"): 10.0, ("category:c", "category:c", "category", "c", "ALL"): 10.0,
        ("store_category:t|c", "store_category:t|c", "store_category", "c", "t"): 10.0, ("total", "total", "total", "ALL", "ALL"): 10.0,
    }
    assert evaluation.NODE_ERROR.run(nodes=nodes, forecast=f).first()[0] == 0.0
    lost = nodes.where("series_id != 'b'")
    assert evaluation.NODE_ERROR.run(nodes=lost.where("level != 'total'").unionByName(lost.where("level = 'total'").selectExpr("model", "origin", "date_idx", "horizon", "node_id", "series_id", "level", "category", "store", "q10 - 5 as q10", "q50 - 6 as q50", "q90 - 7 as q90")), forecast=f).first()[0] == 7.0
    assert evaluation.NODE_ERROR.run(nodes=nodes.where("level != 'total'"), forecast=f).first()[0] == 12.0 - 1.0 + 1.0


def test_scenario_totals_are_held_against_the_paths(spark):
    paths = spark.createDataFrame([("m", "a", 0, 1, 1, 2.0), ("m", "b", 0, 1, 1, 3.0)], "model string, series_id string, scenario int, date_idx int, horizon int, demand double")
    meta = truth(spark, [("a", 1, 0), ("b", 1, 0)])
    nodes = evaluation.reconcile_paths(paths, meta)
    assert release.PATH_ERROR.run(nodes=nodes, scenarios=paths).first()[0] == 0.0
    assert release.PATH_ERROR.run(nodes=evaluation.reconcile_paths(paths.where("series_id = 'a'"), meta), scenarios=paths).first()[0] == 3.0


def test_router_coverage(spark):
    f = forecast(spark, [("a", 1, 4, "tsb"), ("a", 1, 5, "seasonal_naive"), ("b", 1, 6, "seasonal_naive")])
    routing = lambda *rows: spark.createDataFrame(list(rows), "series_id string, selected_model string")
    got = evaluation.apply_series_router(f, routing(("a", "tsb"), ("b", "seasonal_naive"))).collect()
    assert sorted((r.series_id, r.q50, r.model, r.routed_from_model) for r in got) == [("a", 4.0, "reliability_router", "tsb"), ("b", 6.0, "reliability_router", "seasonal_naive")]
    fails(evaluation.apply_series_router(f, routing(("a", "tsb"))), "no routing decision for b")
    fails(evaluation.apply_series_router(f, routing(("a", "tsb"), ("b", "tsb"))), "routed model has no forecast for b 10")
    fails(evaluation.apply_series_router(f, routing(("a", "tsb"), ("a", "tsb"), ("b", "seasonal_naive"))), "several routing decisions for a")


def test_routing_means_are_over_all_series(spark):
    rows = [("a", "tsb", 0.4, 0.2), ("b", "tsb", 0.2, 0.0), ("c", "seasonal_naive", 0.0, 0.1)]
    got = {r.selected_model: r for r in evaluation.ROUTING_SUMMARY.run(routing=spark.createDataFrame(rows, "series_id string, selected_model string, relative_improvement double, relative_cost_improvement double")).collect()}
    for r in got.values():
        assert abs(r.mean_validation_improvement - 0.2) < 1e-12 and abs(r.mean_validation_cost_improvement - 0.1) < 1e-12 and abs(r.fallback_rate - 1 / 3) < 1e-12 and r.all_series == 3
    assert (got["tsb"].n_series, round(got["tsb"].own_validation_improvement, 9)) == (2, 0.3)


def test_slice_summary_has_the_baseline(spark):
    slices = spark.createDataFrame([("tsb", "store", "x", 0.5), ("tsb", "store", "y", -0.1), ("tsb", "category", "c", 0.5)], "model string, dimension string, slice_value string, relative_wape_regression double")
    got = {r.model: (r.n_slices, r.worst_relative_wape_regression, r.worst_slice, round(r.slice_win_rate, 6)) for r in evaluation.summarize_slices(slices).collect()}
    assert got == {"tsb": (3, 0.5, "category=c", 0.333333), "seasonal_naive": (0, 0.0, None, 1.0)}


def test_simulations_need_truth_stock_and_the_same_demand(spark):
    f = forecast(spark, [("a", h, 4, m) for h in (1, 2, 3, 4) for m in ("seasonal_naive", "tsb")])
    t = truth(spark, [("a", h, 4) for h in (1, 2, 3, 4)])
    initial = simulation.common_initial_inventory(f)
    assert simulation.run_open_loop(f, t, initial).count() == 8
    fails(simulation.run_open_loop(f, t.where("date_idx < 12"), initial), "no truth for a")
    fails(simulation.run_open_loop(f, t, initial.limit(0)), "no initial inventory for a")
    run = simulation.run_open_loop(f, t, initial)
    assert simulation.summarize_inventory(run).count() == 2
    fails(simulation.summarize_inventory(run.where("model = 'tsb' or date_idx > 10")), "different demand")


def test_no_single_partition_exchange_over_rows(spark):
    days = [(f"s{k}", d, float(k + d), float(k + d), 0, 1.0, 0, f"c{k % 3}", f"t{k % 2}", d % 7) for k in range(12) for d in range(30)]
    p = spark.createDataFrame(days, "series_id string, date_idx int, sales double, demand double, stockout int, price double, promo int, category string, store string, dow int")
    for df in (panel.balanced_sample(p, 100), panel.select_cohort(p, 5)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert panel.balanced_sample(p, 100).count() == 100 and panel.balanced_sample(p, 1000).count() == 360
    assert [r.place for r in panel.select_cohort(p, 5, 2).orderBy("place").collect()] == [3, 4, 5, 6, 7]


def test_injected_predictors_must_cover_their_keys(spark):
    from larkspur.operators import foundation

    days = [(f"s{k}", d, float(d), 1.0, 0, d % 7) for k in range(3) for d in range(20)]
    p = spark.createDataFrame(days, "series_id string, date_idx int, sales double, price double, promo int, dow int")

    def predictor(change):
        def predict(context, future):
            out = future.assign(q10=9.0, q50=float(context.target.iloc[-1]), q90=-3.0)[["timestamp", "q10", "q50", "q90"]]
            return change(out) if context.item_id.iloc[0] == "s1" else out

        return predict

    run = lambda change: foundation.forecast_with(p, 15, 4, predictor(change), "mock", "sales")
    rows = run(lambda x: x).collect()
    assert len(rows) == 12 and all((r.q10, r.q50, r.q90, r.horizon) == (9.0, 15.0, 15.0, r.date_idx - 15) for r in rows)
    import pandas as pd

    fails(run(lambda x: x.iloc[1:]), "the forecast of s1 has the days")
    fails(run(lambda x: pd.concat([x, x.iloc[:1]])), "the forecast of s1 has the days")
    fails(run(lambda x: x.assign(q50=float("nan"))), "s1 has null quantiles")
    fails(run(lambda x: x.drop(columns="q90")), "s1 has no columns")
    later = lambda x: pd.concat([x, x.iloc[-1:].assign(timestamp=x.timestamp.iloc[-1] + pd.Timedelta(days=9))])
    assert run(later).count() == 12


def test_fine_tuning_takes_a_bounded_number_of_series(spark):
    from larkspur.operators import foundation

    days = [(f"s{k}", d, float(d + k), 1.0, 0, d % 7) for k in range(9) for d in range(6)]
    p = spark.createDataFrame(days, "series_id string, date_idx int, sales double, price double, promo int, dow int")
    seen = foundation.fine_tune(p, 4, 3, lambda inputs, prediction_length, steps: (inputs, prediction_length, steps), "sales", steps=7)
    assert len(seen[0]) == 9 and seen[1:] == (3, 7) and all(len(x["target"]) == len(x["past_covariates"]["price"]) == 5 for x in seen[0])
    few = lambda df: [x["target"] for x in foundation.fine_tune(df, 4, 3, lambda inputs, prediction_length: inputs, "sales", max_series=4)]
    assert few(p) == few(p.repartition(7)) and len(few(p)) == 4
    with pytest.raises(ValueError):
        foundation.fine_tune(p.limit(0), 4, 3, lambda *a, **k: None, "sales")


def test_costs_that_differ_by_noise_are_equal_whatever_their_size(spark):
    """Sums of doubles differ in their last places by the order of their rows: at 2^25 by more than nine digits hide."""
    import math

    for cost in (40.0, 2.0**25 + 0.1):
        more = cost
        for _ in range(4):
            more = math.nextafter(more, math.inf)
        runs = spark.createDataFrame([("seasonal_naive", "a", 1.0, cost), ("tsb", "a", 1.0, more), ("seasonal_naive", "b", 1.0, cost), ("tsb", "b", 1.0, cost + 1e-4)], "model string, series_id string, policy_scale double, cost double")
        rates = {r.model: r.cost_win_rate_vs_baseline for r in simulation.WIN_RATE.run(simulation=runs).collect()}
        policies = {r.model: r.cost_win_rate_vs_baseline for r in release.POLICIES.run(summary=spark.createDataFrame([("seasonal_naive",), ("tsb",)], "model string"), simulation=runs).collect()}
        assert rates == policies == {"seasonal_naive": 1.0, "tsb": 0.5}, cost
