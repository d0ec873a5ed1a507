"""Whole runs keep every series and every amount."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.forecast import select as S
from ledgerline.operators import evaluate, joins
from ledgerline.plans import analysis, quarterly, spend


def months(n, start="2018-01-31"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="ME")]


def rows_of(series):
    return [(*key, m, float(v)) for key, values in series.items() for m, v in zip(months(len(values)), values)]


@pytest.fixture(scope="module")
def typed(spark):
    t = np.arange(48)
    wave = 100 + 2 * t + 30 * np.sin(t * np.pi / 6)
    series = {("a", "g1"): wave, ("b", "g1"): wave, ("c", "g1"): wave, ("c", "short"): wave[:9], ("c", "dead"): 0 * wave}
    return spark.createDataFrame(rows_of(series), "type string, fingroup string, month date, volume double")


def test_types_choose_from_their_own_sets(spark, typed):
    sets = quarterly.model_sets(spark, {"a": ["naive", "mean"], "b": ["mean", "snaive"]})
    found = quarterly.forecast_types(typed, 3, sets).collect()
    chosen = {(r.type, r.fingroup): r.model for r in found}
    assert chosen == {("a", "g1"): "naive", ("b", "g1"): "snaive", ("c", "g1"): chosen["c", "g1"], ("c", "short"): None, ("c", "dead"): None}
    assert sorted((r.type, r.fingroup) for r in found).count(("c", "g1")) == 3
    lost = [r for r in found if r.model is None]
    assert len(lost) == 2 and all(r.step is None and r.month is None and r.value is None for r in lost)


def test_a_set_decides_ties_by_its_order(spark, typed):
    flat = typed.where("fingroup = 'g1'").withColumn("volume", F.lit(5.0))
    for order in (["naive", "mean"], ["mean", "naive"]):
        sets = quarterly.model_sets(spark, {"a": order})
        found = quarterly.forecast_types(flat.where("type = 'a'"), 1, sets).first()
        assert found.model == order[0]


def test_unknown_models_are_refused(spark, typed):
    with pytest.raises(Exception, match="unknown model crystal"):
        quarterly.forecast_types(typed, 3, quarterly.model_sets(spark, {"a": ["crystal"]})).collect()


def test_only_own_models_are_scored(spark, typed):
    arrays = quarterly.series.as_arrays(typed.where("fingroup = 'g1'"), ["type", "fingroup"], "month", "volume")
    sets = quarterly.model_sets(spark, {"a": ["naive", "mean"], "b": ["snaive"]})
    scored = S.score_table(S.score_models(S.attach_models(arrays, "type", sets, ["mean"]), ["type"]), ["type"])
    assert sorted((r.type, r.model) for r in scored.collect()) == [("a", "mean"), ("a", "naive"), ("b", "snaive"), ("c", "mean")]


def test_payments_without_order_keep_their_amount(spark):
    payments = spark.createDataFrame([("k", "7", 2020, 5.0), ("k", None, 2020, 11.0), ("k", "#", 2020, 7.0)], "key string, order_id string, payment_year int, amount double")
    orders = spark.createDataFrame([("7", 2020, 50.0)], "order_id string, budget_year int, sales_order_sum double")
    rows = spend.payments_with_orders(payments, orders, ["key"]).collect()
    assert sum(r.amount for r in rows) == 23.0 and {r.order_id: r.sales_order_sum for r in rows} == {"7": 50.0, None: 0.0, "#": 0.0}


def test_null_keys_meet(spark):
    forecast = spark.createDataFrame([(None, "x", 3.0), ("a", None, 1.0)], "k string, j string, forecast double")
    paid = spark.createDataFrame([(None, "x", 2020, 4.0), ("b", "y", 2020, 2.0)], "k string, j string, year int, amount double")
    found = evaluate.against_actual_years(forecast, paid, ["k", "j"], "year", "amount", [2020]).collect()
    assert {(r.k, r.j): (r.forecast, r.actual_2020) for r in found} == {(None, "x"): (3.0, 4.0), ("b", "y"): (0.0, 2.0)}
    both = joins.full_by_keys(forecast, paid.select("k", "j", "amount"), ["k", "j"])
    assert both.count() == 3 and both.columns == ["k", "j", "forecast", "amount"]


@pytest.fixture(scope="module")
def accounts(spark):
    rng = np.random.default_rng(5)
    t = np.arange(72)
    season = 1 + 0.4 * np.sin(t * np.pi / 6)
    series = {
        ("swings",): 200 * np.exp(0.03 * t) * season, ("steady",): 5_000 + 300 * np.sin(t * np.pi / 6) + rng.normal(0, 40, 72),
        ("falls",): np.maximum(0, 900 - 14 * t) * 1.0, ("silent",): np.r_[100 + 10 * np.sin(t[:30]), np.zeros(42)],
        ("minus",): 50 * np.exp(0.03 * t) * season - 60, ("few",): np.r_[np.zeros(66), [5, 6, 7, 8, 9, 10.0]], ("young",): 20 + t[:14],
    }
    rows = [(k, m, float(v)) for (k,), values in series.items() for m, v in zip(months(72)[-len(values):], values)]
    return spark.createDataFrame(rows, "k string, date date, amount double"), series


def test_analysis_of_every_account(spark, accounts):
    df, series = accounts
    monthly, yearly = analysis.run(df, ["k"], "date", "amount", "2023-12-31", 2024)
    by_month, by_year = {}, {r.k: r for r in yearly.collect()}
    for r in monthly.collect():
        by_month.setdefault(r.k, []).append(r)
    assert set(by_month) == set(by_year) == {k for k, in series}
    assert all(sorted(r.month.month for r in rows) == list(range(1, 13)) and rows[0].month.year == 2024 for rows in by_month.values())
    kinds = {k: r.decomposition for k, r in by_year.items()}
    assert kinds["swings"] == "multiplicative" and kinds["steady"] == kinds["minus"] == "additive" and kinds["few"] == kinds["young"] == "none"
    for k, rows in by_month.items():
        if kinds[k] == "none":
            assert all(r.lower is None and r.upper is None for r in rows)
            assert rows[0].value == pytest.approx(by_year[k].value / 12)
            continue
        for r in rows:
            below, above = r.value - r.lower, r.upper - r.value
            assert r.lower <= r.value <= r.upper
            if kinds[k] == "additive":
                assert below == pytest.approx(above, abs=1e-6)
            elif below > 1e-6:
                assert above > below  # the way back from logs stretches the upper side
                assert np.log1p(r.upper) - np.log1p(r.value) == pytest.approx(np.log1p(r.value) - np.log1p(r.lower))
        assert by_year[k].value == pytest.approx(sum(r.value for r in rows))
    grown = 200 * np.exp(0.03 * np.arange(72, 84)) * (1 + 0.4 * np.sin(np.arange(72, 84) * np.pi / 6))
    assert by_year["swings"].value == pytest.approx(grown.sum(), rel=0.15)
    assert abs(sum(r.value for r in by_month["silent"])) < 1e-6 + abs(sum(series["silent",])) * 0.05


def test_known_months_keep_their_components(spark, accounts):
    df, _ = accounts
    parts = analysis.components(df.where("k = 'steady'").select("k", F.col("date").alias("month"), F.col("amount").alias("value")), ["k"], "month", "value")
    known = {r.month: r.trend + r.seasonal for r in parts.where("trend is not null").collect()}
    monthly, _ = analysis.run(df.where("k = 'steady'"), ["k"], "date", "amount", "2023-12-31", 2023)
    found = {r.month: r.value for r in monthly.collect()}
    assert len(found) == 12
    for m in (dt.date(2023, 1, 31), dt.date(2023, 6, 30)):
        assert found[m] == pytest.approx(known[m])
