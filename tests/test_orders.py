import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import KEY
from ledgerline.forecast import models as M
from ledgerline.plans import documents, generate, po, residual
from ledgerline.plans import forest as trees_of
from ledgerline.plans.forest import apart, draws, fit_trees, poisson_table
from ledgerline.operators import joins, ranking
from ledgerline.session import cut_lineage

ORDERS = [
    ("1", "2023", "1", "Std", "A", "O1", "CapEx", "G1", "1,000.50"), ("1", "2023", "1", "Std", "A", "O1", "CapEx", "G1", "99.50"),
    ("2", "2024", "1", "Urg", "B", "O2", "OpEx", "G2", "500"), ("3", "2025", "2", "Std", "A", "O1", "OpEx", "G1", "0"),
    ("4", "2022A", "1", "Urg", "B", "O2", "OpEx", "G2", "2000"),
]
DATES = [("1", "2023", "1", "15.03.2023"), ("2", "2024", "1", "01.06.2024"), ("2", "2024", "1", "09.06.2024"), ("3", "2025", "2", "01.01.2025"), ("4", "2022", "1", "10.01.2022")]
INVOICES = [("1", "2023", "1", 2023, 4, 100.0, 0.0, 10.0), ("1", "2023", "1", 2023, 1, 5.0, 0.0, 0.0), ("1", "2023", "1", 2025, 2, 0.0, 40.0, 0.0), ("4", "2022", "1", 2022, 12, 300.0, 0.0, 0.0), ("9", "2020", "1", 2020, 1, 1.0, 1.0, 1.0)]
EDITS = [("1", "2023", "1", "20230301", 1000.0), ("1", "2023", "1", "20240115", 100.0), ("1", "2023", "1", "20230101", 7.0), ("4", "2022", "1", "20220110", 2000.0), ("4", "2022", "1", "20220601", -500.0), ("2", "2024", "1", "20240601", 500.0)]


@pytest.fixture(scope="module")
def ready(spark):
    key = "doc_id string, fund_year string, item string"
    return po.prepare(
        spark.createDataFrame(ORDERS, f"{key}, po_type string, huka string, porcurment_organization string, expanditure_type string, fingroup string, po_net_value string"),
        spark.createDataFrame(DATES, f"{key}, order_date string"),
        spark.createDataFrame(INVOICES, f"{key}, invoice_year int, invoice_month int, RE double, ZY double, ZF double"),
        spark.createDataFrame(EDITS, f"{key}, order_date string, volume double"))


def test_prepared_tables(ready):
    orders = {r.doc_id: r for r in ready.orders.collect()}
    assert set(orders) == {"1", "2", "4"}  # value 0 drops out
    assert orders["1"].po_net_value == 1100.0 and orders["1"].quarter == 1 and orders["4"].N == 0
    assert str(orders["2"].order_date) == "2024-06-01"
    history = {(r.doc_id, r.rel_month): r.volume for r in ready.history.collect()}
    assert history == {("1", 1): 110.0, ("1", 0): 5.0, ("1", 23): 40.0, ("2", 0): 0.0, ("4", 11): 300.0}


@pytest.mark.parametrize("window", [1, 4])
def test_training_table_against_loops(ready, window):
    got = {(r.doc_id, r.age): (r.po_net_value, r.cumulative_portion, r.target) for r in po.training_table(ready.orders, ready.history, ready.edits, 2025, 2, window).collect()}
    start = {"1": 2023 * 12 + 3, "2": 2024 * 12 + 6, "4": 2022 * 12 + 1}
    edits = {"1": {2023 * 12 + 3: 1000, 2024 * 12 + 1: 100}, "2": {2024 * 12 + 6: 500}, "4": {2022 * 12 + 1: 2000, 2022 * 12 + 6: -500}}
    paid = {"1": {0: 5, 1: 110, 23: 40}, "2": {0: 0}, "4": {11: 300}}
    longest = 23
    want = {}
    for doc in start:
        dense = np.array([paid[doc].get(i, 0.0) for i in range(longest + 1)], dtype=float)
        for b in range(0, longest + 1, window):
            dense[b:b + window] = dense[b:b + window].mean()
        years = min(10, (2025 * 12 + 2 - start[doc]) // 12)
        for age in range(12 * years):
            value = sum(v for m, v in edits[doc].items() if start[doc] <= m <= start[doc] + age)
            before = dense[:age].sum()
            now = dense[age] if age <= longest else 0.0
            if value > 0 and before / value < 0.98:
                want[doc, age] = (value, before / value, now / (value - before))
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k]), k


def test_sampling_is_stable_and_near_the_fraction(spark):
    base = spark.range(4000).select(F.col("id").cast("string").alias("doc_id"), F.lit("2020").alias("fund_year"), F.lit("1").alias("item"),
                                    F.lit(2023).alias("order_year"), F.lit(1).alias("order_month"), F.lit(100.0).alias("po_net_value"))
    history = base.select(*KEY, F.lit(0).alias("rel_month"), F.lit(0.0).alias("volume"))
    edits = base.select(*KEY, F.lit(2023 * 12 + 1).alias("edit_abs"), F.lit(100.0).alias("volume"))
    def sample(df):
        return {(r.doc_id, r.age) for r in po.training_table(df, history, edits, 2024, 2, 1, 0.25, seed=3).select("doc_id", "age").collect()}
    a, b = sample(base.repartition(3)), sample(base.coalesce(1))
    assert a == b and abs(len(a) / 48000 - 0.25) < 0.03


def test_copies_weights_agree(ready):
    o = ready.orders.select(*KEY, "order_year", "order_month")
    copies = joins.copies_over_ages(o, 2025, 2).groupBy("doc_id", "age").count()
    weights = joins.ages_with_weight(o, 2025, 2).select("doc_id", "age", F.col("copies").cast("bigint").alias("count"))
    assert copies.exceptAll(weights).count() == 0 and weights.exceptAll(copies).count() == 0


def test_edits_range_join(ready, spark):
    copies = spark.createDataFrame([("4", "2022", "1", 2022 * 12 + 1, 0), ("4", "2022", "1", 2022 * 12 + 1, 5)], "doc_id string, fund_year string, item string, order_abs int, age int")
    got = joins.edits_within_age(copies, ready.edits, KEY).groupBy("age").agg(F.sum("volume").alias("v")).orderBy("age").collect()
    assert [(r.age, r.v) for r in got] == [(0, 2000.0), (5, 1500.0)]


def test_edit_sums_by_place_equal_the_range_join(ready, spark):
    rng = np.random.default_rng(3)
    keys = "doc_id string, fund_year string, item string"
    edits = spark.createDataFrame([(str(rng.integers(40)), "f", "1", int(24_000 + rng.integers(-6, 30)), float(rng.integers(-50, 90))) for _ in range(600)], f"{keys}, edit_abs int, volume double")
    copies = spark.createDataFrame([(str(k), "f", "1", 24_000 + k % 5, age) for k in range(42) for age in range(0, 30, 3)], f"{keys}, order_abs int, age int")
    slow = joins.edits_within_age(copies, edits, KEY).groupBy("doc_id", "age").agg(F.sum("volume").alias("v"))
    found = joins.edit_sums_as_of(copies, edits, KEY)
    assert {(r.doc_id, r.age): round(r.volume, 6) for r in found.collect()} == {(r.doc_id, r.age): round(r.v, 6) for r in slow.collect()}


def test_orders_meet_their_edits_before_they_are_copied_to_ages(spark):
    keys = "doc_id string, fund_year string, item string"
    rng = np.random.default_rng(4)
    edits = spark.createDataFrame([(str(rng.integers(30)), "f", "1", int(24_000 + rng.integers(-6, 30)), float(rng.integers(-50, 90))) for _ in range(400)], f"{keys}, edit_abs int, volume double")
    rows = [(str(k), "f", "1", 24_000 + k % 5) for k in range(32)] + [("3", "f", "1", 24_003), (None, "f", "1", 24_000), ("4", "f", "1", None)]
    orders = spark.createDataFrame(rows, f"{keys}, order_abs int")
    ages = F.sequence(F.lit(0), F.lit(24))
    found = joins.edit_sums_as_of(orders, edits, KEY, ages=ages)
    copied = joins.edit_sums_as_of(orders.withColumn("age", F.explode(ages)), edits, KEY).select(found.columns)
    assert found.count() > 500 and found.exceptAll(copied).count() == 0 and copied.exceptAll(found).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join Inner")


def test_ages_are_made_by_a_plain_sequence(ready, spark):
    """Rows per age come from runs that meet, not from arrays of all ages laid out item by item."""
    table = po.training_table(ready.orders, ready.history, ready.edits, 2025, 2, 4)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(" in plan and "arrays_zip" not in plan
    runs = spark.createDataFrame(
        [("a", 1, [(0, 2, 5.0), (2, 7, 0.0), (7, None, 9.0)], [(4, 8, 1.0, 0.0), (8, None, 2.0, 4.0)]), ("b", 1, [(3, None, 7.0)], None), ("c", 1, [(0, None, -1.0)], None)],
        "k string, years int, _edits array<struct<rel:int,until:int,value:double>>, _paid array<struct<start:int,until:int,smoothed:double,before:double>>")
    got = {(r.k, r.age): (r._value, r._now, r._before) for r in po.with_ages(runs, F.col("years") * 12, 4).collect()}
    assert got == {
        **{("a", a): (5.0, 0.0, 0.0) for a in (0, 1)}, ("a", 7): (9.0, 1.0, 3.0), **{("a", 8 + i): (9.0, 2.0, 4.0 + 2 * i) for i in range(4)},
        **{("b", a): (7.0, 0.0, 0.0) for a in range(3, 12)}}


def test_ranks_in_ranges(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("k"), (F.col("id") % 7).alias("n"), F.col("id").cast("string").alias("v"))
    found = ranking.ranks_in_ranges(rows.repartition(9), ["k"], [F.desc("n"), F.col("v")]).collect()
    for k in "ab":
        mine = sorted((r for r in found if r.k == k), key=lambda r: (-r.n, r.v))
        assert [r["rank"] for r in mine] == list(range(len(mine)))


@pytest.fixture(scope="module")
def forest(spark):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("doc_id"), F.lit("2020").alias("fund_year"), F.lit("1").alias("item"),
        *[F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias(c) for c in po.ATTRIBUTES],
        (F.col("id") % 10).alias("po_net_value_category"), (F.col("id") % 24).cast("int").alias("age"), F.lit(0).alias("N"), F.lit(1).alias("quarter"),
        ((F.col("id") % 7) / 10.0).alias("cumulative_portion"), ((F.col("id") % 3) / 10.0).alias("target"))
    features = po.Features()
    model, scores = po.train(rows, features, trees=5, depth=3, rate=1.0)
    return model, scores, features, rows


def test_forest_learns_the_category(forest):
    assert forest[1]["r-squared"] > 0.9 and forest[1]["rmse"] < 0.05


@pytest.mark.parametrize("rate", [0.5, 0.1])
def test_prediction_is_base_and_rate_times_the_forest(forest, rate, spark, tmp_path):
    """Base value plus the rate times the mean of the trees, which are fitted to what the base leaves."""
    _, _, features, rows = forest
    model = po.fit_forest(rows, features, trees=7, depth=2, rate=rate, seed=4)
    whole = po.fit_forest(rows, features, trees=7, depth=2, rate=1.0, seed=4)
    base = rows.agg(F.avg("target")).first()[0]
    assert model.base == pytest.approx(base) and model.rate == rate
    typed = po._typed(rows, features)
    packed = model.trees.stages[0].transform(model.encode(typed)).select("doc_id", "features").collect()
    trees = model.trees.stages[1].trees
    by_hand = {r.doc_id: base + rate * np.mean([t.predict(r.features) for t in trees]) for r in packed}
    found = {r.doc_id: r.prediction for r in model.transform(typed).collect()}
    at_one = {r.doc_id: r.prediction for r in whole.transform(typed).collect()}
    assert all(found[k] == pytest.approx(v) for k, v in by_hand.items())
    assert all(found[k] - base == pytest.approx(rate * (at_one[k] - base)) for k in found)
    po.save_model(model, str(tmp_path))
    loaded = po.load_model(spark, str(tmp_path))
    assert {r.doc_id: r.prediction for r in loaded.transform(typed).collect()} == found


def test_a_thousand_categories(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("doc_id"), F.lit("2020").alias("fund_year"), F.lit("1").alias("item"),
        *[F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias(c) for c in po.ATTRIBUTES],
        F.lit(1).alias("po_net_value_category"), F.lit(3).alias("age"), F.lit(0).alias("N"), F.lit(1).alias("quarter"),
        F.lit(0.1).alias("cumulative_portion"), ((F.col("id") % 1000) / 1000.0).alias("target"))
    _, scores = po.train(rows, po.Features(), trees=5, depth=5, rate=1.0)
    assert scores["r-squared"] > 0.8


def test_roll_forward_against_loops(forest):
    model, _, features, rows = forest
    some = rows.where("cast(doc_id as int) < 12").withColumns({"po_net_value": F.lit(100.0), "age": F.col("age") - 3})
    for damped in (True, False):
        got = {r.doc_id: r.shares for r in po.roll_forward(model, some, 4, features, damped).collect()}
        state = {r.doc_id: r.asDict() for r in some.collect()}
        want = {k: [] for k in state}
        for _ in range(4):
            predicted = {r.doc_id: r.prediction for r in model.transform(po._typed(some.sparkSession.createDataFrame(list(state.values()), some.schema), features)).collect()}
            for k, s in state.items():
                balance = max(1 - s["cumulative_portion"], 0)
                share = predicted[k] * balance if s["age"] >= 0 else 0.0
                want[k].append(share)
                s["cumulative_portion"] += balance * share if damped else share
                s["age"] += 1
        for k in want:
            assert np.allclose(got[k], want[k]), k
    waiting = [k for k, s in state.items() if int(k) % 24 == 0]
    assert waiting and all(got[k][:3] == [0.0, 0.0, 0.0] for k in waiting)


def test_forecast_adds_past_sums_only_this_year(spark):
    key = "doc_id string, fund_year string, item string, fingroup string"
    rolled = spark.createDataFrame([("1", "2025", "1", "G", 100.0, [0.1] * 2)], f"{key}, po_net_value double, shares array<double>")
    past = spark.createDataFrame([("1", "2025", "1", "G", 7.0), ("2", "2025", "1", "H", 3.0)], f"{key}, past_sum double")
    this_year = po.forecast_orders(rolled, past, 10, 0)
    assert {r.fingroup: round(r.amount, 6) for r in po.group_totals(this_year).collect()} == {"G": 27.0, "H": 3.0}
    long = rolled.withColumn("shares", F.array_repeat(F.lit(0.01), 14))
    next_year = po.forecast_orders(long, past, 10, 1)
    assert {r.step for r in next_year.collect()} == set(range(3, 15)) and math.isclose(po.grand_total(next_year).first().amount, 12.0)


def history_orders(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame(
        [(str(i), "2024", "1", f"t{i % 2}", f"h{i % 3}", "o", "c", f"g{i % 4}", float(np.exp(rng.normal(8, 1)))) for i in range(500)],
        "doc_id string, fund_year string, item string, po_type string, huka string, porcurment_organization string, expanditure_type string, fingroup string, po_net_value double")


def test_generator_reaches_targets(spark):
    targets = spark.createDataFrame([("2026", "1", "2026", 3e7), ("2026", "2", "2027", 1000.0), ("2026", "3", "2027", 0.0)], "year string, month string, fund_year string, amount double")
    made = generate.synthetic_orders(history_orders(spark), targets, seed=1)
    again = generate.synthetic_orders(history_orders(spark).repartition(5), targets, seed=1)
    assert made.exceptAll(again).count() == 0
    rows = made.collect()
    assert len({(r.doc_id, r.fund_year, r.item) for r in rows}) == len(rows) > 4096
    assert sorted(int(r.doc_id[:-1]) for r in rows) == list(range(len(rows)))
    for date, amount in (("01.01.2026", 3e7), ("01.02.2026", 1000.0)):
        part = sorted((int(r.doc_id[:-1]), r.po_net_value) for r in rows if r.order_date == date)
        total = sum(v for _, v in part)
        assert total >= amount and total - part[-1][1] < amount
    assert {r.fingroup for r in rows} <= {"g0", "g1", "g2", "g3"}


def test_a_draw_stays_one_row_while_its_attributes_are_drawn(spark):
    targets = spark.createDataFrame([("2026", "1", "2026", 3e6), ("2026", "2", "2027", 1000.0)], "year string, month string, fund_year string, amount double")
    made = generate.synthetic_orders(history_orders(spark), targets, seed=1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    assert made.where(F.concat(*po.ATTRIBUTES).isNull()).count() == 0


def test_class_scores_equal_the_grid(spark):
    """The class from the counts alone is that of the whole grid of shares, also for values no order had."""
    orders = history_orders(spark)
    classed = generate.with_value_class(orders, bins=8)
    grid = {(r.value_class, r.attribute, r.value): r.probability for r in generate.class_frequencies(classed).collect()}
    model = generate.class_model(classed)
    classes = {r.value_class: r.rows for r in model.classes.collect()}
    strange = spark.createDataFrame([("x", "2024", "1", "t0", "h1", "o", "c", "g3", 1.0), ("y", "2024", "1", "never", None, "no", "ne", "of", 1.0)], orders.schema)
    for r in generate.class_of_features(model, orders.unionByName(strange)).collect():
        scores = {c: math.log(n) + sum(math.log(grid.get((c, a, r[a]), 1 / (n + model.sizes[a]))) for a in po.ATTRIBUTES) for c, n in classes.items()}
        assert scores[r.likely_class] == pytest.approx(max(scores.values()))


def test_drawn_shares(spark):
    """Seen values are drawn by their counts and one more, all others of the attribute once each."""
    attributes = ["po_type"]
    rows = [(1, f"v{k:03d}") for k in range(0, 90, 3) for _ in range(k % 4 + 1)] + [(2, f"v{k:03d}") for k in range(100)]
    model = generate.class_model(spark.createDataFrame(rows, "value_class int, po_type string"), attributes)
    assert model.sizes == {"po_type": 100}
    drawn = spark.range(60_000).select(F.col("id").alias("draw"), F.lit(1).alias("value_class"))
    found = {r.po_type: r["count"] for r in generate.draw_attributes(drawn, model, ["draw"], 5).groupBy("po_type").count().collect()}
    assert sum(found.values()) == 60_000 and set(found) == {f"v{k:03d}" for k in range(100)}
    lots = {f"v{k:03d}": (k % 4 + 2 if k % 3 == 0 and k < 90 else 1) for k in range(100)}
    whole = sum(lots.values())
    chi = sum((found[v] - 60_000 * n / whole) ** 2 / (60_000 * n / whole) for v, n in lots.items())
    assert chi < 150  # 99 degrees of freedom


def test_a_hundred_thousand_values_of_an_attribute(spark):
    rows = spark.range(200_000).select((F.col("id") % 4 + 1).cast("int").alias("value_class"), F.concat(F.lit("v"), (F.col("id") % 100_000).cast("string")).alias("po_type"))
    model = generate.class_model(rows, ["po_type"])
    drawn = spark.range(20_000).select(F.col("id").alias("draw"), (F.col("id") % 4 + 1).cast("int").alias("value_class"))
    made = generate.draw_attributes(drawn, model, ["draw"], 1)
    assert made.count() == 20_000 == made.where("po_type rlike '^v[0-9]+$'").count()
    own = made.where(F.expr("int(substr(po_type, 2)) % 4 + 1 = value_class")).count() / 20_000
    # a class saw 25,000 values twice, 3 lots each, and 75,000 others have one lot each
    assert abs(own - 0.5) < 0.02 and made.select("po_type").distinct().count() > 15_000


def test_no_targets_no_orders(spark):
    empty = spark.createDataFrame([], "year string, month string, fund_year string, amount double")
    made = generate.synthetic_orders(history_orders(spark), empty)
    assert made.count() == 0 and made.columns[:3] == KEY and "order_date" in made.columns


def test_frequencies_sum_to_one(spark):
    f = generate.class_frequencies(generate.with_value_class(history_orders(spark)))
    sums = f.groupBy("value_class", "attribute").agg(F.sum("probability").alias("p")).collect()
    assert all(math.isclose(r.p, 1.0) for r in sums)


def test_document_steps(spark):
    cols = "doc string, group string, year int, month int, volume double, fund_year int"
    orders = spark.createDataFrame([("O", "g", 2020, 5, 1.0, 2021), ("O", "g", 2021, 1, 2.0, 2021), ("O", "g", 2021, 4, 4.0, 2020), ("O", "g", 2022, 3, 9.0, 2020)], cols)
    invoices = spark.createDataFrame([("RE", "g", 2020, 12, 1.0), ("ZY", "g", 2021, 6, 1.0)], "doc string, group string, year int, month int, volume double")
    got = documents.prepare(orders, invoices).orderBy("year", "month").collect()
    assert [(r.year, r.month, r.volume) for r in got] == [(2021, 1, 3.0), (2021, 4, 7.0)]
    assert {r.doc for r in documents.merge_invoice_docs(invoices).collect()} == {"RE"}


def test_residual_guards(spark):
    lag = {f"resid_share_lag_{k}": F.lit(0.0) for k in residual.LAGS}
    base = spark.range(40).select(F.when(F.col("id") < 20, "a").when(F.col("id") < 32, "b").otherwise("c").alias("k"),
                                  F.when(F.col("id") < 20, (F.col("id") % 2).cast("string")).otherwise("x").alias("value"), F.lit("f").alias("feature"), F.col("id").cast("double").alias("resid_share")).withColumns(lag)
    got = {r.k: r.usable for r in residual.usable_keys(base, ["k"]).collect()}
    assert got == {"a": True, "b": False, "c": False}


class HalfOfLast:
    """In place of the fitted model: half of the last share plus the value's level."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("resid_share_lag_1") / 2 + F.col("value_level") + F.col("month_no") / 10)


def _rolled_by_hand(rows, spread, levels, per_value, steps):
    """rows: (k, feature, value, month, lags 1 3 6 12) -> total by (k, step)."""
    latest = {}
    for k, f, v, m, *lag in rows:
        at = (k, f, v) if per_value else (k, f)
        latest[at] = max(latest.get(at, ("", "")), (m, v, lag))
    total = {(k, h): 0.0 for k in spread for h in range(steps)}
    for at, (m, v, lag) in latest.items():
        mean, std = spread[at[0]]
        lag, month = list(lag), int(m[5:7])
        for h in range(steps):
            y = min(max(lag[0] / 2 + levels[at[1], v] + month / 10, mean - std), mean + std)
            y = min(max(y, lag[0] - 2 * std), lag[0] + 2 * std)
            lag, month = [y, *lag[:-1]], h % 12 + 1
            total[at[0], h] += y
    return total


@pytest.mark.parametrize("per_value", [False, True])
def test_residual_parts_of_several_attributes(spark, per_value):
    rng = random.Random(4)
    rows = []
    for k in ("a", "b"):
        for f, values in (("office", ["x", "y"]), ("partner", ["p", "q", "r"]), ("single", ["only"])):
            for i in range(12):
                rows.append((k, f, values[i % len(values)], f"2001-{i + 1:02d}-28", *[rng.uniform(-30, 30) for _ in range(5)]))
    names = ["resid_share", *[f"resid_share_lag_{n}" for n in residual.LAGS]]
    table = spark.createDataFrame(rows, "k string, feature string, value string, month string, " + ", ".join(f"{n} double" for n in names))
    table = table.withColumn("month", F.to_date("month")).withColumns({"month_no": F.month("month"), "year": F.year("month")})
    left = {"a": [1.0, 5.0, -7.0], "b": [2.0, 40.0, 60.0], "no_model": [1.0, 2.0, 4.0]}
    residuals = spark.createDataFrame([(k, v) for k, vs in left.items() for v in vs], "k string, resid double")
    ahead = residual.roll_forward(HalfOfLast(), table, residuals, ["k"], "2002-01-31", 14, per_value=per_value)
    got = residual.total_by_month(ahead, residuals, ["k"], "2002-01-31", 14).collect()
    spread = {k: (statistics.mean(v), statistics.stdev(v)) for k, v in left.items()}
    seen = {}
    for _, f, v, _, share, *_ in rows:
        seen.setdefault((f, v), []).append(share)
    levels = {at: statistics.mean(v) for at, v in seen.items()}
    kept = [(k, f, v, m, *lag) for k, f, v, m, _, *lag in rows if f != "single"]
    want = _rolled_by_hand(kept, spread, levels, per_value, 14)
    assert len(got) == 42
    for x in got:
        at = (x.month.year - 2002) * 12 + x.month.month - 1
        assert math.isclose(x.value, want[x.k, at], abs_tol=1e-9), (x, want[x.k, at])
    assert all(x.value == 0 for x in got if x.k == "no_model")


def test_attributes_of_an_order_in_one_join(spark):
    payments = spark.createDataFrame([("k", "1", "2001-03-05", 5.0), ("k", "1", "2001-03-09", 2.0), ("k", "2", "2001-03-01", 4.0), ("k", "#", "2001-03-01", 9.0), ("k", None, "2001-03-01", 9.0)],
                                     "k string, order_id string, payment_date string, amount double").withColumn("payment_date", F.to_date("payment_date"))
    orders = spark.createDataFrame([("1", 2, "late", 7), ("1", 1, None, 8), ("2", 1, "o", None)], "order_id string, starting_date int, office string, partner int")
    got = residual.feature_months(payments, orders, ["k"], ["office", "partner"]).collect()
    assert {(r.feature, r.value, r.feature_amount) for r in got} == {("office", "late", 7.0), ("partner", "8", 7.0), ("office", "o", 4.0)}


def test_no_usable_attribute(spark):
    empty = spark.createDataFrame([], "k string, feature string, value string, month date, month_no int, year int, resid_share double, " + ", ".join(f"resid_share_lag_{n} double" for n in residual.LAGS))
    residuals = spark.createDataFrame([("a", 1.0)], "k string, resid double")
    assert residual.fit(empty, ["k"]) is None
    ahead = residual.roll_forward(None, empty, residuals, ["k"], "2002-01-31", 2)
    got = residual.total_by_month(ahead, residuals, ["k"], "2002-01-31", 2)
    assert [(r.k, r.value) for r in got.collect()] == [("a", 0.0)] * 2


def test_model_sets():
    assert len(M.DEFAULT_MODELS) == 9 and len(M.PAIR_MODELS) == 4


def test_generator_with_null_attributes_and_a_single_order(spark):
    schema = "doc_id string, fund_year string, item string, po_type string, huka string, porcurment_organization string, expanditure_type string, fingroup string, po_net_value double"
    targets = spark.createDataFrame([("2026", "1", "2026", 500.0), ("2026", "2", "2026", 0.0)], "year string, month string, fund_year string, amount double")
    one = spark.createDataFrame([("1", "2020", "10", "a", None, "b", "c", "d", 100.0)], schema)
    made = generate.synthetic_orders(one, targets).collect()
    assert sum(r.po_net_value for r in made) >= 500 and all(r.huka is None and r.po_type == "a" for r in made)
    two = one.union(spark.createDataFrame([("2", "2020", "10", "a", "h", "b", "c", "d", 900.0)], schema))
    classed = generate.with_value_class(two)
    likely = generate.class_of_features(generate.class_model(classed), two)
    assert likely.count() == 2


def _numbers(spark, n=3000):
    return spark.range(n).select(
        ((F.col("id") * 7919) % 100 / 100.0).alias("a"), ((F.col("id") * 104729) % 50).cast("double").alias("b"), F.lit(1.0).alias("c"), "id").withColumn(
        "y", F.when(F.col("a") > 0.5, 1.0).otherwise(0.0) + F.when(F.col("b") > 30, 0.4).otherwise(0.0))


def test_forest_does_not_depend_on_how_rows_are_dealt(spark):
    rows = _numbers(spark)
    one, other = (fit_trees(x, ["a", "b", "c"], "y", 25, 2, seed=3).rows() for x in (rows.coalesce(1), rows.repartition(7)))
    assert one == other and len({r[2:] for r in one}) > 25
    assert all(r[2] != 2 for r in one)  # nothing to split on


def test_forest_against_tables_and_walks(spark):
    model = fit_trees(_numbers(spark), ["a", "b", "c"], "y", 9, 4, seed=1)
    columns = [np.random.default_rng(i).choice(np.r_[np.arange(0, 60, 0.5), [t for r in model.rows() for t in [r[3]]]], 400) for i in range(3)]
    scorer = model.scorer()
    by_hand = [np.mean([t.predict(x) for t in model.trees]) for x in zip(*columns)]
    assert scorer.tables and np.allclose(scorer.predict(columns), by_hand)
    scorer.trees = model.trees
    assert np.allclose(scorer.predict(columns), by_hand)
    with pytest.raises(ValueError):
        scorer.predict([*columns[:2], np.r_[columns[2][:-1], np.nan]])


def test_draws_are_poisson_and_repeated_rows_differ():
    found = draws(apart(np.full(4000, 5)), 50, poisson_table(0.8))
    assert found.shape == (4000, 50) and abs(found.mean() - 0.8) < 0.02 and abs(found.var() - 0.8) < 0.03
    assert len({bytes(r) for r in found[:100]}) == 100


def test_roll_forward_is_one_pass_over_the_rows(forest):
    model, _, features, rows = forest
    some = rows.withColumn("po_net_value", F.lit(1.0))
    plan = po.roll_forward(model, some, 14, features)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "features" not in plan


def test_split_shares_lay_the_training_rows_out_once(spark, tmp_path, monkeypatch):
    from ledgerline.queries import QUERIES, load_all, orders
    load_all()
    table = spark.range(500).select(*[F.col("id").cast("string").alias(k) for k in KEY], F.col("id").cast("int").alias("age"), F.rand().alias("target"))
    calls = []
    monkeypatch.setattr(orders, "training", lambda *a: calls.append(1) or table)
    found = QUERIES["k09_hash_split_shares"](spark, str(tmp_path))
    parts = po.split_by_hash(table, KEY + ["age"])
    assert {r.part: r.cnt for r in found.collect()} == {"fit": parts[0].count(), "test": parts[1].count()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "target" not in plan and len(calls) == 1


@pytest.mark.parametrize("query", ["k08_forest_scores", "k10_roll_forward_by_month", "k11_current_year_with_past", "k12_group_totals"])
def test_queries_learn_from_every_training_row(query, spark, tmp_path, monkeypatch):
    """The model is fitted to the table that ``training`` gives without a fraction."""
    from ledgerline.queries import QUERIES, learning, load_all
    load_all()
    names = [*KEY, *po.Features().all(), "target", "copies"]
    rows = spark.range(700).select(*[(F.col("id") % 5).cast("string").alias(c) if c not in KEY else F.col("id").cast("string").alias(c) for c in names])

    class Done(Exception):
        pass

    def training(spark, d, window=4, ready=None, **kw):
        assert not kw
        return rows

    def train(table, features, **kw):
        assert not kw and table.count() == 700 and {*KEY, *features.all(), "target"} <= set(table.columns)
        raise Done

    monkeypatch.setattr(learning, "prepared", lambda *a: None)
    monkeypatch.setattr(learning, "training", training)
    monkeypatch.setattr(po, "train", train)
    with pytest.raises(Done):
        QUERIES[query](spark, str(tmp_path))


def test_bounds_of_bins_come_from_all_rows(spark):
    n = 40_000
    x = np.random.default_rng(8)
    columns = [x.normal(size=n), np.where(x.random(n) < 0.6, 0.25, x.random(n)), np.floor(x.random(n) * 20), np.full(n, 3.0), np.floor(x.random(n) ** 4 * 900) / 7, np.arange(n) % 33.0]
    rows = spark.createDataFrame(list(zip(*[c.tolist() for c in columns])), ", ".join(f"x{i} double" for i in range(len(columns)))).repartition(7)
    found = trees_of.all_bounds(rows, rows.columns, n)
    for got, c in zip(found, columns):
        assert got.tolist() == trees_of.split_bounds(c).tolist()


def test_alike_rows_are_summed_as_one(spark):
    """Every row is in the sums: by hand from how often each tree draws each group of alike rows."""
    rows = spark.range(9000).select((F.col("id") % 3).cast("double").alias("x0"), (F.col("id") % 2 * 1.5).alias("x1"), F.when(F.col("id") % 9 < 4, 0.0).otherwise(F.col("id") % 7 / 7.0).alias("y"))
    bounds, unit, path = [np.array([0.5, 1.5]), np.array([1.0])], 700.0, ((0, 1, True),)
    alike = trees_of.binned(rows.repartition(5), 2, bounds, unit, 4)
    nodes = [(0, ()), (1, ()), (1, path), (2, path)]
    found = {(r.node, r.cell): (r.n, r.s) for r in trees_of._sums(alike, 2, bounds, nodes, 3, 0.8, 100).collect()}
    want, rows_of = {}, alike.collect()
    assert sum(r.m for r in rows_of) == 9000 and len(rows_of) < 60 and max(r.m for r in rows_of) > trees_of.LUMP
    drawn = trees_of.weights(np.array([r.h for r in rows_of]), np.array([r.m for r in rows_of]), 3, 0.8)
    for r, w in zip(rows_of, drawn):
        a, b = r.k0 & 31, r.k0 >> 5 & 31
        for i, (tree, path) in enumerate(nodes):
            for cell in (a, 3 + b) if not path or a <= 1 else ():
                n, s = want.get((i, cell), (0, 0))
                want[i, cell] = (n + int(w[tree]), s + int(w[tree]) * r.u)
    assert found == want
    many = trees_of.weights(np.arange(300), np.repeat([3, 40, 5000], 100), 200, 0.8)
    for part, m in zip(np.split(many, 3), (3, 40, 5000)):
        assert abs(part.mean() / (0.8 * m) - 1) < 0.01 and abs(part.var() / (0.8 * m) - 1) < 0.05
    assert [x.stop for x in trees_of._blocks(np.full(5, trees_of.BLOCK_ROWS // 2))] == [2, 4, 5]


def test_draws_are_never_broadcast(spark):
    """They are many times the chunks by which Spark sizes them; only a row per amount class or per target may be sent."""
    targets = cut_lineage(spark.createDataFrame([("2026", str(m), "2026", 4000.0) for m in range(1, 4)], "year string, month string, fund_year string, amount double"))
    orders = cut_lineage(history_orders(spark))
    classes = generate.class_model(generate.with_value_class(orders), po.ATTRIBUTES).classes.select("value_class")
    draws = generate.draw_amounts(targets, generate.log_moments(orders).first(), classes, 1.5, 1)
    kept = generate.number_orders(generate.up_to_target(draws))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert kept.count() > 0 and any("chunk" in x for x in joins)
    assert all("SortMergeJoin" in x for x in joins if "chunk" in x)
    assert all("BuildRight" in x for x in joins if "BroadcastHashJoin" in x)
