"""The global sequence forecast against loops in numpy."""

import datetime
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerline.operators import series
from ledgerline.plans import documents as D

KEYS = ["doc", "group"]


def month_end(at):
    year, month = divmod(at + 1, 12)
    return datetime.date(year, month + 1, 1) - datetime.timedelta(days=1)


@pytest.fixture(scope="module")
def scaled(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):
        level, slope = rng.uniform(50, 500), rng.uniform(-2, 6)
        for t in range(48):
            value = level + slope * t + 40 * math.sin(t * math.pi / 6 + k) + rng.normal(0, 5)
            rows.append((f"d{k}", "g", month_end(1996 * 12 + t), float(value)))
    rows += [("flat", "g", month_end(1996 * 12 + t), 5.0) for t in range(48)]
    rows += [("short", "g", month_end(1999 * 12 + t), float(t)) for t in range(7)]
    df = spark.createDataFrame(rows, "doc string, group string, month date, volume double")
    return series.min_max_scale(df, KEYS, "volume").cache()


def slow_state(values, months):
    n = len(values)
    t = np.arange(n)
    angle = np.array([2 * math.pi * m.month / 12 for m in months])
    slope = np.polyfit(t, values, 1)[0] * 12
    profile = [values.mean(), values.std(), slope, 2 * (values * np.cos(angle)).sum() / n, 2 * (values * np.sin(angle)).sum() / n]
    paces = [0.0]
    for i in range(12, n):
        paces.append(0.8 * paces[-1] + 0.2 * (values[i] - values[i - 12]))
    return profile, paces


def test_packed_series_and_rows_equal_a_loop(spark, scaled):
    packed = D.pack_series(scaled, KEYS)
    found = {r.doc: r for r in packed.collect()}
    assert set(found) == {f"d{k}" for k in range(6)} | {"flat"}
    rows = {(r.doc, r.month): r for r in D.sequence_rows(packed, KEYS).collect()}
    assert len(rows) == 7 * 36
    for doc, r in found.items():
        values = np.array(r["values"])
        profile, paces = slow_state(values, r.months)
        assert np.allclose([r[c] for c in D.PROFILE], profile, atol=1e-9) and np.allclose(r.paces, paces, atol=1e-12)
        for t in (12, 20, 47):
            row = rows[doc, r.months[t]]
            assert np.allclose([row[f"scaled_lag_{k}"] for k in range(1, 13)], values[t - 12:t][::-1])
            assert row.scaled == values[t] and row.pace == pytest.approx(paces[t - 12]) and row.month_no == r.months[t].month


def test_two_series_share_no_feature_by_chance(spark, scaled):
    """Three hundred series of different course have as many different profiles."""
    many = scaled.where("doc <> 'short'").crossJoin(spark.range(50)).withColumns({
        "group": F.concat("group", F.col("id").cast("string")), "scaled": F.col("scaled") * (1 + F.col("id") / 100)})
    packed = D.pack_series(many, KEYS).where("doc <> 'flat'")
    assert packed.select(*D.PROFILE).distinct().count() == packed.count() == 300


def roll_by_hand(model, start, steps, seed):
    lags, pace, month = [start[f"scaled_lag_{k}"] for k in range(1, 13)], start.pace, start.month_no
    path = []
    for h in range(steps):
        y = model.predict(Vectors.dense([*lags, month, pace, *[start[c] for c in D.PROFILE]]))
        y = seed[h] if h < len(seed) else y
        pace = 0.8 * pace + 0.2 * (y - lags[11])
        lags, month = [y, *lags[:11]], month % 12 + 1
        path.append(max(y, 0.0))
    return path


@pytest.mark.parametrize("seed", [[], [0.9, 0.8, 0.95]])
def test_roll_equals_a_loop(spark, scaled, seed):
    packed = D.pack_series(scaled, KEYS)
    model = D.fit_sequence(D.sequence_rows(packed, KEYS), KEYS, trees=4)
    start = D.next_inputs(packed, KEYS).withColumn("seed", F.array(*map(F.lit, seed)).cast("array<double>"))
    first = {r.doc: r for r in start.collect()}
    rolled = D.roll_sequence(model, start, 24, len(seed)).collect()
    assert len(rolled) == 7
    for r in rolled:
        assert len(r.path) == 24 and np.allclose(r.path, roll_by_hand(model, first[r.doc], 24, seed), atol=1e-9)
    if seed:
        assert all(r.path[:3] == seed for r in rolled)


def test_seed_carries_into_the_rest(spark, scaled):
    packed = D.pack_series(scaled, KEYS)
    model = D.fit_sequence(D.sequence_rows(packed, KEYS), KEYS, trees=10)
    start = D.next_inputs(packed, KEYS)
    paths = []
    for seed in ([0.1] * 3, [1.6] * 3):
        rolled = D.roll_sequence(model, start.withColumn("seed", F.array(*map(F.lit, seed))), 24, 3)
        paths.append({r.doc: r.path for r in rolled.collect()})
    assert any(paths[0][d][3:] != paths[1][d][3:] for d in paths[0])


def test_noise_changes_the_fit_and_repeats(spark, scaled):
    packed = D.pack_series(scaled, KEYS)
    rows = D.sequence_rows(packed, KEYS)
    noisy = D.with_noise(rows, KEYS, 0.05, 3, seed=2)
    assert noisy.count() == 3 * rows.count()
    both = noisy.alias("n").join(rows.alias("c"), [*KEYS, "month"])
    gap = both.agg(*[F.stddev(F.col(f"n.scaled_lag_{k}") - F.col(f"c.scaled_lag_{k}")).alias(f"s{k}") for k in (1, 7, 12)],
                   F.corr(F.col("n.scaled_lag_1") - F.col("c.scaled_lag_1"), F.col("n.scaled_lag_2") - F.col("c.scaled_lag_2")).alias("r")).first()
    assert all(0.045 < gap[f"s{k}"] < 0.055 for k in (1, 7, 12)) and abs(gap.r) < 0.1
    fits = [D.fit_sequence(rows, KEYS, trees=3, noise=noise, seed=seed).toDebugString for noise, seed in ((0.0, 1), (0.05, 1), (0.05, 1), (0.05, 2))]
    strip = [f.split("\n", 1)[1] for f in fits]
    assert strip[1] == strip[2] and strip[0] != strip[1] != strip[3]


def test_both_years_and_their_errors(spark):
    rng = np.random.default_rng(1)
    rows = [(d, "g", y, m, float(1_000 + 100 * m + 50 * (y - 1996) + rng.normal(0, 20))) for d in "ab" for y in range(1996, 2001) for m in range(1, 13)]
    rows += [("gone", "g", y, m, 900.0) for y in range(1996, 2000) for m in range(1, 13)]
    docs = spark.createDataFrame(rows, "doc string, group string, year int, month int, volume double")
    months = D.sequence_months(docs, 2000, 10.0, seed_months=4, trees=10).collect()
    assert len(months) == 3 * 24 and {r.month.year for r in months} == {2000, 2001}
    actual = {(d, m): v for d, _, y, m, v in rows if y == 2000}
    for r in months:
        assert r.known == (r.month.year == 2000 and r.month.month <= 4)
        if r.known and r.doc != "gone":
            assert r.value == pytest.approx(max(actual[r.doc, r.month.month], min(v for d, _, y, _, v in rows if d == r.doc and y < 2000)))
    report = {(r.doc, r.year): r for r in D.sequence_forecast(docs, 2000, 10.0, seed_months=4, trees=10).collect()}
    assert set(report) == {(d, y) for d in ("a", "b", "gone") for y in (2000, 2001)}
    for (doc, year), r in report.items():
        if doc == "gone":  # silent in the target year
            assert r.forecast == 0 and r.actual == 0 and r.rel_err is None
        else:
            assert r.actual == pytest.approx(sum(v for (d, _), v in actual.items() if d == doc))
            assert r.forecast == pytest.approx(sum(x.value for x in months if x.doc == doc and x.month.year == year))
            assert abs(r.rel_err) < 0.15
