"""The panel operators on the small cases that pin their semantics."""

import json
import math
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.columns import close_to, complete
from tidepanel.functions.columns import day as to_day
from tidepanel.functions.columns import finite, number, qlike, regime
from tidepanel.operators import evaluation as ev
from tidepanel.operators import forests, garch, guards, panels, ranking, temporal, timeseries, treekernel
from tidepanel.sources import scans, sinks

c = F.col


def day(i, start=date(2010, 1, 1)):
    return start + timedelta(days=i)


def series(spark, values, entity=1):
    return spark.createDataFrame([(entity, day(i), None if x is None else float(x)) for i, x in enumerate(values)], "permno long, d date, r double")


def column(df, name):
    return [r[name] for r in df.orderBy("permno", "d").collect()]


def test_membership_doesnt_multiply_rows(spark):
    rows = spark.createDataFrame([(1, day(0)), (1, day(5)), (1, day(10)), (1, day(99)), (2, day(0)), (3, day(0))], "permno long, dlycaldt date")
    spells = spark.createDataFrame([(1, day(0), day(2)), (1, day(9), day(11)), (2, day(0), day(0)), (3, None, day(9))], "permno long, universe_start date, universe_end date")
    out = temporal.membership_flag(rows, spells)
    assert [r["in_sp500_membership"] for r in out.orderBy("permno", "dlycaldt").collect()] == [True, False, True, False, True, False]
    assert temporal.membership_flag(rows, spells.limit(0)).filter("in_sp500_membership").count() == 0


def test_validity_join(spark):
    rows = spark.createDataFrame([(1, day(0)), (1, day(5)), (1, day(50)), (2, day(0))], "permno long, d date")
    links = spark.createDataFrame([("a", 1, day(0), day(5)), ("b", 1, day(5), None)], "gvkey string, permno long, linkdt date, linkenddt date")
    out = temporal.validity_join(rows, links, on="permno", day="d", take=["gvkey"])
    assert sorted((r["d"], r["gvkey"]) for r in out.collect()) == [(day(0), "a"), (day(5), "a"), (day(5), "b"), (day(50), "b")]
    assert temporal.unmatched_keys(rows, out, ["permno", "d"]).count() == 1


def test_event_window_is_open_at_the_origin(spark):
    w = spark.createDataFrame([(1, day(0), day(10)), (1, day(5), day(6)), (1, day(7), None), (2, day(0), day(5))], "permno long, dlycaldt date, target_end_date date")
    e = spark.createDataFrame([(1, day(0)), (1, day(3)), (1, day(3)), (1, day(6)), (1, day(11)), (1, None)], "permno long, anndats date")
    out = temporal.forward_event_count(w, e).orderBy("permno", "dlycaldt").collect()
    assert [(r["event_count"], r["has_event"]) for r in out] == [(2, True), (1, True), (None, None), (0, False)]


def test_event_counts_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    start = date(2014, 12, 1)
    events = [(int(rng.integers(0, 4)), start + timedelta(days=int(rng.integers(0, 800)))) for _ in range(150)]
    windows = [(i, int(rng.integers(0, 6)), start + timedelta(days=int(rng.integers(-60, 900))), int(rng.integers(-5, 120))) for i in range(400)]
    windows = [(i, e, o, o + timedelta(days=n)) for i, e, o, n in windows] + [(900, 1, start, None), (901, None, start, start)]
    got = temporal.forward_event_count(spark.createDataFrame(windows, "i long, permno long, dlycaldt date, target_end_date date"), spark.createDataFrame(events, "permno long, anndats date"))
    for r in got.collect():
        days = {d for e, d in events if e == r["permno"] and r["target_end_date"] and r["dlycaldt"] < d <= r["target_end_date"]}
        assert (r["event_count"], r["has_event"]) == ((len(days), bool(days)) if r["target_end_date"] else (None, None))


def test_clip_and_calendar(spark):
    s = spark.createDataFrame([(1, day(0), None), (2, day(0), day(3)), (3, day(20), day(30))], "permno long, a date, b date")
    out = temporal.clipped(s, "a", "b", str(day(4)), str(day(10))).collect()
    assert [(r["permno"], r["a"], r["b"]) for r in out] == [(1, day(4), day(10))]
    days = spark.createDataFrame([(day(0),), (day(1),), (day(1),), (None,)], "d date")
    index = spark.createDataFrame([(day(0), 1.0), (day(9), 999.0)], "x date, v double")
    assert [r[0] for r in temporal.calendar_gaps(days, index, day="d", series_day="x").collect()] == [day(1)]
    assert temporal.on_calendar(days, index, day="d", series_day="x", value="v").filter("v = 999").count() == 0


def test_features_look_back_only(spark):
    base = np.linspace(-0.02, 0.02, 300)
    later = base.copy()
    later[-1] = 2.0
    a = timeseries.return_features(series(spark, base)).orderBy("d").toPandas()
    b = timeseries.return_features(series(spark, later)).orderBy("d").toPandas()
    pd.testing.assert_frame_equal(a.iloc[:-1], b.iloc[:-1])
    for k in timeseries.STD_ROWS:
        np.testing.assert_allclose(a[f"return_std_{k}d"], pd.Series(base).rolling(k).std(), atol=1e-12)
    np.testing.assert_allclose(a["mean_abs_return_21d"], pd.Series(np.abs(base)).rolling(21).mean(), atol=1e-14)


def test_gaps_blank_frames_and_equal_values_have_no_spread(spark):
    values = [0.01] * 70 + [None] + [0.01] * 80
    out = timeseries.return_features(series(spark, values)).orderBy("d").toPandas()
    for k in (5, 63):
        want = pd.Series([np.nan if v is None else v for v in values]).rolling(k).std().round(12)
        np.testing.assert_allclose(out[f"return_std_{k}d"], want, atol=1e-12)


def test_compounding(spark):
    out = timeseries.return_features(series(spark, [0.1, -0.1, 0.05, 0, 0.02, -1.0, None, 0.1, 0.1, 0.1, 0.1, 0.1]), std=(), mean_abs=(), compound=(5,))
    got = column(out, "compounded_return_5d")
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(1.1 * 0.9 * 1.05 * 1.02 - 1)
    assert got[5:10] == [-1.0] * 5 and got[10] is None and got[11] == pytest.approx(1.1**5 - 1)


def test_ewma_equals_pandas(spark):
    r = np.random.default_rng(1).normal(0, 0.02, 300)
    r[[0, 1, 40, 41, 90, 299]] = np.nan
    out = timeseries.ewma_volatility(series(spark, [None if np.isnan(x) else x for x in r])).orderBy("d").toPandas()
    want = np.sqrt(pd.Series(r**2).ewm(alpha=0.06, adjust=False).mean())
    count = pd.Series(r).notna().cumsum()
    np.testing.assert_allclose(out["ewma_by_returns"], want.where(count >= 21), rtol=1e-10)
    np.testing.assert_allclose(out["ewma_by_rows"], want.where(np.arange(300) >= 20), rtol=1e-10)


def test_ewma_of_a_long_history_equals_a_plain_fold(spark):
    r = np.random.default_rng(2).normal(0, 0.02, 50_000)
    r[::97] = np.nan
    data = pd.DataFrame({"permno": 1, "d": [date(1900, 1, 1) + timedelta(days=i) for i in range(len(r))], "r": r})
    df = spark.createDataFrame(data).withColumn("r", F.nanvl("r", F.lit(None)))
    got = timeseries.ewma_volatility(df).orderBy("d").select("ewma_by_rows").toPandas()["ewma_by_rows"].to_numpy(float)
    mean, age, want = None, 1.0, []
    for x in r:
        if np.isnan(x):
            age = age * 0.94 if mean is not None else 1.0
        else:
            mean = x * x if mean is None else (age * 0.94 * mean + 0.06 * x * x) / (age * 0.94 + 0.06)
            age = 1.0
        want.append(np.nan if mean is None else math.sqrt(mean))
    assert len(got) == len(want) and np.isnan(got[:20]).all()
    np.testing.assert_allclose(got[20:], want[20:], rtol=1e-12)


def test_an_extreme_reading_leaves_no_trace_in_later_frames(spark):
    values = np.random.default_rng(3).normal(0, 0.002, 200)
    clean = timeseries.return_features(series(spark, values)).orderBy("d").toPandas()
    values[20] = 1000.0
    dirty = timeseries.return_features(series(spark, values)).orderBy("d").toPandas()
    for k in (5, 21, 63, 126):
        np.testing.assert_allclose(dirty[f"return_std_{k}d"][21 + k :], clean[f"return_std_{k}d"][21 + k :], rtol=1e-12)


def test_returns_below_a_total_loss(spark):
    df = series(spark, [0.1, -1.5, 0.1, 0.1, 0.1, 0.1, 0.1])
    got = column(timeseries.return_features(df, std=(), mean_abs=()), "compounded_return_5d")
    assert got[:6] == [None] * 6 and got[6] == pytest.approx(1.1**5 - 1)
    with pytest.raises(guards.GuardError):
        timeseries.require_possible(df)
    assert timeseries.require_possible(series(spark, [-1.0, None])).count() == 2


def test_splits_and_masks(spark):
    rows = spark.createDataFrame([(date(2012, 1, 3), date(2012, 2, 3)), (date(2012, 12, 20), date(2013, 1, 20)), (date(2013, 1, 1), date(2013, 2, 1)), (date(2014, 12, 20), date(2015, 1, 20)), (date(2015, 1, 1), date(2015, 2, 1)), (date(2012, 5, 5), None)], "d date, target_end_date date")
    out = timeseries.sample_masks(timeseries.split_labels(rows), finite=c("target_end_date").isNotNull()).collect()
    assert [r["split"] for r in out] == ["train", "train", "validation", "validation", "test", "train"]
    assert [r["crosses_split_boundary"] for r in out] == [False, True, False, True, False, False]
    assert [[r[m] for r in out] for m in ("tuning_train", "validation", "final_refit", "test")] == [[True, False, False, False, False, False], [False, False, True, False, False, False], [True, True, True, False, False, False], [False, False, False, False, True, False]]


def test_columns(spark):
    df = spark.createDataFrame([(1.0, "2"), (float("nan"), "x"), (float("inf"), None), (None, "3")], "a double, s string")
    assert [r[0] for r in df.select(finite(c("a"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(number(c("s"))).collect()] == [2.0, None, None, 3.0]
    assert [r[0] for r in df.select(complete(["a", "s"])).collect()] == [True, True, False, False]
    v = spark.createDataFrame([(14.0,), (14.01,), (20.0,), (24.99,), (25.0,), (None,)], "v double")
    assert [r[0] for r in v.select(regime(c("v"), F.lit(14.0), F.lit(25.0))).collect()] == ["low", "middle", "middle", "middle", "high", None]
    one = spark.range(1)
    assert one.select(qlike(F.lit(2.0), F.lit(1.0))).first()[0] == pytest.approx(4 - math.log(4) - 1)
    assert one.select(close_to(F.lit(None).cast("double"), F.lit(None).cast("double")), close_to(F.lit(1.0), F.lit(1.1))).first() == (True, False)


def test_guards(spark):
    df = spark.createDataFrame([(1, day(0)), (1, day(0)), (2, day(1))], "permno long, d date")
    with pytest.raises(guards.GuardError):
        guards.require_unique(df, ["permno", "d"], "x")
    with pytest.raises(guards.GuardError):
        guards.require_known(df, df.filter("permno = 1"), "permno", "x")
    with pytest.raises(KeyError):
        guards.require_columns(df, ["nope"], "x")
    with pytest.raises(guards.GuardError):
        guards.require_rows(df, 2, "x")
    with pytest.raises(guards.GuardError):
        guards.require(df, {"late": c("d") > F.lit(day(0))}, "x")
    vix = spark.createDataFrame([(date(2010, 1, 1), 10.0, 11.0, 9.0, 10.5), (date(2010, 1, 2), None, None, None, None), (date(2010, 1, 3), 10.0, None, 9.0, 9.5), (date(2010, 1, 4), 20.0, 11.0, 9.0, 12.0), (date(2030, 1, 1), 10.0, 11.0, 9.0, -1.0)], "date date, vixo double, vixh double, vixl double, vix_close double")
    assert guards.violations(vix, guards.index_rules(date(2005, 1, 1), date(2024, 12, 31))).first().asDict() == {"missing_date": 0, "placeholder": 1, "partial": 1, "not_positive": 1, "close_outside": 2, "open_outside": 1, "outside_sample": 1}


def test_parameter_and_metadata_guards(spark):
    df = spark.createDataFrame([(1.0, 0.1, 0.8, 1.0), (1.0, 0.5, 0.6, 1.0), (None, None, None, None), (1.0, 0.1, 0.8, float("nan"))], "omega double, alpha double, beta double, initial double")
    assert guards.violations(df, {"bad": guards.bad_parameters()}).first()[0] == 2
    logs = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "v double, l double")
    assert guards.violations(logs, {"bad": guards.inconsistent_log("v", "l")}).first()[0] == 1
    for low, high in ((2.0, 1.0), (None, 1.0), (1.0, 1.0)):
        with pytest.raises(guards.GuardError):
            guards.require_ordered(low, high, "x")
    guards.require_partition({"g": ["a"], "h": ["b"]}, ["b", "a"], "x")
    with pytest.raises(guards.GuardError):
        guards.require_partition({"g": ["a"], "h": ["a"]}, ["b", "a"], "x")
    guards.require_same_identity({"a": {"h": 1}, "b": {"h": 1}}, ["h"])
    with pytest.raises(guards.GuardError):
        guards.require_same_identity({"a": {"h": 1}, "b": {"h": 2}}, ["h"])


def test_panels(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 1.0)], "k long, x double")
    assert panels.compare_populations(a, b, ["k"], "x").first() == (2, 1, 1, 1)
    with pytest.raises(guards.GuardError):
        panels.require_same_population(a, b, ["k"], "x", "b")
    with pytest.raises(guards.GuardError):
        panels.require_all_matched(a, b.drop("x"), ["k"], "b")
    with pytest.raises(guards.GuardError):
        panels.one_to_one(a, b.union(b), ["k"])
    assert panels.common_panel(a, {"b": b.withColumnRenamed("x", "y")}, ["k"], ["x", "y"]).count() == 2
    assert panels.first_per_key(spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k long, v long"), ["k"], ["v"]).orderBy("k").collect() == [(1, 2), (2, 5)]


def test_blocks():
    starts = ev.block_starts(10, 3, 5, 42)
    assert starts.shape == (5, 4) and (starts == ev.block_starts(10, 3, 5, 42)).all() and starts.max() <= 7
    with pytest.raises(ValueError):
        ev.block_starts(2, 3)
    x = np.arange(10.0) ** 2
    prefix = np.concatenate([[0], x.cumsum()])[:, None]
    index = (starts[:, :, None] + np.arange(3)).reshape(5, -1)[:, :10]
    np.testing.assert_allclose(ev.replicate_sums(prefix, starts, 3)[:, 0], x[index].sum(axis=1))


def test_bootstrap_and_intervals(spark):
    n = 40
    rng = np.random.default_rng(2)
    x = rng.normal(1, 1, n)
    daily = spark.createDataFrame([(day(i), "a", float(x[i]), 1.0) for i in range(n)] + [(day(i), "four", 8.0, 2.0) for i in range(n)], "d date, s string, num double, den double")
    values = ev.bootstrap_replicates(daily, day="d", series="s", numerator="num", denominator="den", block=5, replicates=300, seed=1)
    out = {r["series"]: r for r in ev.bootstrap_intervals(values).collect()}
    index = (ev.block_starts(n, 5, 300, 1)[:, :, None] + np.arange(5)).reshape(300, -1)[:, :n]
    low, high = np.percentile(x[index].mean(axis=1), [2.5, 97.5])
    assert out["a"]["estimate"] == pytest.approx(x.mean()) and out["a"]["ci_lower"] == pytest.approx(low) and out["a"]["ci_upper"] == pytest.approx(high)
    assert out["four"]["ci_lower"] == out["four"]["ci_upper"] == 4.0


def test_newey_west(spark):
    x = np.random.default_rng(4).normal(0.1, 1, 60)
    rows = [(day(i), "x", float(v)) for i, v in enumerate(x)] + [(day(99), "x", float("nan")), (day(98), "x", None)]
    rows += [(day(i), "zero", 0.0) for i in range(5)] + [(day(i), "two", 2.0) for i in range(5)] + [(day(0), "one", 1.0)]
    df = spark.createDataFrame(rows, "d date, s string, v double")
    out = {r["s"]: r for r in ev.with_p_value(ev.newey_west(df, series="s", day="d", value="v")).collect()}
    e = x - x.mean()
    lrv = e @ e / 60 + sum(2 * (1 - k / 21) * (e[k:] @ e[:-k]) / 60 for k in range(1, 21))
    se = math.sqrt(max(lrv, 0) / 60)
    assert out["x"]["standard_error"] == pytest.approx(se) and out["x"]["two_sided_p_value"] == pytest.approx(math.erfc(abs(x.mean() / se) / math.sqrt(2)))
    assert (out["zero"]["z_statistic"], out["zero"]["two_sided_p_value"], out["zero"]["lag"]) == (0.0, 1.0, 4)
    assert out["two"]["z_statistic"] == math.inf and out["two"]["two_sided_p_value"] == 0.0 and "one" not in out


def test_decisions(spark):
    one = spark.range(1)
    assert one.select(ev.comparable(F.lit(0.1), F.lit(0.049)), ev.comparable(F.lit(0.1), F.lit(0.05)), ev.comparable(F.lit(-0.1), F.lit(0.5)), ev.positive_effect(F.lit(0.1), F.lit(0.0))).first() == (True, False, True, False)
    assert [ev.one_or_all(x) for x in ([True, True], [True, False], [False, False], [True, True, False])] == ["full_support", "partial_support", "not_supported", "not_supported"]
    assert ev.all_or_none([True, False]) == "not_supported"


def test_garch_filter(spark):
    rows = [(1, date(2020, 12, 30), 0.01), (1, date(2020, 12, 31), 0.02), (1, date(2021, 1, 1), 0.03)]
    par = {2020: (1.0, 0.1, 0.8, 10.0), 2021: (4.0, 0.2, 0.5, 7.0)}
    df = spark.createDataFrame([(*r, *par[r[1].year]) for r in rows] + [(2, date(2020, 1, i), x, *par[2020]) for i, x in ((1, 0.01), (2, None), (3, 0.01))] + [(3, date(2020, 1, 1), 0.1, None, None, None, None)], "permno long, d date, r double, omega double, alpha double, beta double, initial double")
    out = {(r["permno"], r["d"]): r for r in garch.garch_filter(df, horizon=2).collect()}
    assert [out[1, r[1]]["sigma2"] for r in rows] == pytest.approx([10.0, 9.1, 7.0])
    one, lr, p = 1 + 0.1 * 4 + 0.8 * 9.1, 1 / 0.1, 0.9
    assert out[1, rows[1][1]]["forecast"] == pytest.approx(math.sqrt(lr + (one - lr) * ((1 - p**2) / (1 - p)) / 2) / 100)
    assert out[2, date(2020, 1, 2)]["forecast"] is None and out[2, date(2020, 1, 3)]["sigma2"] == pytest.approx(lr)
    assert out[3, date(2020, 1, 1)]["sigma2"] is None


def test_garch_fit_recovers_parameters(spark):
    rng, h, x = np.random.default_rng(7), 1.0, []
    for _ in range(4000):
        x.append(math.sqrt(h) * rng.normal())
        h = 0.05 + 0.1 * x[-1] ** 2 + 0.85 * h
    omega, alpha, beta, ahead = garch.fit_garch(np.array(x))
    assert abs(alpha - 0.1) < 0.04 and abs(beta - 0.85) < 0.06 and ahead > 0
    best = garch.likelihoods(np.square(x), np.array([omega, 0.05]), np.array([alpha, 0.1]), np.array([beta, 0.85]), 1.0)[0]
    assert best[0] <= best[1] + 0.5
    assert garch.fit_garch(np.zeros(300)) is None
    rows = [(1, date(2000, 1, 1) + timedelta(days=i + (66 if i >= 300 else 0)), float(v) / 100) for i, v in enumerate(x[:310])]
    fits = garch.garch_parameters(spark.createDataFrame(rows, "permno long, d date, r double")).orderBy("year").collect()
    assert [(r["year"], r["status"]) for r in fits] == [(2000, "insufficient_history"), (2001, "ok")]


def test_allocation_and_sample(spark):
    strata = spark.createDataFrame([(2015, "low", 40), (2015, "high", 20), (2016, "low", 30), (2016, "high", 10), (2017, "low", 1)], "year int, regime string, size long")
    got = {(r["year"], r["regime"]): r["allocation"] for r in ranking.largest_remainder(strata, size="size", n=25, order=["year", "regime"]).collect()}
    assert sum(got.values()) == 25 and got[2017, "low"] == 1 and got[2015, "low"] == 9
    assert {r["allocation"] for r in ranking.largest_remainder(strata, size="size", n=3, order=["year"]).collect()} == {None}
    rows = spark.createDataFrame([(i, day(i), 2015, "low") for i in range(40)], "permno long, dlycaldt date, year int, regime string")
    alloc = ranking.largest_remainder(strata, size="size", n=25, order=["year", "regime"])
    take = lambda df: ranking.stratified_sample(df, alloc, strata=["year", "regime"], key=["permno", "dlycaldt"], seed=1)
    a, b = take(rows), take(rows.orderBy(F.rand(3)).repartition(5))
    digest = lambda df: ranking.sample_digest(df, key=["permno", "dlycaldt"], line=["permno", "dlycaldt", "regime"]).first()
    assert digest(a) == digest(b) and a.count() == 9


def test_a_locked_sample_is_required_again(spark, monkeypatch):
    import __spark_entry__ as entry
    from tidepanel.plans import reference_panel

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    query = entry.queries()["sample_key_hash"]
    assert query(spark, folder).first() == query(spark, folder).first()
    monkeypatch.setattr(reference_panel, "stratified_sample_md5", lambda spark, d: reference_panel.forecasts(spark, d).limit(3))
    with pytest.raises(guards.GuardError):
        query(spark, folder)


def test_rankings(spark):
    df = spark.createDataFrame([(float(i), -2.0 * i, 0.0) for i in range(1, 5)], "a double, b double, z double")
    out = ranking.ranked_importance(df, ["a", "b", "z"]).orderBy("rank").collect()
    assert [r["feature"] for r in out] == ["b", "a", "z"] and sum(r["share"] for r in out) == pytest.approx(1)
    groups = {r["grp"]: r for r in ranking.ranked_groups(df, {"x": ["a", "b"], "y": ["z"]}).collect()}
    assert groups["x"]["mean_absolute"] == pytest.approx(7.5) and groups["x"]["mean_absolute_net"] == pytest.approx(2.5)
    r = ranking.ranked_importance(df, ["a", "b", "z"])
    assert ranking.rank_correlation(r, r, "feature").first()[0] == pytest.approx(1)
    assert ranking.top_overlap(r, r.withColumn("rank", 4 - c("rank")), "feature", 2).first() == ("a", pytest.approx(1 / 3))


def test_agreement_of_two_halves(spark):
    rows = [("m", h, f, r) for h, fs in (("e", "abcd"), ("l", "bacd")) for r, f in enumerate(fs, 1)] + [("k", "e", "a", 1)]
    ranks = spark.createDataFrame(rows, "model string, half string, feature string, rank int")
    got = {r["model"]: r for r in ranking.rank_agreement(ranks, ["model"], "feature", c("half") == "e", 3).collect()}
    assert got["m"]["correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 1, 3, 4])[0, 1]) and got["m"]["labels"] == 4
    assert (got["m"]["shared"], got["m"]["jaccard"]) == ("a,b,c", 1.0) and (got["k"]["correlation"], got["k"]["jaccard"]) == (None, 0.0)
    ab = [ranks.filter((c("model") == "m") & (c("half") == h)) for h in "el"]
    assert ranking.top_overlap(*ab, "feature", 1).first() == ("", 0.0)


def test_tree_models(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    rows = [(i, *map(float, v), float(np.exp(v[0] - 0.5 * v[1]))) for i, v in enumerate(x)]
    names = ["a", "b", "e", "g"]
    df = forests.assembled(spark.createDataFrame(rows, "id long, a double, b double, e double, g double, y double"), names, "y")
    for kind, tol in (("forest", 1e-8), ("boosting", 1e-5)):
        model = forests.fit(forests.Candidate("m", kind, 3, 5, "all"), df, trees=5)
        out = forests.shap_values(model, df, names, ["id"], tol).toPandas()
        total = out["base_value"] + out[[f"shap__{n}" for n in names]].sum(axis=1)
        np.testing.assert_allclose(total, out["prediction"], atol=tol)
        assert out["shap__a"].abs().mean() > out["shap__g"].abs().mean()
    assert forests.fit(forests.Candidate("m", "forest", 3, 5), df.limit(0), trees=5) is None
    assert forests.predicted(None, df).count() == 0 and forests.shap_values(None, df, names, ["id"]).count() == 0
    assert len(forests.forest_grid()) == 12 and len(forests.boosting_grid()) == 8


def test_shap_equals_the_definition():
    from itertools import combinations

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = x[:, 0] + x[:, 0] * x[:, 1] + (x[:, 2] > 0.3) + rng.normal(size=400)
    edges = treekernel.bin_edges(x)
    tree = treekernel.with_edges(treekernel.forest_tree(treekernel.binned(x, edges), y, rng, depth=5, leaf=5, tried=2), edges)

    def value(node, row, present):
        f = int(tree.feature[node])
        if f < 0:
            return float(tree.value[node])
        kids = (int(tree.left[node]), int(tree.right[node]))
        if f in present:
            return value(kids[0] if row[f] <= tree.threshold[node] else kids[1], row, present)
        return sum(float(tree.cover[k] / tree.cover[node]) * value(k, row, present) for k in kids)

    got, base = treekernel.shapley([tree], x[:6])
    assert base == pytest.approx(value(0, x[0], set()))
    for row, phi in zip(x[:6], got, strict=True):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value(0, row, {*s, i}) - value(0, row, set(s))) for k in range(4) for s in combinations(rest, k))
            assert phi[i] == pytest.approx(want, abs=1e-9)


def test_first_split_equals_brute_force():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y, w = rng.normal(size=200) + (x[:, 1] > 4), rng.integers(1, 4, 200).astype(float)
    edges = treekernel.bin_edges(x)
    tree = treekernel.grow(treekernel.binned(x, edges), y, w, rng, depth=1, least_rows=20, l2=0.5)
    score = lambda m: (y * w)[m].sum() ** 2 / (w[m].sum() + 0.5)
    gains = {(f, t): score(x[:, f] <= t) + score(x[:, f] > t) for f in range(3) for t in range(12) if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= 20}
    assert (int(tree.feature[0]), edges[int(tree.feature[0])][int(tree.threshold[0])]) == max(gains, key=gains.get)
    assert treekernel.leaves_of(tree, treekernel.binned(x, edges)).tolist() == [1 if v <= edges[tree.feature[0]][int(tree.threshold[0])] else 2 for v in x[:, tree.feature[0]]]
    assert tree.value[1] == pytest.approx((y * w)[x[:, tree.feature[0]] <= edges[tree.feature[0]][int(tree.threshold[0])]].sum() / (tree.cover[1] + 0.5))


def test_slices_of_a_level_don_t_change_the_tree(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 5))
    codes, y = treekernel.binned(x, treekernel.bin_edges(x)), x[:, 0] + rng.normal(size=500)
    whole = treekernel.grow(codes, y, None, rng, depth=None, least_rows=3)
    monkeypatch.setattr(treekernel, "CELLS", 5 * 256 * 2)
    sliced = treekernel.grow(codes, y, None, rng, depth=None, least_rows=3)
    at = lambda t: t.value[treekernel.leaves_of(t, codes)]
    np.testing.assert_allclose(at(whole), at(sliced))
    assert np.bincount(treekernel.leaves_of(whole, codes))[whole.feature < 0].min() >= 3


def test_kernel_shortcuts_give_the_same_trees(monkeypatch):
    """Sums as differences, weights packed with counts, and leaves found by blocks, beside the plain ways."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(3000, 5))
    codes, y = treekernel.binned(x, treekernel.bin_edges(x)), x[:, 0] - x[:, 1] * x[:, 2] + rng.normal(size=3000)
    for depth in (1, 4, 7):
        plain, short = (treekernel.grow(codes, y, None, rng, depth=depth, least_weight=5, l2=1.0, differences=d) for d in (False, True))
        assert all((getattr(plain, n) == getattr(short, n)).all() for n in ("feature", "threshold", "left", "right", "cover"))
        np.testing.assert_allclose(plain.value, short.value, atol=1e-12)
    tree = treekernel.forest_tree(codes, y, np.random.default_rng(1), depth=None, leaf=3, tried=2)
    with monkeypatch.context() as m:
        m.setattr(treekernel, "PACKED", 1)  # no weights are packed
        apart = treekernel.forest_tree(codes, y, np.random.default_rng(1), depth=None, leaf=3, tried=2)
    assert all((getattr(tree, n) == getattr(apart, n)).all() for n in ("feature", "threshold", "left", "right", "value", "cover"))
    monkeypatch.setattr(treekernel, "BLOCK", 700)
    leaves = treekernel.leaves_of(tree, codes)
    for row in range(0, 3000, 37):
        node = 0
        while tree.feature[node] >= 0:
            node = (tree.left if codes[row, tree.feature[node]] <= tree.threshold[node] else tree.right)[node]
        assert node == leaves[row]
    assert len(treekernel.leaves_of(tree, codes[:0])) == 0


def test_boosting_stops_at_the_least_loss():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    y = x[:, 0] + rng.normal(size=300)
    codes = treekernel.binned(x, treekernel.bin_edges(x))
    _, trees, losses = treekernel.boost(codes[:200], y[:200], (codes[200:], y[200:]), rng, rounds=1500, patience=75, rate=0.3, depth=3, least_weight=5, rows=0.8, columns=0.8, l2=1.0)
    assert len(trees) == len(losses) == int(np.argmin(losses)) + 76 < 1500


def test_fit_doesn_t_depend_on_layout_and_both_ways_learn(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(400, 3))
    df = forests.assembled(spark.createDataFrame([(i, *map(float, v), float(np.exp(v[0] - v[1]))) for i, v in enumerate(x)], "id long, a double, b double, e double, y double"), ["a", "b", "e"], "y")
    for kind in ("forest", "boosting"):
        c1 = forests.Candidate("m", kind, 4, 5, "all", 0.3)
        one, two = forests.fit(c1, df, trees=30), forests.fit(c1, df.repartition(5, "e"), trees=30)
        assert forests._digest(one.trees) == forests._digest(two.trees)
        forests.save_model(spark, one, str(tmp_path / kind), ["a", "b", "e"], note="x")
        again, _ = forests.load_model(spark, str(tmp_path / kind), ["a", "b", "e"], note="x")
        assert (again.predict(x) == one.predict(x)).all()
        for bad in (dict(features=["b", "a", "e"]), dict(features=["a", "b", "e"], note="y")):
            with pytest.raises(guards.GuardError):
                forests.load_model(spark, str(tmp_path / kind), **bad)
        with pytest.raises(FileExistsError):
            forests.save_model(spark, one, str(tmp_path / kind), ["a", "b", "e"], force=False)
        with monkeypatch.context() as m:
            m.setattr(forests, "LOCAL_BYTES", 0)
            far = forests.fit(c1, df, trees=30)
            assert 1 <= forests.best_rounds(far, df) <= 30
            plain = forests.tuned([c1], df, df, actual="y", trees=5)
        near = forests.tuned([c1], df, df, actual="y", trees=5)
        assert [set(r["metrics"]) for r in plain] == [set(r["metrics"]) for r in near]
        for model in (one, far):
            assert np.corrcoef(model.predict(x), x[:, 0] - x[:, 1])[0, 1] > 0.9
            shap = forests.shap_values(model, df, ["a", "b", "e"], ["id"]).toPandas()
            np.testing.assert_allclose(shap["base_value"] + shap[["shap__a", "shap__b", "shap__e"]].sum(axis=1), shap["prediction"], atol=1e-8)
    with pytest.raises(guards.GuardError):
        forests.fit(c1, forests.assembled(df.withColumn("a", F.lit(1e300)), ["a", "b", "e"], "y"), trees=2)


def test_models_pass_the_driver_in_parts(spark, monkeypatch, tmp_path):
    """A forest larger than a part is written by the tasks, and read, sent, saved and explained part by part."""
    names, x = ["a", "b", "e"], np.random.default_rng(12).normal(size=(300, 3))
    df = forests.assembled(spark.createDataFrame([(i, *map(float, v), float(np.exp(v[0] - v[1]))) for i, v in enumerate(x)], "id long, a double, b double, e double, y double"), names, "y")
    candidate, path = forests.Candidate("m", "forest", None, 2, "all"), str(tmp_path / "m")
    whole = forests.fit(candidate, df, trees=40)
    ids = lambda rows: rows.drop("_features", "_label").toPandas().sort_values("id").reset_index(drop=True)
    expected, shap = ids(forests.predicted(whole, df)), ids(forests.shap_values(whole, df, names, ["id"]))
    bound, sent, make = 20_000, [], spark.createDataFrame
    monkeypatch.setattr(forests, "PART_BYTES", bound, raising=False)
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda t, *a, **k: sent.append(t.nbytes) or make(t, *a, **k))
        forests.save_model(spark, whole, path, names)
    assert len(sent) > 5 and max(sent) < 2 * bound  # a table is one task's message
    stored, (again, _) = forests.fit(candidate, df, trees=40), forests.load_model(spark, path, names)
    forests.save_model(spark, stored, f"{path}2", names)
    forests.discard(stored)
    for model in (again, forests.load_model(spark, f"{path}2", names)[0]):
        assert isinstance(model.trees, forests.StoredTrees) and len(model.trees) == 40 and len(list(model.parts())) > 5
        assert forests._digest(model.trees) == forests._digest(whole.trees)
        assert expected.equals(ids(forests.predicted(model, df)))
        np.testing.assert_allclose(ids(forests.shap_values(model, df, names, ["id"])), shap, atol=1e-12)


def test_selection_and_resume(spark, tmp_path):
    assert forests.selected([{"name": "b", "metrics": {"qlike": 0.1}}, {"name": "a", "metrics": {"qlike": 0.1}}, {"name": "c", "metrics": {"qlike": None}}])["name"] == "a"
    x = np.random.default_rng(1).normal(size=60)
    df = forests.assembled(spark.createDataFrame([(float(v), float(np.exp(v))) for v in x], "a double, y double"), ["a"], "y")
    grid = [forests.Candidate("g1", "boosting", 2, 2, "all", 0.3)]
    state = str(tmp_path / "state.json")
    first = forests.tune(grid, df, df, actual="y", trees=4, state=state, identity="x")
    assert first == forests.tune(grid, df.limit(0), df, actual="y", trees=4, state=state, identity="x")
    with pytest.raises(ValueError):
        forests.tune(grid, df, df, actual="y", trees=4, state=state, identity="other")


def test_complementary_error(spark):
    x = [0.0, 1e-9, 0.3, 1.0, 2.99, 3.0, 3.01, 5.0, 12.0, float("inf")]
    got = [r[1] for r in sorted(spark.createDataFrame([(v,) for v in x], "x double").select("x", ev.complementary_error(c("x"))).collect())]
    assert got == pytest.approx([math.erfc(v) for v in x], rel=1e-10, abs=1e-15)


def test_garch_likelihood_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    x2, bounds = rng.normal(0, 1.5, 60) ** 2, np.array([13, 13, 40, 60])
    omega, alpha, beta = rng.uniform(0.01, 0.2, (4, 3)), rng.uniform(0, 0.2, (4, 3)), rng.uniform(0.5, 0.79, (4, 3))
    loss, ahead = garch.history_likelihoods(x2, bounds, omega, alpha, beta, np.array([1.0, 2.0, 1.0, 0.5]))
    for i, start in enumerate((1.0, 2.0, 1.0, 0.5)):
        for j in range(3):
            h, total = start, 0.0
            for v in x2[: bounds[i]]:
                total += (math.log(max(h, 1e-12)) + v / max(h, 1e-12)) / 2
                h = omega[i, j] + alpha[i, j] * v + beta[i, j] * max(h, 1e-12)
            assert (loss[i, j], ahead[i, j]) == pytest.approx((total, h))


def test_fits_of_histories_are_those_of_each(spark):
    x = np.random.default_rng(5).normal(0, 1.2, 700)
    each = [garch.fit_garch(x[:b]) for b in (300, 500, 700)]
    together = garch.fit_histories(x, np.array([300, 500, 700]))
    assert [t == pytest.approx(e) for t, e in zip(together, each)] == [True] * 3
    assert garch.fit_histories(np.zeros(300), np.array([0, 300])) == [None, None]
    rows = [(1, date(2010, 1, 1) + timedelta(days=i), None if i % 9 == 0 else float(v) / 100) for i, v in enumerate(x)] + [(2, date(2011, 5, 5), 0.1), (2, date(2013, 5, 5), None)]
    rows += [(3, date(2010, 1, 1) + timedelta(days=i), 0.0) for i in range(400)]
    got = {(r["permno"], r["year"]): r for r in garch.garch_parameters(spark.createDataFrame(rows, "permno long, d date, r double")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {(1, 2010): "insufficient_history", (1, 2011): "ok", (2, 2011): "insufficient_history", (2, 2013): "insufficient_history", (3, 2010): "insufficient_history", (3, 2011): "fit_failed_or_degenerate"}
    past = np.array([v for i, v in enumerate(x[:365]) if i % 9])
    assert tuple(got[1, 2011])[3:] == pytest.approx(garch.fit_garch(past)) and got[3, 2011]["omega"] is None


def test_hashes_count_repeats_and_writes_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    hashed = lambda x: sinks.content_hash(x).first()["hash"]
    other = spark.createDataFrame([(3, "b")], "k long, s string")
    twice = lambda x: df.unionByName(x).unionByName(x)
    assert hashed(twice(other)) != hashed(twice(other.withColumn("k", F.lit(4).cast("long")))) and hashed(df) == hashed(df.repartition(3))
    path = str(tmp_path / "t")
    sinks.write_parquet(df, path)
    with pytest.raises(Exception, match="DIVIDE|boom"):
        sinks.write_parquet(df.withColumn("k", F.raise_error(F.lit("boom"))), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.write_parquet(other, path)
    assert spark.read.parquet(path).count() == 1


def test_remote_scan_pushes_columns_and_conditions(spark):
    """Against the database that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:remote;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = [(i, i % 4, "NORM" if i % 3 else "OTHER", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "permno int, part int, mbrflg string, price double").write.format("jdbc").options(url=url, dbtable="prices", driver=driver, createTableColumnTypes="mbrflg varchar(8)").mode("overwrite").save()
    whole = scans.jdbc_scan(spark, url, "select * from prices", properties={"driver": driver}, partition=("permno", 0, 40, 4))
    good = scans.renamed_scan(whole, c("mbrflg") == "NORM", {"permno": "security"})
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "mbrflg" in plan.lower() and "EqualTo(" in plan and "price" not in plan.split("ReadSchema")[-1].lower()
    assert whole.rdd.getNumPartitions() == 4 and {r["security"] for r in good.collect()} == {i for i in range(40) if i % 3}
    assert scans.jdbc_scan(spark, url, 'select "permno" from prices where "mbrflg" = \'OTHER\'', properties={"driver": driver}).count() == 14


def test_small_tables_only_are_collected(spark):
    from tidepanel.session import collected, sized

    assert len(collected(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        collected(spark.range(6), 5)
    wide = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 1000))
    hint = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(sized(wide)) and not hint(sized(wide, most=9_000)) and not hint(sized(wide, limit=9))


def test_bounded_scans_and_guards(spark):
    df = spark.createDataFrame([(3, "x"), (1, "2"), (2, "2010-01-05")], "k long, s string")
    assert [r["k"] for r in scans.profiled_rows(df, ["k"], 2).collect()] == [1, 2]
    assert scans.renamed_scan(df, c("k") > 1, {"s": "t"}).columns == ["t"]
    assert [(r[0], r[1] and str(r[1])) for r in df.orderBy("k").select(number(c("s")), to_day(c("s"))).collect()] == [(2.0, None), (None, "2010-01-05"), (None, None)]
    flags = spark.createDataFrame([(True, 1, False), (None, 0, False), (False, 2, False)], "f boolean, n int, g boolean")
    assert guards.violations(flags, {"bad": guards.inconsistent_flag("f", c("n") > 0)}).first()[0] == 1
    assert guards.empty_masks(flags, ["f", "g"]).first()[0] == 1 and guards.empty_masks(flags.limit(0), ["f", "g"]).first()[0] == 2
    guards.require_digest("a", "a", "x")
    with pytest.raises(guards.GuardError):
        guards.require_digest("a", "b", "x")


def test_planted_keys_and_targets_are_found(spark):
    key = ["permno", "d"]
    a = spark.createDataFrame([(i % 3, day(i), 0.1 * (i + 1)) for i in range(30)], "permno long, d date, t double")
    b = a.filter("d <> date '2010-01-05'").withColumn("t", F.when(c("d") == F.lit(day(7)), c("t") * 1.001).when(c("d") == F.lit(day(8)), c("t") * (1 + 1e-7)).otherwise(c("t")))
    b = b.unionByName(spark.createDataFrame([(9, day(3), 1.0), (9, day(4), 1.0)], b.schema))
    assert panels.compare_populations(a, b, key, "t").first() == (29, 1, 2, 1)
    with pytest.raises(guards.GuardError):
        panels.require_same_population(a, b, key, "t", "x")
    sides = {f"m{k}": a.filter(c("d") != F.lit(day(k))).select(*key, F.lit(1.0).alias(f"m{k}")) for k in range(4)}
    out = panels.common_panel(a.withColumn("m", c("t")), sides, key, ["m", *sides])
    assert out.count() == 26 and {r["d"] for r in out.collect()} == {day(i) for i in range(4, 30)}
    with pytest.raises(guards.GuardError):
        panels.common_panel(a.withColumn("m", c("t")), {"m0": sides["m0"].unionByName(sides["m0"].limit(1))}, key, ["m"])


def test_common_panel_holds_five_models_over_all_dates(spark, tmp_path):
    import __spark_entry__ as entry
    from tidepanel.plans.base import MODELS

    values = ["target_forward_21d", *MODELS.values()]
    rows = [(i, i % 3, day(400 * i), day(400 * i + 30), True, "low", *[0.1 + 0.01 * i] * 6) for i in range(12)]
    names = ["panel_id", "permno", "dlycaldt", "target_end_date", "has_earnings_forward_21d", "vix_regime", *values]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/final_panel.parquet")
    out = entry.queries()["forecast_common_panel_all"](spark, str(tmp_path))
    assert set(values) <= set(out.columns)
    assert {(r["permno"], r["dlycaldt"]) for r in out.collect()} == {(r[1], r[2]) for r in rows}
    assert max(r[2] for r in rows) >= date(2020, 1, 1)


def toy_models(spark, monkeypatch):
    """The model queries over a toy matrix of 80 rows, with the whole grids, trees and rounds."""
    from tidepanel.plans import models

    x = np.random.default_rng(3).normal(size=(80, len(models.FEATURES)))
    rows = [(i, day(i), *map(float, v), float(np.exp(v[0])), i < 40, 40 <= i < 60, i < 60, i >= 60) for i, v in enumerate(x)]
    names = ["permno", "d", *models.FEATURES, "target_forward", "tuning_train", "validation", "final_refit", "test"]
    df = forests.assembled(spark.createDataFrame(rows, names).coalesce(1), models.FEATURES, "target_forward").cache()
    monkeypatch.setattr(models, "_assembled", lambda spark, d: df)
    return models, df


def test_model_queries_score_the_whole_grids(spark, monkeypatch):
    models, df = toy_models(spark, monkeypatch)
    out = models.model_selection(spark, "").collect()
    assert {r["candidate"] for r in out} == {x.name for x in (*forests.forest_grid(), *forests.boosting_grid())}
    assert sum(r["selected"] for r in out) == 2 and all(r["qlike"] > 0 for r in out)
    grids = {k: models._winner(df, k)[0] for k in models.KINDS}
    assert {r["rounds"] for r in grids["forest"]} == {400} and max(r["rounds"] for r in grids["boosting"]) > 75
    best = {k: forests.selected(r) for k, r in grids.items()}
    assert {r["candidate"] for r in out if r["selected"]} == {b["name"] for b in best.values()}
    fits, fit = [], forests.fit
    with monkeypatch.context() as m:
        m.setattr(models.files, "exists", lambda *a: False)  # as if no model were kept
        m.setattr(models.forests, "tuned", lambda grid, *a, **k: grids[grid[0].kind])
        m.setattr(models.forests, "fit", lambda candidate, train, *, trees, seed=42: fits.append((candidate.name, trees, train.count())) or fit(candidate, train, trees=trees, seed=seed))
        assert models.rf_forecast(spark, "").count() == models.gbt_forecast(spark, "").count() == 20
    assert fits == [(b["name"], b["rounds"], 60) for b in best.values()]
    assert [tuple(r)[1:] for r in models.frozen_forecasts(spark, "").collect()] == [(20, 0), (20, 0)]


def test_shap_explains_the_forecasting_models(spark, monkeypatch):
    models, _ = toy_models(spark, monkeypatch)
    forecasts = {"forest": models.rf_forecast(spark, ""), "boosting": models.gbt_forecast(spark, "")}
    out = models.tree_shap(spark, "")
    for kind, df in forecasts.items():
        want = {r["permno"]: math.log(r["forecast"]) for r in df.collect()}
        assert {r["permno"]: r["prediction"] for r in out.filter(c("model") == kind).collect()} == pytest.approx(want)
    groups, top = models.shap_groups(spark, ""), models.shap_top_features(spark, "")
    assert {r["model"] for r in groups.collect()} == {r["model"] for r in top.collect()} == {"forest", "boosting"}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.7)], "k long, f double")
    path = str(tmp_path / "t")
    assert sinks.write_forecasts(df, "f", path, ["k"]).count() == 2
    with pytest.raises(guards.GuardError):
        sinks.write_forecasts(df.withColumn("f", F.lit(-1.0)), "f", path, ["k"])
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_parquet(df, path, force=False)
    assert sinks.content_hash(df).first() == sinks.content_hash(df.orderBy(F.desc("k"))).first()
    doc = str(tmp_path / "a" / "r.json")
    sinks.write_json({"schema_version": 1, "x": [1, {"y": 2}]}, doc)
    with pytest.raises(FileExistsError):
        sinks.write_json({}, doc, force=False)
    with pytest.raises(ValueError):
        sinks.write_json({"x": float("nan")}, doc)
    assert sinks.read_locked(doc, sinks.file_sha256(doc), 1)["x"][0] == 1
    with pytest.raises(guards.GuardError):
        sinks.read_locked(doc, "0", 1)
    assert scans.json_document(spark, doc).select("schema_version").first()[0] == json.load(open(doc))["schema_version"]
    empty, there = scans.optional_table(spark, str(tmp_path / "nope"), df.schema)
    assert empty.count() == 0 and not there and scans.optional_table(spark, path, df.schema)[1]
    assert sinks.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, n int"), right=["n"]).splitlines()[1:] == ["| --- | ---: |", "| a\\|b | 1 |"]
    assert scans.literal_grid(spark, [1, 2], ["2020-01-01", "2020-01-02"]).count() == 4
    df.createOrReplaceTempView("bound")
    assert scans.parameter_scan(spark, "select * from bound where k = :k", k=2).count() == 1
    assert scans.key_scan(df, df.filter("k = 1"), "k").count() == 1
