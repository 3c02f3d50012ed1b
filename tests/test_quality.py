"""The data-quality operators on small tables with every kind of dirt."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.asof import asof_attributes, attribute_intervals, versions
from tidepanel.operators.references import orphan_counts, orphan_references, padded_key
from tidepanel.operators.rolling import idle_days, trailing_totals
from tidepanel.operators.spikes import LEVEL_RULE, RETURN_RULE, flag_spikes, kalman_levels, noise_variances, vanishing_variance

c = F.col
PRICES = "row_id long, permno long, dlycaldt date, dlyret double, dlydelflg string, source string, day int, value double, size double"


def day(i):
    return date(2010, 1, 1) + timedelta(days=i)


def flagged(spark, rows, marks=None):
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3.0) for r in rows], PRICES)
    m = spark.createDataFrame(marks, "source long, day date") if marks else None
    out = flag_spikes(df, RETURN_RULE, source=c("permno"), time=c("dlycaldt"), value=c("dlyret"), order=c("row_id"), impossible=c("dlyret") < -1, exempt=c("dlydelflg") == "Y", marks=m)
    return {r["order"]: (r["impossible"], r["spike"], r["stuck"]) for r in out.collect()}


def normal(n=120, seed=1):
    r = np.random.default_rng(seed).normal(0, 0.01, n).round(6)
    return [(i, 1, day(i), float(x), "N") for i, x in enumerate(r)]


def test_spikes_by_kind(spark):
    rows = normal()
    rows[0] = (0, 1, day(0), 0.9, "N")  # spike at the very start
    rows[50] = (50, 1, day(50), 0.8, "N")
    rows[60] = (60, 1, day(60), -0.8, "Y")  # delisting: excused
    rows[70] = (70, 1, day(70), 0.7, "N")  # announcement: excused
    rows[80] = (80, 1, day(80), 0.7, "N")  # the row after an announcement on a day without rows
    rows[90] = (90, 1, day(90), -66.0, "N")
    for i in (100, 101, 102):
        rows[i] = (i, 1, day(i), 0.012345, "N")
    rows[119] = (119, 1, day(119), float("inf"), "N")
    del rows[79]
    got = flagged(spark, rows, [(1, day(70)), (1, day(79)), (None, day(3)), (1, None)])
    assert got == {0: (False, True, False), 50: (False, True, False), 90: (True, True, False), 101: (False, False, True), 102: (False, False, True), 119: (False, True, False)}


def test_no_case_for_nulls_repeats_and_idle_days(spark):
    rows = normal(60)
    rows[10], rows[11] = (10, 1, day(10), None, "N"), (11, 1, day(11), float("nan"), None)
    rows += [(100, 1, day(20), rows[20][3], "N")]  # second delivery of a date
    rows += [(200, None, day(1), 5.0, "N"), (201, 1, None, 5.0, "N"), (202, 7, day(1), 5.0, "N")]
    idle = np.random.default_rng(2).random(200) < 0.4
    rows += [(1000 + i, 2, day(i), 0.0 if idle[i] else 0.001 * (i % 7 + 1) * (-1) ** i, "N") for i in range(200)]
    assert flagged(spark, rows) == {}


def test_restated_day_is_judged_by_row(spark):
    rows = normal(60) + [(100, 1, day(30), 0.9, "N")]
    assert flagged(spark, rows) == {100: (False, True, False)}


def test_market_day_is_excused(spark):
    rows = []
    for p in range(1, 6):
        own = normal(80, seed=p)
        own[40] = (40, p, day(40), 0.5 * (-1) ** p, "N")
        rows += [(1000 * p + i, p, d, x, f) for i, _, d, x, f in own]
    assert flagged(spark, rows) == {}
    assert flagged(spark, rows[:80])[1040] == (False, True, False)


def test_level_rule(spark):
    v = [20 + 0.1 * (i % 9) for i in range(40)]
    v[10], v[15], v[20], v[30] = 55.0, -20.5, 3.0, v[29]
    df = spark.createDataFrame([(i, day(i), x) for i, x in enumerate(v)], "id long, d date, v double")
    out = flag_spikes(df, LEVEL_RULE, source=F.lit(0), time=c("d"), value=c("v"), order=c("id"), impossible=c("v") <= 0, exempt=F.lit(False))
    assert {(r["order"], r["spike"], r["stuck"]) for r in out.collect()} == {(10, True, False), (15, True, False), (20, True, False), (30, False, True)}


@pytest.mark.parametrize("n", [12, 25, 29])
def test_spikes_in_a_long_run(spark, n):
    run = range(80, 80 + n)
    rows = [(i, 1, day(i), 0.001 * (1 + 0.001 * i) * (100 if i in run else 1), "N") for i in range(200)]
    assert {k for k, x in flagged(spark, rows).items() if x[1]} == set(run)


def test_spikes_of_an_empty_table(spark):
    assert flagged(spark, []) == {}


def test_filter_withholds_spikes():
    y = np.zeros(100)
    y[50] = 10
    levels, _, held = kalman_levels(y, RETURN_RULE)
    assert held[50] and abs(levels[51]) < 1e-9
    y[60:] = 3.0  # a lasting change of level is followed
    assert kalman_levels(y, RETURN_RULE)[0][-1] > 2.5


def test_the_filter_decides(spark):
    """Without the filter's flags no spike and no stuck reading comes out, and each threshold moves what does."""
    from dataclasses import replace

    rows = normal()
    for i, x in ((50, 0.8), (60, -0.3), (70, 0.01)):
        rows[i] = (i, 1, day(i), x, "N")
    rows[71] = (71, 1, day(71), 0.01, "N")
    df = spark.createDataFrame([(*r, "x", 1, 2.0, 3.0) for r in rows], PRICES)

    def found(**changed):
        rule = replace(RETURN_RULE, **changed)
        out = flag_spikes(df, rule, source=c("permno"), time=c("dlycaldt"), value=c("dlyret"), order=c("row_id"), impossible=F.lit(False), exempt=F.lit(False))
        return {r["order"] for r in out.collect()}

    assert found() == {50, 60, 71}
    assert found(threshold=float("inf")) == {71} and found(vanishing=float("nan")) == {50, 60}
    assert found(threshold=4.0) == {50, 71}


def test_variances_of_a_source_are_estimated():
    rng = np.random.default_rng(4)
    for observation, state in ((0.5, 0.01), (0.02, 0.05)):
        level = np.cumsum(rng.normal(0, state**0.5, 4000))
        y = level + rng.normal(0, observation**0.5, 4000)
        y[::400] = 40.0  # spikes don't widen what is normal
        got = noise_variances(y, RETURN_RULE)
        assert got == pytest.approx((observation, state), rel=0.5)
    assert noise_variances(np.array([1.0, np.nan]), RETURN_RULE) == (RETURN_RULE.observation_variance, RETURN_RULE.state_variance)


def test_vanishing_variance_has_a_memory():
    x = np.array([np.nan, 1.0, 0.0, 0.0, 1e-6, 0.5, 0.001, 0.0])
    assert vanishing_variance(x, 1.0, RETURN_RULE).tolist() == [False, False, True, True, True, False, False, True]
    assert vanishing_variance(np.full(3, 0.001), 1e-6, RETURN_RULE).tolist() == [False] * 3


ROLL = "entity long, day date, value double, row_id long, n int, sum double"


def test_trailing_totals_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for e in (1, 2, 3):
        for i in sorted(rng.choice(90, 25, replace=False).tolist()):
            rows.append((e, day(i), round(float(rng.normal()), 3), len(rows), 1, 1.0))
    rows += [(1, day(200), None, 900, 1, 1.0), (2, day(5), float("nan"), 901, 1, 1.0), (3, day(7), float("inf"), 902, 1, 1.0), (None, day(1), 1.0, 903, 1, 1.0), (1, None, 1.0, 904, 1, 1.0)]
    rows += [(1, rows[0][1], 9.0, 905, 1, 1.0), (1, rows[0][1], None, 906, 1, 1.0)]
    df = spark.createDataFrame(rows, ROLL)
    out = trailing_totals(df, entity=c("entity"), day=c("day"), value=c("value"), order=c("row_id")).collect()
    value, span = {}, {}
    for e, d, v, k, *_ in sorted(rows, key=lambda r: r[3]):
        if e is None or d is None:
            continue
        span[e] = (min(d, span.get(e, (d, d))[0]), max(d, span.get(e, (d, d))[1]))
        if v is not None and np.isfinite(v):
            value[e, d] = v
    assert len(out) == sum((b - a).days + 1 for a, b in span.values())
    for r in out:
        for k in (7, 30):
            have = [value[r["entity"], r["day"] - timedelta(days=i)] for i in range(k) if (r["entity"], r["day"] - timedelta(days=i)) in value]
            assert r[f"values_{k}"] == len(have)
            assert (r[f"total_{k}"] is None) == (not have)
            if have:
                assert r[f"total_{k}"] == pytest.approx(sum(have)) and r[f"average_{k}"] == pytest.approx(sum(have) / len(have))
    idle = idle_days(df, entity=c("entity"), day=c("day"), value=c("value"), order=c("row_id"))
    assert idle.count() == sum(r["values_7"] == 0 for r in out)
    assert trailing_totals(df.limit(0), entity=c("entity"), day=c("day"), value=c("value"), order=c("row_id")).count() == 0


def t(i):
    return datetime(2020, 1, 1) + timedelta(days=i)


def test_orphans(spark):
    child = spark.createDataFrame([(1, "7", t(5), "k"), (2, " 0000007 ", t(5), "k"), (3, "000008", t(5), "k"), (4, None, t(5), "k"), (5, "  ", t(5), "k"), (6, "9", t(1), "k"), (7, "9", t(9), "k"), (8, "9", None, "k"), (9, "10", t(9), "k"), (9, "10", t(9), "k"), (11, "ab", t(9), "k")], "id long, key string, loaded timestamp_ntz, reference string")
    parent = spark.createDataFrame([("000007", t(1), None), ("7", t(2), None), ("000009", t(5), None), ("000010", t(1), t(2)), (None, t(1), None)], "key string, loaded timestamp_ntz, gone timestamp_ntz")
    args = dict(record=c("id"), reference=padded_key(c("key")), at=c("loaded"), key=padded_key(c("key")), known=c("loaded"), valid=c("gone").isNull(), period=F.date_format("loaded", "yyyy-MM"))
    out = orphan_references(child, parent, **args)
    assert sorted((r["record"], r["reason"]) for r in out.collect()) == [(2, "missing"), (3, "missing"), (6, "late"), (9, "missing"), (9, "missing"), (11, "missing")]
    counts = {(r["period"], r["reason"]): (r["orphans"], r["distinct_references"]) for r in orphan_counts(out, "t").collect()}
    assert counts == {("2020-01", "missing"): (5, 4), ("2020-01", "late"): (1, 1)}
    assert orphan_references(child, parent.limit(0), **args).count() == 9
    assert orphan_references(child.limit(0), parent, **args).count() == 0


def test_versions_resolve_ties():
    got = versions([(1, 10, (1, "a", ""), "x"), (3, 5, (2, "a", ""), "y"), (3, 5, (2, "b", ""), "z"), (20, 30, (1, "", ""), "w")])
    assert got == [(1, "x"), (3, "z"), (6, "x"), (11, None), (20, "w"), (31, None)]
    assert versions([]) == []


@pytest.mark.parametrize("bucket_rows", [150_000, 40])
def test_asof_against_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(5)
    spans = []
    for _ in range(60):
        a = int(rng.integers(0, 80))
        spans.append((int(rng.integers(1, 5)), day(a), None if rng.random() < 0.2 else day(a + int(rng.integers(0, 40))), day(a + int(rng.integers(-5, 10))), f"g{rng.integers(0, 6)}"))
    spans += [spans[0], (None, day(1), None, day(1), "q"), (1, None, None, day(1), "q"), (1, day(1), None, None, "q")]
    events = [(i, 1 if i % 3 else int(rng.integers(1, 7)), day(int(rng.integers(0, 130))), "own", 1) for i in range(300)]
    events += [(900, None, day(3), "own", 1), (901, 1, None, "own", 1), (902, 2, day(9), None, 1), (902, 2, day(9), None, 1)]
    e = spark.createDataFrame(events, "id long, entity long, d date, record string, bucket int")
    s = spark.createDataFrame(spans, "entity long, a date, b date, k date, v string")
    iv = attribute_intervals(s, entity=c("entity"), start=c("a"), end=c("b"), known=c("k"), value=c("v"), tie=F.date_format("a", "yyyyMMdd"), name="then")
    out = asof_attributes(e, iv, ["then"], record=c("id"), entity=c("entity"), time=c("d"), carry={"own": c("record")}, bucket_rows=bucket_rows).collect()
    assert len(out) == len(events)
    at = {x[0]: x for x in events}
    for r in out:
        _, entity, d, own, _ = at[r["record"]]
        live = [x for x in spans if None not in (x[0], x[1], x[3], d) and x[0] == entity and x[1] <= d and (x[2] is None or d <= x[2]) and x[3] <= d]
        want = max(live, key=lambda x: (x[3], x[1], x[4]))[4] if live else None
        assert (r["then"], r["own"]) == (want, own)
    assert {r["then"] for r in asof_attributes(e, iv.limit(0), ["then"], record=c("id"), entity=c("entity"), time=c("d")).collect()} == {None}
    assert asof_attributes(e.limit(0), iv, ["then"], record=c("id"), entity=c("entity"), time=c("d")).count() == 0


def test_attributes_of_rows_without_key(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, None, "000001", day(9), None), (2, 7, "000001", None, None), (3, None, None, day(9), None), (4, 7, "000001", day(9), True), (5, None, None, day(9), True)]
    tables = {
        "daily_prices": (rows, "row_id long, permno long, gvkey string, dlycaldt date, in_sp500_membership boolean"),
        "link_history": ([("000001", 7, day(0), None, "LC", "P", day(0))], "gvkey string, permno long, linkdt date, linkenddt date, linktype string, linkprim string, recorded_on date"),
        "universe": ([(7, day(0), None, day(0))], "permno long, universe_start date, universe_end date, recorded_on date"),
    }
    for name, (data, kinds) in tables.items():
        spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["row_id"]: (r["gvkey_then"], r["member_then"]) for r in entry.queries()["p5_attributes"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (None, False), 4: ("000001", True), 5: (None, False)}
    assert {r["row_id"] for r in entry.queries()["p5_found"](spark, str(tmp_path)).collect()} == {1, 2, 5}
