"""Queries of the panel operators over the domain tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidepanel.functions.columns import all_finite, close_to, day, estimate_text, number, qlike, regime, rounded
from tidepanel.operators import evaluation as ev
from tidepanel.operators import garch, guards, panels, ranking, temporal, timeseries
from tidepanel.operators.references import padded_key
from tidepanel.plans.base import FORECASTS, INDEX, MODELS, PANEL, VOL, c, forecasts, index_levels, panel, volatility
from tidepanel.session import kept_folder, staged
from tidepanel.sources import files
from tidepanel.sources.scans import key_scan, literal_grid, optional_table, parameter_scan, profiled_rows, renamed_scan
from tidepanel.sources.sinks import content_hash, read_locked, write_json
from tidepanel.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRAIN_END, VALIDATION_END, HISTORY_END = "2015-01-01", "2019-01-01", "2015-01-01"


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _r(*names: str) -> list:
    return [rounded(c(n)).alias(n) for n in names]


def _s(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 {n}" for n in names)


# ---- windows and targets

def _frame(agg: str, x: str, k: int, name: str) -> str:
    w = f"(partition by permno order by d rows between {k - 1} preceding and current row)"
    return f"round(case when count({x}) over {w} = {k} then {agg}({x}) over {w} end, 8) + 0.0 {name}"


@query(f"with {PANEL} select permno, d, {_frame('stddev_samp', 'r', 21, 'vol')} from panel")
def rolling_std_21(spark: SparkSession, d: str) -> DataFrame:
    """trailing standard deviation over 21 complete rows."""
    return volatility(spark, d).select("permno", "d", *_r("vol"))


@query(f"with {PANEL} select permno, d, " + ", ".join(_frame("stddev_samp", "r", k, f"return_std_{k}d") for k in timeseries.STD_ROWS) + " from panel")
def rolling_std_multi(spark: SparkSession, d: str) -> DataFrame:
    """trailing standard deviations over five frames of one window."""
    out = timeseries.return_features(panel(spark, d), mean_abs=(), compound=())
    return out.select("permno", "d", *_r(*[f"return_std_{k}d" for k in timeseries.STD_ROWS]))


@query(f"with {PANEL}, a as (select permno, d, abs(r) x from panel) select permno, d, " + ", ".join(_frame("avg", "x", k, f"mean_abs_return_{k}d") for k in timeseries.ABS_ROWS) + " from a")
def mean_abs_return(spark: SparkSession, d: str) -> DataFrame:
    """trailing mean size of returns."""
    out = timeseries.return_features(panel(spark, d), std=(), compound=())
    return out.select("permno", "d", *_r(*[f"mean_abs_return_{k}d" for k in timeseries.ABS_ROWS]))


def _compounded(k: int) -> str:
    return f"""round(case when count(*) over w{k} = {k} and bool_or(coalesce(r = -1, false)) over w{k} then -1
  when count(x) over w{k} = {k} then exp(sum(x) over w{k}) - 1 end, 8) + 0.0 compounded_return_{k}d"""


def _named_frame(k: int) -> str:
    return f"w{k} as (partition by permno order by d rows between {k - 1} preceding and current row)"


@query(
    f"with {PANEL}, a as (select permno, d, r, case when r > -1 then ln(1 + r) end x from panel) select permno, d, "
    + ", ".join(_compounded(k) for k in timeseries.COMPOUND_ROWS)
    + " from a window "
    + ", ".join(_named_frame(k) for k in timeseries.COMPOUND_ROWS)
)
def compounded_return(spark: SparkSession, d: str) -> DataFrame:
    """trailing compounded returns."""
    out = timeseries.return_features(panel(spark, d), std=(), mean_abs=())
    return out.select("permno", "d", *_r(*[f"compounded_return_{k}d" for k in timeseries.COMPOUND_ROWS]))


@query(f"""with recursive {PANEL}, k as (select permno, d, r, row_number() over (partition by permno order by d) i, count(r) over (partition by permno order by d rows between unbounded preceding and current row) nv from panel),
 s as (select permno, i, r * r v, cast(1.0 as double) old from k where i = 1
  union all select k.permno, k.i, case when k.r is null then s.v when s.v is null then k.r * k.r else (s.old * 0.94 * s.v + 0.06 * k.r * k.r) / (s.old * 0.94 + 0.06) end,
   case when k.r is null and s.v is not null then s.old * 0.94 else 1.0 end from s join k on k.permno = s.permno and k.i = s.i + 1)
 select permno, d, round(case when i >= 21 then sqrt(v) end, 8) + 0.0 ewma_by_rows, round(case when nv >= 21 then sqrt(v) end, 8) + 0.0 ewma_by_returns from k join s using (permno, i)""")
def ewma_vol(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially weighted volatility with gaps, and both burn-ins."""
    return timeseries.ewma_volatility(panel(spark, d)).select("permno", "d", *_r("ewma_by_rows", "ewma_by_returns"))


@query(f"with {VOL} select permno, d, round(target, 8) + 0.0 target_forward, target_end target_end_date from targets")
def forward_target(spark: SparkSession, d: str) -> DataFrame:
    """the volatility and the day 21 rows ahead."""
    return timeseries.forward_target(volatility(spark, d), value="vol").select("permno", "d", *_r("target_forward"), "target_end_date")


@query(f"""with {VOL} select year(d)::int as year, count(*) n, round(sqrt(avg((target - vol) ** 2)), 8) rmse, round(avg(abs(target - vol)), 8) mae,
 round(avg(target ** 2 / vol ** 2 - ln(target ** 2 / vol ** 2) - 1), 8) qlike from targets where target > 0 and vol > 0 group by 1""")
def persistence_metrics_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Losses of the persistence forecast per year."""
    rows = timeseries.forward_target(volatility(spark, d), value="vol").filter("target_forward > 0 and vol > 0")
    e = c("target_forward") - c("vol")
    return rows.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"), F.round(F.avg(F.abs(e)), 8).alias("mae"), F.round(F.avg(qlike(c("target_forward"), c("vol"))), 8).alias("qlike"))


@query(f"with {PANEL}, {INDEX}, cal as (select distinct panel.d, v, case when v > 0 then ln(v) end l from panel join idx using (d)) select d, v, " + ", ".join(f"round(l - lag(l, {k}) over (order by d), 8) + 0.0 log_change_{k}d" for k in timeseries.LAGS) + " from cal")
def index_log_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lagged log changes on the trading calendar of the panel."""
    calendar = temporal.on_calendar(panel(spark, d), index_levels(spark, d), day="d", series_day="d", value="v").filter("v is not null")
    return timeseries.log_changes(calendar, day="d", value="v").select("d", "v", *_r(*[f"log_change_{k}d" for k in timeseries.LAGS]))


@query(f"""with {VOL}, x as (select *, case when d < date '{TRAIN_END}' then 'train' when d < date '{VALIDATION_END}' then 'validation' else 'test' end split from targets)
 select permno, d, target_end target_end_date, split, coalesce((split = 'train' and target_end >= date '{TRAIN_END}') or (split = 'validation' and target_end >= date '{VALIDATION_END}'), false) crosses_split_boundary from x""")
def split_and_purge(spark: SparkSession, d: str) -> DataFrame:
    """Split labels and the flag of targets over a boundary."""
    rows = timeseries.forward_target(volatility(spark, d), value="vol")
    return timeseries.split_labels(rows, train_end=TRAIN_END, validation_end=VALIDATION_END).select("permno", "d", "target_end_date", "split", "crosses_split_boundary")


@query(f"""with {VOL}, x as (select *, coalesce(vol > 0 and target > 0, false) fin, case when d < date '{TRAIN_END}' then 'train' when d < date '{VALIDATION_END}' then 'validation' else 'test' end split from targets),
 y as (select *, coalesce((split = 'train' and target_end >= date '{TRAIN_END}') or (split = 'validation' and target_end >= date '{VALIDATION_END}'), false) crosses from x)
 select permno, d, fin and not crosses eligible, fin and not crosses and split = 'train' tuning_train, fin and not crosses and split = 'validation' validation,
  fin and d < date '{VALIDATION_END}' and coalesce(target_end < date '{VALIDATION_END}', false) final_refit, fin and not crosses and split = 'test' test from y""")
def eligibility_masks(spark: SparkSession, d: str) -> DataFrame:
    """Eligibility and the four sample masks."""
    rows = timeseries.split_labels(timeseries.forward_target(volatility(spark, d), value="vol"), train_end=TRAIN_END, validation_end=VALIDATION_END)
    good = all_finite(["vol", "target_forward"]) & F.coalesce((c("vol") > 0) & (c("target_forward") > 0), F.lit(False))
    return timeseries.sample_masks(rows, finite=good, validation_end=VALIDATION_END).select("permno", "d", "eligible", "tuning_train", "validation", "final_refit", "test")


# ---- scans, temporal joins, universe

@query("select gvkey, permno, linkdt, linkenddt from link_history where linktype in ('LC', 'LU') and linkprim in ('P', 'C')")
def good_links(spark: SparkSession, d: str) -> DataFrame:
    """The link table of good kinds."""
    return table(spark, d, "link_history").filter(c("linktype").isin("LC", "LU") & c("linkprim").isin("P", "C")).select("gvkey", "permno", "linkdt", "linkenddt")


@query("select row_id, permno, dlycaldt from daily_prices where dlycaldt between date '2005-01-01' and date '2024-12-31' and permno in (select permno from universe)")
def key_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """A date range of the securities of the universe, by semi-join."""
    rows = table(spark, d, "daily_prices").select("row_id", "permno", "dlycaldt")
    return key_scan(rows, table(spark, d, "universe"), "permno", day="dlycaldt", first="2005-01-01", last="2024-12-31")


@query("select gvkey company, permno security, linkdt sdate, linkenddt edate from link_history where linkprim in ('P', 'C') and permno is not null")
def aliased_links(spark: SparkSession, d: str) -> DataFrame:
    """A4: the links of two grades under other names."""
    return renamed_scan(table(spark, d, "link_history"), c("linkprim").isin("P", "C") & c("permno").isNotNull(), {"gvkey": "company", "permno": "security", "linkdt": "sdate", "linkenddt": "edate"})


@query("""select ticker, permno, anndats announced, pends period_end from earnings_dates
 where ticker is not null and pends is not null and anndats between date '2005-01-01' and date '2024-12-31' and pends <= anndats""")
def event_scan(spark: SparkSession, d: str) -> DataFrame:
    """A5: events that meet several conditions at once, all pushed to the scan."""
    good = c("ticker").isNotNull() & c("pends").isNotNull() & c("anndats").between(F.lit("2005-01-01").cast("date"), F.lit("2024-12-31").cast("date")) & (c("pends") <= c("anndats"))
    return renamed_scan(table(spark, d, "earnings_dates"), good, {"ticker": "ticker", "permno": "permno", "anndats": "announced", "pends": "period_end"})


@query("select permno, universe_start, universe_end from universe where universe_start <= date '2015-06-30' and universe_end >= date '2010-01-01' and permno % 2 = 0")
def bound_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A query with bound parameters and an order."""
    sql = "select permno, universe_start, universe_end from {spells} where universe_start <= :last and universe_end >= :first and permno % :parity = 0 order by permno, universe_start"
    return parameter_scan(spark, sql, {"spells": table(spark, d, "universe")}, first=date(2010, 1, 1), last=date(2015, 6, 30), parity=2)


@query("select 'company' source, true there, count(*) as rows from company union all select 'delisting_notices', false, 0")
def optional_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source that is there and one that isn't, both reported."""
    parts = []
    for name in ("company", "delisting_notices"):
        rows, there = optional_table(spark, f"{d}/{name}.parquet", StructType([StructField("gvkey", StringType())]))
        parts.append(rows.agg(F.lit(name).alias("source"), F.lit(there).alias("there"), F.count("*").alias("rows")))
    return parts[0].unionByName(parts[1])


@query("select event_id, json_extract_string(props, '$.k') k, to_json({'event_id': event_id, 'event_type': event_type}) as record from events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field read out of JSON text, and rows written as JSON."""
    rows = table(spark, d, "events").select("event_id", "event_type", "props")
    return rows.select("event_id", F.from_json("props", "k string")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("record"))


@query("select dlyprcflg, count(*) n, count(dlyret) returns, count(dlyprc) prices from (select * from daily_prices order by row_id limit 500000) group by 1")
def profiling_scan(spark: SparkSession, d: str) -> DataFrame:
    """A profile of the first 500,000 deliveries; the bound is the feature, ``null_profile`` reads all."""
    rows = profiled_rows(table(spark, d, "daily_prices").select("row_id", "dlyprcflg", "dlyret", "dlyprc"), ["row_id"], 500_000)
    return rows.groupBy("dlyprcflg").agg(F.count("*").alias("n"), F.count("dlyret").alias("returns"), F.count("dlyprc").alias("prices"))


@query("""with w as (select target_end_date e, dlycaldt d, permno p from final_panel where permno is not null)
 select x.p permno, x.x d, coalesce(n, 0) n from (select permno p, day::date x from (values (10001), (10002), (10003)) k(permno), (values ('2015-01-02'), ('2020-03-16')) v(day)) x
 left join (select p, d, count(*) n from w group by 1, 2) y on y.p = x.p and y.d = x.x""")
def literal_origins(spark: SparkSession, d: str) -> DataFrame:
    """A grid of literal keys and days, with the panel's rows for each."""
    grid = literal_grid(spark, [10001, 10002, 10003], ["2015-01-02", "2020-03-16"])
    rows = table(spark, d, "final_panel").groupBy("permno", c("dlycaldt").alias("d")).agg(F.count("*").alias("n"))
    return grid.join(rows, ["permno", "d"], "left").select("permno", "d", F.coalesce("n", F.lit(0)).alias("n"))


@query("""select panel_id, try_cast(trim(gvkey) as double) company_number, try_cast(vix_regime as double) regime_number, try_cast(cast(target_end_date as varchar) as date) end_day, try_cast(trim(gvkey) || 'x' as date) no_day from final_panel""")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    """Text read as numbers and dates, null where it is neither."""
    rows = table(spark, d, "final_panel")
    return rows.select("panel_id", number(F.trim("gvkey")).alias("company_number"), number(c("vix_regime")).alias("regime_number"), day(c("target_end_date").cast("string")).alias("end_day"), day(F.concat(F.trim("gvkey"), F.lit("x"))).alias("no_day"))


@query("select distinct permno, ticker from earnings_dates where ticker is not null")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    """The distinct names of securities."""
    return table(spark, d, "earnings_dates").select("permno", "ticker").dropna(subset=["ticker"]).distinct()


#: The sample period.
_FIRST, _LAST = "2005-01-01", "2024-12-31"


@query(f"""select permno, greatest(universe_start, date '{_FIRST}') universe_start, least(coalesce(universe_end, date '9999-12-31'), date '{_LAST}') universe_end from universe where universe_start <= date '{_LAST}' and coalesce(universe_end, date '9999-12-31') >= date '{_FIRST}'""")
def universe_clip(spark: SparkSession, d: str) -> DataFrame:
    """Spells that meet a sample period, cut to it."""
    return temporal.clipped(table(spark, d, "universe"), "universe_start", "universe_end", _FIRST, _LAST).select("permno", "universe_start", "universe_end")


@query("select row_id, exists (select 1 from universe u where u.permno = p.permno and p.dlycaldt between u.universe_start and u.universe_end) member from daily_prices p")
def membership_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a row's day lies in any spell of its security."""
    rows = table(spark, d, "daily_prices").select("row_id", "permno", "dlycaldt")
    return temporal.membership_flag(rows, table(spark, d, "universe"), flag="member").select("row_id", "member")


_GOOD = "g as (select gvkey, permno, linkdt, coalesce(linkenddt, date '9999-12-31') linkenddt from link_history where linktype in ('LC', 'LU') and linkprim in ('P', 'C'))"


@query(f"with {_GOOD} select p.row_id, p.dlycaldt, g.gvkey linked from daily_prices p join g on g.permno = p.permno and p.dlycaldt between g.linkdt and g.linkenddt")
def validity_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with every link valid on their day; unmatched rows go."""
    links = good_links(spark, d).withColumnRenamed("gvkey", "linked")
    rows = table(spark, d, "daily_prices").select("row_id", "permno", "dlycaldt")
    return temporal.validity_join(rows, links, on="permno", day="dlycaldt", take=["linked"]).select("row_id", "dlycaldt", "linked")


@query(f"""with {_GOOD}, f as (select panel_id, dlycaldt, case
 when regexp_full_match(trim(gvkey), '[0-9]{{1,6}}') then lpad(trim(gvkey), 6, '0') else trim(gvkey) end k from final_panel)
 select f.panel_id, g.permno linked from f join g on g.gvkey = f.k and f.dlycaldt between g.linkdt and g.linkenddt""")
def validity_join_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The same by another key, which returns the security."""
    links = good_links(spark, d).withColumnRenamed("permno", "linked")
    rows = table(spark, d, "final_panel").select("panel_id", "dlycaldt", padded_key(c("gvkey")).alias("gvkey"))
    return temporal.validity_join(rows, links, on="gvkey", day="dlycaldt", take=["linked"]).select("panel_id", "linked")


@query(f"""with {_GOOD} select distinct permno, dlycaldt from daily_prices p where permno is not null and dlycaldt is not null and not exists (select 1
 from g where g.permno = p.permno and p.dlycaldt between g.linkdt and g.linkenddt)""")
def unmatched_links(spark: SparkSession, d: str) -> DataFrame:
    """Keys without any valid link."""
    rows = table(spark, d, "daily_prices").select("permno", "dlycaldt").dropna()
    links = good_links(spark, d)
    return temporal.unmatched_keys(rows, temporal.validity_join(rows.distinct(), links, on="permno", day="dlycaldt", take=[]), ["permno", "dlycaldt"])


@query(f"""with {_GOOD} select permno, dlycaldt, count(*) n from daily_prices p join g using (permno) where dlycaldt between linkdt and linkenddt
 group by 1, 2 having count(*) > 1""")
def overlapping_links(spark: SparkSession, d: str) -> DataFrame:
    """Keys that more than one row or link matches."""
    joined = temporal.validity_join(table(spark, d, "daily_prices").select("permno", "dlycaldt"), good_links(spark, d), on="permno", day="dlycaldt", take=[])
    return guards.duplicate_keys(joined, ["permno", "dlycaldt"])


@query("""select panel_id, case when target_end_date is not null then (select count(distinct anndats) from earnings_dates e where e.permno = f.permno and anndats > dlycaldt and anndats <= target_end_date) end event_count,
 case when target_end_date is not null then exists (select 1 from earnings_dates e where e.permno = f.permno and anndats > dlycaldt and anndats <= target_end_date) end has_event from final_panel f""")
def forward_event_count(spark: SparkSession, d: str) -> DataFrame:
    """Distinct announcement days after the origin up to the end of the target."""
    windows = table(spark, d, "final_panel").select("panel_id", "permno", "dlycaldt", "target_end_date")
    return temporal.forward_event_count(windows, table(spark, d, "earnings_dates")).select("panel_id", "event_count", "has_event")


@query("select count(*) as rows, count(*) - count(distinct (permno, anndats)) removed from earnings_dates where permno is not null and anndats is not null")
def event_dedup_count(spark: SparkSession, d: str) -> DataFrame:
    """Announcements, and how many repeat a day."""
    rows = table(spark, d, "earnings_dates").dropna(subset=["permno", "anndats"])
    return rows.agg(F.count("*").alias("rows"), (F.count("*") - F.countDistinct("permno", "anndats")).alias("removed"))


@query("""select permno, ticker, pends, anndats from (select *, row_number() over (partition by ticker, pends order by anndats, permno) k
 from (select distinct * from earnings_dates where ticker is not null and pends is not null)) where k = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """Exact repeats go, then the earliest announcement per name and period stays."""
    rows = table(spark, d, "earnings_dates").dropna(subset=["ticker", "pends"]).distinct()
    return panels.first_per_key(rows, ["ticker", "pends"], ["anndats", "permno"])


@query(f"with {PANEL}, {INDEX} select distinct d missing_day from panel where d not in (select d from idx)")
def calendar_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Trading days of the panel without an index level."""
    return temporal.calendar_gaps(panel(spark, d), index_levels(spark, d), day="d", series_day="d")


@query("""select count(*) filter (where date is null) missing_date, count(*) filter (where e) placeholder, count(*) filter (where p and not e) partial, count(*) filter (where vixo <= 0 or vixh <= 0 or vixl <= 0 or vix_close <= 0) not_positive,
 count(*) filter (where not p and (vixh < vixl or vix_close not between vixl and vixh)) close_outside, count(*) filter (where not p and vixo not between vixl and vixh) open_outside, count(*) filter (where date not between date '2005-01-01' and date '2024-12-31') outside_sample
 from (select *, a and b and c and d e, a or b or c or d p from (select *, vixo is null or isnan(vixo) a, vixh is null or isnan(vixh) b, vixl is null or isnan(vixl) c, vix_close is null or isnan(vix_close) d from vix))""")
def index_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rule violations of the raw index, in one aggregate."""
    return guards.violations(table(spark, d, "vix"), guards.index_rules(date(2005, 1, 1), date(2024, 12, 31)))


@query("""select (select count(*) from universe where universe_start is null or universe_end is null or universe_start > universe_end) bad_spells, (select count(*) from daily_prices where dlyret < -1) bad_returns,
 (select coalesce(sum(n - 1), 0)::bigint from (select count(*) n from daily_prices group by permno, dlycaldt)) repeated_keys, (select count(distinct permno) from daily_prices where permno not in (select permno from universe where permno is not null)) unknown_entities,
 (select count(*) from final_panel where dlycaldt is null or target_end_date <= dlycaldt) bad_windows, (select count(*) from final_panel where vix_regime is null or vix_regime not in ('low', 'middle', 'high')) bad_regimes,
 (select count(*) from final_panel where target_forward_21d < 0 and not isnan(target_forward_21d)) bad_targets,
 (select count(*) from final_panel where not coalesce(forecast_naive > 0 and forecast_ewma > 0 and forecast_garch > 0 and forecast_random_forest > 0 and forecast_xgboost > 0
   and isfinite(forecast_naive) and isfinite(forecast_ewma) and isfinite(forecast_garch) and isfinite(forecast_random_forest) and isfinite(forecast_xgboost), false)) bad_forecasts,
 (select count(*) from final_panel where coalesce(has_earnings_forward_21d, false) <> coalesce(earnings_count_forward_21d > 0, false)) bad_event_flags, 
 (select count(*) from (select row_id, exists (select 1 from universe u where u.permno = p.permno and p.dlycaldt between u.universe_start and u.universe_end) m from daily_prices p))
  - (select count(*) from daily_prices) rows_added_by_membership""")
def guard_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the guards, one column each."""
    prices, spells, final = (table(spark, d, t) for t in ("daily_prices", "universe", "final_panel"))
    flagged = temporal.membership_flag(prices.select("permno", "dlycaldt"), spells).select(F.lit(1).alias("n"))
    rows_added = flagged.unionByName(prices.select(F.lit(-1).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_added_by_membership"))
    parts = [
        guards.violations(spells, {"bad_spells": guards.bad_interval("universe_start", "universe_end")}),
        guards.violations(prices, {"bad_returns": guards.bad_return("dlyret")}),
        guards.duplicate_keys(prices, ["permno", "dlycaldt"]).agg(F.coalesce(F.sum(c("n") - 1), F.lit(0)).alias("repeated_keys")),
        prices.select("permno").dropna().distinct().join(spells.select("permno"), "permno", "left_anti").agg(F.count("*").alias("unknown_entities")),
        guards.violations(final, {
            "bad_windows": guards.bad_window("dlycaldt", "target_end_date"),
            "bad_regimes": guards.outside_domain("vix_regime", ["low", "middle", "high"]),
            "bad_targets": guards.bad_target("target_forward_21d"),
            "bad_forecasts": guards.bad_forecasts(list(MODELS.values())),
            "bad_event_flags": guards.inconsistent_flag("has_earnings_forward_21d", c("earnings_count_forward_21d") > 0),
        }),
        rows_added,
    ]
    return guards.side_by_side(parts)


# ---- regimes, populations

@query(f"""with {INDEX} select round(quantile_cont(v, 1/3), 8) low, round(quantile_cont(v, 2/3), 8) high from idx
 where d >= date '2005-01-01' and d < date '{HISTORY_END}'""")
def regime_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Exact thirds of the index over the history."""
    return _thresholds(spark, d).select(*_r("low", "high"))


def _thresholds(spark: SparkSession, d: str) -> DataFrame:
    history = index_levels(spark, d).filter(c("d").between(F.lit("2005-01-01").cast("date"), F.date_sub(F.lit(HISTORY_END).cast("date"), 1)))
    return history.agg(F.percentile("v", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).select(c("q")[0].alias("low"), c("q")[1].alias("high"))


@query(f"""with {INDEX}, t as (select quantile_cont(v, 1/3) low, quantile_cont(v, 2/3) high from idx
 where d >= date '2005-01-01' and d < date '{HISTORY_END}') select d, v, case when v <= low then 'low' when v >= high then 'high'
 when v is not null then 'middle' end regime from idx, t""")
def regime_assign(spark: SparkSession, d: str) -> DataFrame:
    """The regime of each date from the locked thresholds."""
    low, high = _thresholds(spark, d).first()
    guards.require_ordered(low, high, "regimes")
    return index_levels(spark, d).select("d", "v", regime(c("v"), F.lit(low), F.lit(high)).alias("regime"))


def _own_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """(permno, dlycaldt, target, persistence) computed from the prices, where both are there."""
    rows = timeseries.forward_target(volatility(spark, d), value="vol")
    return rows.select("permno", c("d").alias("dlycaldt"), c("target_forward").alias("target"), c("vol").alias("persistence")).dropna(subset=["target", "persistence"])


_OWN = f"{VOL}, {FORECASTS}, own as (select permno, d dlycaldt, target, vol persistence from targets where target is not null and vol is not null)"


@query(f"""with {_OWN} select permno, dlycaldt, round(target, 8) target, round(persistence, 8) persistence, forecast_garch, forecast_xgboost from own
 join fc using (permno, dlycaldt)""")
def forecast_common_panel(spark: SparkSession, d: str) -> DataFrame:
    """Persistence computed from the prices joined one to one with two forecasts of the final panel, complete cases."""
    rows = forecasts(spark, d)
    sides = {m: rows.select("permno", "dlycaldt", m) for m in ("forecast_garch", "forecast_xgboost")}
    out = panels.common_panel(_own_forecasts(spark, d), sides, ["permno", "dlycaldt"], ["persistence", *sides])
    return out.select("permno", "dlycaldt", *_r("target", "persistence"), *sides)


@query(f"with {FORECASTS} select permno, dlycaldt, target_forward_21d, {', '.join(MODELS.values())} from fc")
def forecast_common_panel_all(spark: SparkSession, d: str) -> DataFrame:
    """Complete cases of all five models over all dates, the classical, forest and boosting sides joined one to one."""
    rows = forecasts(spark, d)
    side = lambda *names: rows.select("permno", "dlycaldt", *names)
    classical = side("target_forward_21d", "forecast_naive", "forecast_ewma", "forecast_garch")
    return panels.common_panel(classical, {"forest": side("forecast_random_forest"), "boosting": side("forecast_xgboost")}, ["permno", "dlycaldt"], list(MODELS.values()))


@query(f"""with {_OWN}, j as (select own.target a, fc.target_forward_21d b, own.permno is not null l, fc.permno is not null r from own full join fc on own.permno = fc.permno and own.dlycaldt = fc.dlycaldt)
 select count(*) filter (where l and r) "both", count(*) filter (where not r) left_only, count(*) filter (where not l) right_only, count(*) filter (where l and r and not abs(a - b) <= 1e-8 + 1e-5 * abs(b)) different from j""")
def key_mismatch_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Targets computed from the prices beside those of the final panel: keys of one side only, and values that differ."""
    own = _own_forecasts(spark, d).withColumnRenamed("target", "target_forward_21d")
    return panels.compare_populations(own, forecasts(spark, d), ["permno", "dlycaldt"], "target_forward_21d")


@query(f"with {FORECASTS}, {INDEX} select permno, dlycaldt, v from fc left join idx on d = dlycaldt")
def dimension_join(spark: SparkSession, d: str) -> DataFrame:
    """Many-to-one join to the index after a check of its key."""
    return panels.many_to_one(forecasts(spark, d).select("permno", "dlycaldt"), index_levels(spark, d).withColumnRenamed("d", "dlycaldt"), ["dlycaldt"])


@query(f"""with {_OWN} select permno, dlycaldt, abs(persistence - forecast_naive) <= 1e-10 + 1e-6 * abs(forecast_naive) close_enough from own
 join fc using (permno, dlycaldt)""")
def approximate_equality(spark: SparkSession, d: str) -> DataFrame:
    """The persistence forecast computed again beside the stored one, within the tolerances of a frozen forecast."""
    both = panels.one_to_one(_own_forecasts(spark, d), forecasts(spark, d), ["permno", "dlycaldt"])
    return both.select("permno", "dlycaldt", close_to(c("persistence"), c("forecast_naive"), 1e-6, 1e-10).alias("close_enough"))


# ---- evaluation

def _losses(spark: SparkSession, d: str) -> DataFrame:
    return ev.stacked_losses(forecasts(spark, d), MODELS, actual="target_forward_21d", keep=["permno", "dlycaldt", "regime", "has_earnings_forward_21d"])


_METRICS = "count(*) n, round(sqrt(avg(se)), 8) rmse, round(avg(ae), 8) mae, round(avg(ql), 8) qlike"


@query(f"""with {FORECASTS}, g as (select 'overall' grp, * from losses union all select 'vix_' || regime, * from losses union all select case when ev then 'earnings' else 'no_earnings' end, * from losses)
 select model, grp, {_METRICS}, count(distinct dlycaldt) dates, count(distinct permno) entities from g group by 1, 2""")
def losses_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of five models over overlapping groups, by grouping sets."""
    out = ev.group_metrics(_losses(spark, d), regime="regime", event="has_earnings_forward_21d", entity="permno", day="dlycaldt")
    return out.select("model", "grp", "n", *_r("rmse", "mae", "qlike"), "dates", "entities")


@query(f"""with {FORECASTS}, days as (select distinct dlycaldt d from fc), x as (select model, dlycaldt d, sum(ql) s, count(*) n from losses
 where regime = 'high' group by 1, 2), m as (select distinct model from losses) select m.model, days.d, round(s, 8) s, coalesce(n, 0) n,
 round(s / n, 8) mean from days cross join m left join x on x.d = days.d and x.model = m.model""")
def daily_loss_mean(spark: SparkSession, d: str) -> DataFrame:
    """Sums, counts and means per date under a mask, over all dates of the panel."""
    high = F.when(c("regime") == "high", c("qlike"))
    return _losses(spark, d).groupBy("model", c("dlycaldt").alias("d")).agg(F.round(F.sum(high), 8).alias("s"), F.count(high).alias("n"), F.round(F.avg(high), 8).alias("mean"))


@query(f"with {FORECASTS} select model, dlycaldt d, round(avg(ql) filter (where ev) - avg(ql) filter (where not ev), 8) + 0.0 gap from losses group by 1, 2")
def event_gap_daily(spark: SparkSession, d: str) -> DataFrame:
    """Loss with events minus loss without, within each date."""
    return _event_gaps(spark, d).select("model", "d", *_r("gap"))


def _event_gaps(spark: SparkSession, d: str) -> DataFrame:
    event = c("has_earnings_forward_21d")
    gap = F.avg(F.when(event, c("qlike"))) - F.avg(F.when(~event, c("qlike")))
    return _losses(spark, d).groupBy("model", c("dlycaldt").alias("d")).agg(gap.alias("gap"))


def _high_difference(spark: SparkSession, d: str) -> DataFrame:
    daily = _losses(spark, d).groupBy("dlycaldt").agg(F.min("regime").alias("regime"), *[F.avg(F.when(c("model") == m, c("qlike"))).alias(m) for m in MODELS])
    each = F.explode(F.array(*[F.struct(F.lit(f"{m}_vs_garch").alias("series"), (c("garch") - c(m)).alias("x"), c("garch").alias("g")) for m in ("random_forest", "xgboost")]))
    return daily.select("dlycaldt", "regime", each.alias("e")).select("dlycaldt", "regime", "e.series", "e.x", "e.g")


_HAC = f"""with {FORECASTS}, m as (select dlycaldt d, min(regime) regime, avg(ql) filter (where model = 'garch') g,
   avg(ql) filter (where model = 'random_forest') rf, avg(ql) filter (where model = 'xgboost') xg from losses group by 1),
 x as (select 'random_forest_vs_garch' series, d, g - rf x from m where regime = 'high'
  union all select 'xgboost_vs_garch', d, g - xg from m where regime = 'high'),
 y as (select *, row_number() over (partition by series order by d) i, count(*) over (partition by series) n, x - avg(x) over (partition by series) c from x),
 l as (select a.series, a.n, a.i - b.i k, sum(a.c * b.c) s from y a join y b on a.series = b.series and a.i - b.i between 0 and 20 group by 1, 2, 3),
 v as (select series, n, least(20, n - 1) lag,
   sum(case when k = 0 then s when k <= least(20, n - 1) then 2 * (1 - k / (least(20, n - 1) + 1.0)) * s else 0 end) / n lrv from l group by 1, 2),
 mu as (select series, avg(x) m from x group by 1),
 h as (select series, n dates, m mean_difference, sqrt(greatest(lrv, 0) / n) standard_error, m / sqrt(greatest(lrv, 0) / n) z_statistic, lag from v join mu using (series) where n > 1)"""


@query(f"{_HAC} select series, dates, round(mean_difference, 8) mean_difference, round(standard_error, 8) standard_error, round(z_statistic, 6) z_statistic, lag from h")
def newey_west_stats(spark: SparkSession, d: str) -> DataFrame:
    """H7, H8: HAC test of the daily difference on dates of the high regime."""
    tests = ev.newey_west(_high_difference(spark, d).filter("regime = 'high'"), series="series", day="dlycaldt", value="x")
    return tests.select("series", "dates", *_r("mean_difference", "standard_error"), F.round("z_statistic", 6).alias("z_statistic"), "lag")


# the error function as the sum of 2^n x^(2n+1) / (1 * 3 * ... * (2n+1)), times its density
@query(f"""{_HAC}, e as (select *, abs(z_statistic) / sqrt(2) q from h)
 select series, dates, round(mean_difference, 8) mean_difference, round(standard_error, 8) standard_error, round(z_statistic, 6) z_statistic, lag,
  round(greatest(case when q = 0 then 1 when q > 8 then 0 else 1 - 2 / sqrt(pi()) * exp(-q * q)
   * list_sum(list_transform(range(0, 300), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(q) + lgamma(n + 1) - lgamma(2 * n + 2)))) end, 0), 8) + 0.0 two_sided_p_value,
  round(mean_difference - 1.96 * standard_error, 8) + 0.0 ci_lower, round(mean_difference + 1.96 * standard_error, 8) + 0.0 ci_upper from e""")
def newey_west_test(spark: SparkSession, d: str) -> DataFrame:
    """H7: the same with p-values and intervals."""
    tests = ev.with_p_value(ev.newey_west(_high_difference(spark, d).filter("regime = 'high'"), series="series", day="dlycaldt", value="x"))
    return tests.select("series", "dates", *_r("mean_difference", "standard_error"), F.round("z_statistic", 6).alias("z_statistic"), "lag", *_r("two_sided_p_value", "ci_lower", "ci_upper"))


def _bootstrap(daily: DataFrame) -> DataFrame:
    return ev.bootstrap_replicates(daily, day="dlycaldt", series="series", numerator="num", denominator="den")


@query()
def block_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of pooled metrics by resampling blocks of dates, all groups and models in one pass."""
    metrics = {"rmse": "squared_error", "mae": "absolute_error", "qlike": "qlike"}
    # sums per date, model, regime and event first: the overlapping groups are made of these few rows
    cells = _losses(spark, d).groupBy("dlycaldt", "model", "regime", "has_earnings_forward_21d").agg(*[F.struct(F.sum(x).alias("num"), F.count(x).alias("den")).alias(n) for n, x in metrics.items()])
    groups = F.array(F.lit("overall"), F.concat(F.lit("vix_"), c("regime")), F.when(c("has_earnings_forward_21d"), "earnings").otherwise("no_earnings"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), c(f"{n}.num").alias("num"), c(f"{n}.den").alias("den")) for n in metrics])
    long = cells.select("dlycaldt", "model", F.explode(groups).alias("grp"), each.alias("m")).select("dlycaldt", "model", "grp", F.inline("m"))
    daily = long.groupBy("dlycaldt", F.concat_ws("/", "grp", "model", "name").alias("series")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    values = _bootstrap(daily).withColumn("value", F.when(c("series").endswith("/rmse"), F.sqrt("value")).otherwise(c("value")))
    part = F.split("series", "/")
    return ev.bootstrap_intervals(values).select(part[0].alias("grp"), part[1].alias("model"), part[2].alias("metric"), "estimate", "ci_lower", "ci_upper", "valid_replicates")


def _daily_effects(spark: SparkSession, d: str) -> DataFrame:
    """(dlycaldt, series, num, den): the daily terms of each hypothesis, whose ratio of sums is its estimate."""
    differ = _high_difference(spark, d)
    one = lambda df, h, x: df.select("dlycaldt", F.concat(F.lit(f"{h}/"), "series").alias("series"), c(x).alias("num"), F.when(c(x).isNotNull(), 1).alias("den"))
    h1 = one(differ.withColumn("x", F.when(c("regime") == "high", c("x"))), "H1", "x")
    low = differ.withColumns({"x": F.when(c("regime") == "low", c("x")), "g": F.when(c("regime") == "low", c("g"))})
    h2 = low.select("dlycaldt", F.concat(F.lit("H2/"), "series").alias("series"), c("x").alias("num"), c("g").alias("den"))
    h3 = one(_event_gaps(spark, d).select(c("d").alias("dlycaldt"), c("model").alias("series"), c("gap").alias("x")), "H3", "x")
    return h1.unionByName(h2).unionByName(h3)


@query(f"""with {FORECASTS}, m as (select dlycaldt d, min(regime) regime, avg(ql) filter (where model = 'garch') g,
   avg(ql) filter (where model = 'random_forest') rf, avg(ql) filter (where model = 'xgboost') xg from losses group by 1),
 x as (select regime, g, 'random_forest_vs_garch' comparison, g - rf x from m union all select regime, g, 'xgboost_vs_garch', g - xg from m),
 gaps as (select model, dlycaldt, avg(ql) filter (where ev) - avg(ql) filter (where not ev) x from losses group by 1, 2)
 select hypothesis, comparison, round(estimate, 8) + 0.0 estimate, n from (
  select 'H1' hypothesis, comparison, avg(x) estimate, count(x) n from x where regime = 'high' group by 2
  union all select 'H2', comparison, sum(x) / sum(g), count(x) from x where regime = 'low' group by 2
  union all select 'H3', model, avg(x), count(x) from gaps group by 2)""")
def hypothesis_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The estimates of the three hypotheses and the dates behind each."""
    part = F.split("series", "/")
    sums = _daily_effects(spark, d).groupBy("series").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("estimate"), F.count("num").alias("n"))
    return sums.select(part[0].alias("hypothesis"), part[1].alias("comparison"), *_r("estimate"), "n")


@query()
def hypothesis_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Estimates, intervals and decisions of the three hypotheses."""
    part = F.split("series", "/")
    rows = ev.bootstrap_intervals(_bootstrap(_daily_effects(spark, d))).withColumns({"hypothesis": part[0], "comparison": part[1]})
    holds = F.when(c("hypothesis") == "H2", ev.comparable(c("estimate"), c("ci_upper"))).otherwise(ev.positive_effect(c("estimate"), c("ci_lower")))
    tested = rows.withColumn("holds", holds)
    group = Window.partitionBy("hypothesis")
    n, k = F.count_if(c("holds")).over(group), F.count("*").over(group)
    status = F.when(n == k, "full_support").when((c("hypothesis") == "H1") & (n == 1), "partial_support").otherwise("not_supported")
    return tested.select("hypothesis", "comparison", "estimate", "ci_lower", "ci_upper", "holds", status.alias("status"))


@query(f"""with {FORECASTS}, q as (select model, avg(ql) q from losses where ev group by 1) select model,
 round(q, 8) qlike, row_number() over (order by q, model) rank, round(100 * (q - (select q from q where model = 'naive')) / (select q from q
 where model = 'naive'), 6) + 0.0 change_percent from q""")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Models by loss on event rows, and their change against persistence."""
    q = _losses(spark, d).filter("has_earnings_forward_21d").groupBy("model").agg(F.avg("qlike").alias("q"))
    every = Window.partitionBy(F.lit(1))
    base = F.max(F.when(c("model") == "naive", c("q"))).over(every)
    return q.select("model", F.round("q", 8).alias("qlike"), F.row_number().over(every.orderBy("q", "model")).cast("long").alias("rank"), rounded(100 * (c("q") - base) / base, 6).alias("change_percent"))


@query(f"with {FORECASTS} select model, round(avg(ql), 8) qlike from losses group by 1 order by avg(ql), model limit 1")
def argmin_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of least loss, ties by name."""
    q = _losses(spark, d).groupBy("model").agg(F.avg("qlike").alias("q"))
    return q.orderBy("q", "model").limit(1).select("model", F.round("q", 8).alias("qlike"))


# ---- report tables

@query(f"""with {FORECASTS} select count(*) as rows, count(distinct permno) entities,
 count(distinct dlycaldt) dates, min(dlycaldt) first_origin, max(dlycaldt) last_origin from fc""")
def report_sample(spark: SparkSession, d: str) -> DataFrame:
    """Size and period of the evaluation sample."""
    return forecasts(spark, d).agg(F.count("*").alias("rows"), F.countDistinct("permno").alias("entities"), F.countDistinct("dlycaldt").alias("dates"), F.min("dlycaldt").alias("first_origin"), F.max("dlycaldt").alias("last_origin"))


@query(f"with {FORECASTS}, m as (select model, sqrt(avg(se)) rmse, avg(ae) mae, avg(ql) qlike from losses group by 1), g as (select * from m where model = 'garch') select m.model, round(m.rmse, 8) rmse, round(m.mae, 8) mae, round(m.qlike, 8) qlike, "
       + ", ".join(f"round(100 * (m.{x} - g.{x}) / g.{x}, 6) + 0.0 {x}_change" for x in ("rmse", "mae", "qlike")) + " from m, g")
def report_overall(spark: SparkSession, d: str) -> DataFrame:
    """Overall metrics and their change in percent against the benchmark."""
    names = ("rmse", "mae", "qlike")
    m = _losses(spark, d).groupBy("model").agg(*ev.pooled_metrics())
    base = {x: F.max(F.when(c("model") == "garch", c(x))).over(Window.partitionBy(F.lit(1))) for x in names}  # one row per model
    return m.select("model", *[rounded(c(x)).alias(x) for x in names], *[rounded(100 * (c(x) - base[x]) / base[x], 6).alias(f"{x}_change") for x in names])


@query(f"with {FORECASTS} select model, " + ", ".join(f"round(avg(ql) filter (where regime = '{x}'), 8) {x}" for x in ("low", "middle", "high")) + " from losses group by 1")
def report_regimes(spark: SparkSession, d: str) -> DataFrame:
    """QLIKE per model and regime as a table."""
    out = _losses(spark, d).groupBy("model").pivot("regime", ["low", "middle", "high"]).agg(F.avg("qlike"))
    return out.select("model", *_r("low", "middle", "high"))


_CHARTS = ("rmse", "mae", "qlike")


def _bars(x: str) -> str:
    base = f"max(case when model = 'garch' then {x} end) over (partition by grp)"
    return f"select '{x}' figure, grp panel, model series, round({x}, 8) y, round(100 * ({x} - {base}) / {base}, 6) + 0.0 change_percent from m"


@query(f"""with {FORECASTS}, g as (select 'overall' grp, * from losses union all select 'vix_' || regime, * from losses union all select case when ev then 'earnings' else 'no_earnings' end, * from losses),
 m as (select model, grp, sqrt(avg(se)) rmse, avg(ae) mae, avg(ql) qlike from g group by 1, 2)
 """ + " union all ".join(_bars(x) for x in _CHARTS))
def chart_frames(spark: SparkSession, d: str) -> DataFrame:
    """What the figures of metrics by group draw, one row per bar: figure, panel, series, height and change against the benchmark."""
    m = ev.group_metrics(_losses(spark, d), regime="regime", event="has_earnings_forward_21d", entity="permno", day="dlycaldt")
    bars = m.select("grp", "model", F.inline(F.array(*[F.struct(F.lit(x).alias("figure"), c(x).alias("y")) for x in _CHARTS])))
    base = F.max(F.when(c("model") == "garch", c("y"))).over(Window.partitionBy("figure", "grp"))
    return bars.select("figure", c("grp").alias("panel"), c("model").alias("series"), rounded(c("y")).alias("y"), rounded(100 * (c("y") - base) / base, 6).alias("change_percent"))


@query()
def report_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Hypothesis estimates with their intervals as text."""
    return hypothesis_decisions(spark, d).select("hypothesis", "comparison", estimate_text(c("estimate"), c("ci_lower"), c("ci_upper"), 5).alias("interval"), "holds", "status")


@query("""select panel_id, permno, dlycaldt, forecast_garch from final_panel where forecast_garch > 0.08 and not isnan(forecast_garch)
 order by forecast_garch desc, panel_id limit 20""")
def absurd_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """The twenty greatest forecasts beyond a bound."""
    rows = table(spark, d, "final_panel").filter((c("forecast_garch") > 0.08) & ~F.isnan("forecast_garch"))
    return rows.orderBy(F.desc("forecast_garch"), "panel_id").limit(20).select("panel_id", "permno", "dlycaldt", "forecast_garch")


# ---- profiles

@query(f"""with {VOL} select count(vol) n, round(avg(vol), 8) mean, round(stddev_samp(vol), 8) std, round(min(vol), 8) "min",
 round(quantile_cont(vol, 0.25), 8) q25, round(quantile_cont(vol, 0.5), 8) q50, round(quantile_cont(vol, 0.75), 8) q75, round(max(vol), 8) "max"
 from vols""")
def describe_vol(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, deviation and exact quartiles."""
    q = F.percentile("vol", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = volatility(spark, d).agg(F.count("vol").alias("n"), F.avg("vol").alias("mean"), F.stddev_samp("vol").alias("std"), F.min("vol").alias("min"), q.alias("q"), F.max("vol").alias("max"))
    return out.select("n", *_r("mean", "std", "min"), *[rounded(c("q")[i]).alias(f"q{p}") for i, p in enumerate((25, 50, 75))], *_r("max"))


_PROFILED = ("gvkey", "dlyret", "dlyprc", "dlyprcflg", "dlyretmissflg", "dlydelflg", "in_sp500_membership")


@query("select count(*) as rows, " + ", ".join(f"count(*) - count({x}) {x}" for x in _PROFILED) + " from daily_prices")
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    """Nulls per column in one pass."""
    return table(spark, d, "daily_prices").agg(F.count("*").alias("rows"), *[(F.count("*") - F.count(x)).alias(x) for x in _PROFILED])


@query("select dlyprcflg, dlyretmissflg, dlydelflg, count(*) n from daily_prices group by 1, 2, 3")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per combination, null being a group."""
    return table(spark, d, "daily_prices").groupBy("dlyprcflg", "dlyretmissflg", "dlydelflg").agg(F.count("*").alias("n"))


@query("""select x.regime, coalesce(n, 0) n from (values ('low'), ('middle'), ('high'), ('unknown')) x(regime) left join (select vix_regime regime,
 count(*) n from final_panel group by 1) y on y.regime = x.regime""")
def value_counts_domain(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a fixed domain, 0 where there are none."""
    domain = spark.createDataFrame([(x,) for x in ("low", "middle", "high", "unknown")], "regime string")
    counts = table(spark, d, "final_panel").groupBy(c("vix_regime").alias("regime")).agg(F.count("*").alias("n"))
    return domain.join(counts, "regime", "left").select("regime", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {FORECASTS} select year(dlycaldt)::int as year, count(*) filter (where regime = 'low') low,
 count(*) filter (where regime = 'middle') middle, count(*) filter (where regime = 'high') high from fc group by 1""")
def regime_year_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Rows per year and regime as a table, 0 where there are none."""
    return forecasts(spark, d).groupBy(F.year("dlycaldt").alias("year")).pivot("regime", ["low", "middle", "high"]).count().na.fill(0)


@query(f"""with {FORECASTS} select dlycaldt d, min(regime) regime, count(distinct regime) regimes, dense_rank() over (order by dlycaldt) - 1 code
 from fc group by dlycaldt""")
def date_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Dense codes of the dates and their regime, with the uniqueness check."""
    days = forecasts(spark, d).groupBy(c("dlycaldt").alias("d")).agg(F.min("regime").alias("regime"), F.countDistinct("regime").alias("regimes"))
    return days.withColumn("code", (F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("d")) - 1).cast("long"))


@query(f"""with {VOL}, x as (select d, avg(vol) m from vols group by d) select round(max(m), 8) peak,
 round(avg(m) filter (where d between date '2008-09-01' and date '2009-06-30'), 8) crisis,
 round(avg(m) filter (where d < date '2008-09-01'), 8) calm from x""")
def crisis_profile(spark: SparkSession, d: str) -> DataFrame:
    """Peak of the cross-sectional mean and means of two periods."""
    daily = volatility(spark, d).groupBy("d").agg(F.avg("vol").alias("m"))
    early = c("d") < F.lit("2008-09-01").cast("date")
    crisis = c("d").between(F.lit("2008-09-01").cast("date"), F.lit("2009-06-30").cast("date"))
    return daily.agg(rounded(F.max("m")).alias("peak"), rounded(F.avg(F.when(crisis, c("m")))).alias("crisis"), rounded(F.avg(F.when(early, c("m")))).alias("calm"))


@query("select row_id, coalesce(gvkey like '%00%', false) has_zeros from daily_prices")
def substring_flag(spark: SparkSession, d: str) -> DataFrame:
    """A substring test in which null is False."""
    return table(spark, d, "daily_prices").select("row_id", F.coalesce(c("gvkey").contains("00"), F.lit(False)).alias("has_zeros"))


@query()
def table_hash(spark: SparkSession, d: str) -> DataFrame:
    """Rows and order-free hash of a table."""
    return content_hash(table(spark, d, "daily_prices"))


# ---- sampling and rankings

#: Fixed value: rows of the stratified sample, all rows where there are fewer.
_SAMPLE = 10_000


def _strata(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = forecasts(spark, d).select("permno", "dlycaldt", F.year("dlycaldt").alias("year"), "regime")
    position = F.when(c("regime") == "low", 1).when(c("regime") == "middle", 2).otherwise(3)
    sizes = rows.groupBy("year", "regime").agg(F.count("*").alias("size")).withColumn("position", position)
    return rows, ranking.largest_remainder(sizes, size="size", n=F.least(F.lit(_SAMPLE), F.sum("size").over(Window.partitionBy(F.lit(1)))), order=["year", "position"])


_ALLOCATED = f"""{FORECASTS}, st as (select year(dlycaldt)::int as year, regime, count(*) size, case regime when 'low' then 1 when 'middle' then 2 else 3 end pos from fc group by 1, 2),
 q as (select *, count(*) over () k, (least({_SAMPLE}, sum(size) over ()) - count(*) over ()) * (size - 1.0::double) / (sum(size) over () - count(*) over ()) quota from st),
 a as (select *, floor(quota) f, row_number() over (order by case when size - 1 - floor(quota) > 0 then 0 else 1 end, quota - floor(quota) desc, year, pos) rk, least({_SAMPLE}, sum(size) over ()) - k - sum(floor(quota)) over () lft from q),
 al as (select year, regime, size, (1 + f + case when rk <= lft and size - 1 - f > 0 then 1 else 0 end)::bigint allocation from a)"""


@query(f"with {_ALLOCATED} select year, regime, size, allocation from al")
def largest_remainder_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Proportional allocation with one row per stratum."""
    return _strata(spark, d)[1].select("year", "regime", "size", "allocation")


@query(f"""with {_ALLOCATED}, r
 as (select permno, dlycaldt, year(dlycaldt)::int as year, regime, row_number() over (partition by year(dlycaldt), regime
 order by md5('42|' || permno || '|' || dlycaldt), permno, dlycaldt) k from fc) select permno, dlycaldt, r.year, r.regime from r
 join al on al.year = r.year and al.regime = r.regime where k <= allocation""")
def stratified_sample_md5(spark: SparkSession, d: str) -> DataFrame:
    """A stratified sample that doesn't depend on the order of the input."""
    rows, allocation = _strata(spark, d)
    return ranking.stratified_sample(rows, allocation, strata=["year", "regime"], key=["permno", "dlycaldt"], seed=42)


@query(f"""with {_ALLOCATED}, r
 as (select permno, dlycaldt, year(dlycaldt)::int as year, regime, row_number() over (partition by year(dlycaldt), regime
 order by md5('42|' || permno || '|' || dlycaldt), permno, dlycaldt) k from fc), s as (select permno, dlycaldt, r.regime from r
 join al on al.year = r.year and al.regime = r.regime where k <= allocation)
 select sha256(string_agg(permno || '|' || dlycaldt || '|' || regime || chr(10), '' order by permno, dlycaldt)) digest, count(*) n from s""")
def sample_key_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash that locks a sample: kept at the first call for a population, and required to be the same at each later one."""
    out = staged(ranking.sample_digest(stratified_sample_md5(spark, d), key=["permno", "dlycaldt"], line=["permno", "dlycaldt", "regime"]))
    found, n = out.first()
    rows, content = content_hash(forecasts(spark, d)).first()
    lock = kept_folder(spark, f"samples/{rows}-{content}-{_SAMPLE}.json")
    if files.exists(spark, lock):
        locked = read_locked(lock, files.sha256(spark, lock), 1)
        guards.require_digest(f"{found} of {n}", locked["digest"], "stratified sample")
    else:
        write_json({"schema_version": 1, "digest": f"{found} of {n}"}, lock, force=False)
    return out


def _values(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).select(F.year("dlycaldt").alias("year"), *[(c(f) - c("target_forward_21d")).alias(m) for m, f in MODELS.items()])


_VALUES = f"{FORECASTS}, vals as (" + " union all ".join(f"select year(dlycaldt)::int as year, '{m}' feature, {f} - target_forward_21d x from fc" for m, f in MODELS.items()) + ")"


@query(f"""with {_VALUES}, m as (select feature, avg(abs(x)) a, avg(x) s from vals group by 1) select feature, round(a, 8) mean_absolute,
 round(s, 8) + 0.0 mean_signed, round(a / sum(a) over (), 8) share, row_number() over (order by a desc, feature) rank from m""")
def rank_importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean sizes per column, shares and ranks."""
    return ranking.ranked_importance(_values(spark, d), list(MODELS)).select("feature", *_r("mean_absolute", "mean_signed", "share"), "rank")


_GROUPS = {"classical": ["naive", "ewma", "garch"], "trees": ["random_forest", "xgboost"]}


def _gap(names: list[str]) -> str:
    return " + ".join(f"({MODELS[m]} - target_forward_21d)" for m in names)


def _group(name: str, models: list[str]) -> str:
    gross = " + ".join(f"avg(abs({MODELS[m]} - target_forward_21d))" for m in models)
    return f"select '{name}' grp, {gross} a, avg(abs({_gap(models)})) n from fc"


@query(
    f"with {FORECASTS}, m as (" + " union all ".join(_group(g, ms) for g, ms in _GROUPS.items())
    + """) select grp, round(a, 8) mean_absolute, round(n, 8) mean_absolute_net, round(a / sum(a) over (), 8) share,
 row_number() over (order by a desc, grp) rank from m"""
)
def group_importance(spark: SparkSession, d: str) -> DataFrame:
    """Gross and net importance of groups of columns."""
    return ranking.ranked_groups(_values(spark, d), _GROUPS).select("grp", *_r("mean_absolute", "mean_absolute_net", "share"), "rank")


_SEGMENTS = """seg as (select 'overall' segment, * from vals union all select 'early', * from vals where year <= 2019 union all select 'late', * from vals where year > 2019),
 rk as (select segment, feature, avg(abs(x)) a, row_number() over (partition by segment order by avg(abs(x)) desc, feature) rank from seg group by 1, 2)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(F.lit("overall"), F.when(c("year") <= 2019, "early").otherwise("late")))
    return ranking.ranked_importance(_values(spark, d).withColumn("segment", each), list(MODELS), by=["segment"])


@query(f"with {_VALUES}, {_SEGMENTS} select segment, feature, round(a, 8) mean_absolute, rank from rk")
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of all rows and of two periods."""
    return _segments(spark, d).select("segment", "feature", *_r("mean_absolute"), "rank")


@query(f"""with {_VALUES}, {_SEGMENTS} select round(corr(a.rank, b.rank), 8) + 0.0 correlation, count(*) labels from rk a join rk b using (feature)
 where a.segment = 'early' and b.segment = 'late'""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the ranks of two periods."""
    s = _segments(spark, d)
    return ranking.rank_correlation(s.filter("segment = 'early'"), s.filter("segment = 'late'"), "feature").select(*_r("correlation"), "labels")


@query(f"""with {_VALUES}, {_SEGMENTS}, t as (select feature, count(*) n from rk where rank <= 2 and segment <> 'overall' group by 1)
 select coalesce(string_agg(case when n = 2 then feature end, ',' order by feature), '') shared,
 round(count(*) filter (where n = 2) / count(*), 8) + 0.0 jaccard from t""")
def topn_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the first ranks of two periods."""
    s = _segments(spark, d)
    return ranking.top_overlap(s.filter("segment = 'early'"), s.filter("segment = 'late'"), "feature", 2).select("shared", *_r("jaccard"))


# ---- recursions and models

_PARAMETERS = {"omega": 0.05, "alpha": 0.08, "beta": 0.9, "initial": 4.0}


@query(f"""with recursive {PANEL}, k as (select permno, d, r * 100 x, year(d) y, row_number() over (partition by permno, year(d) order by d) i from panel),
 s as (select permno, y, i, x, cast(4.0 as double) h from k where i = 1
  union all select k.permno, k.y, k.i, k.x, case when s.x is null then 0.05 / (1 - 0.08 - 0.9) else 0.05 + 0.08 * s.x * s.x + 0.9 * s.h end from s join k on k.permno = s.permno and k.y = s.y and k.i = s.i + 1)
 select permno, d, round(sqrt(h), 8) sigma, round(case when s.x is not null then sqrt(greatest(0.05 / (1 - 0.98) + (0.05 + 0.08 * s.x * s.x + 0.9 * h - 0.05 / (1 - 0.98)) * ((1 - 0.98 ** 21) / (1 - 0.98)) / 21, 1e-12)) / 100 end, 8) forecast from k join s using (permno, y, i)""")
def garch_filter_fixed_params(spark: SparkSession, d: str) -> DataFrame:
    """variance filter and closed-form forecasts with given parameters."""
    rows = panel(spark, d).withColumns({k: F.lit(v) for k, v in _PARAMETERS.items()})
    return garch.garch_filter(rows).select("permno", "d", F.round(F.sqrt("sigma2"), 8).alias("sigma"), F.round("forecast", 8).alias("forecast"))


@query(f"""with {PANEL}, y as (select permno, year(d)::int as year, r * 100 x from panel), k as (select distinct permno, year from y)
 select k.permno, k.year, count(x) n, round(var_pop(x), 6) + 0.0 variance from k left join y on y.permno = k.permno and y.year < k.year group by 1, 2""")
def garch_history(spark: SparkSession, d: str) -> DataFrame:
    """What each year's fit may look back on: the number of returns and their population variance."""
    rows = panel(spark, d).select(c("permno").alias("entity"), F.year("d").alias("year"), (c("r") * 100).alias("x"))
    return garch.histories(rows).select(c("entity").alias("permno"), "year", "n", rounded(c("variance"), 6).alias("variance"))


@query()
def garch_fit(spark: SparkSession, d: str) -> DataFrame:
    """Annual expanding fits with their status."""
    return garch.garch_parameters(panel(spark, d))


@query()
def garch_status(spark: SparkSession, d: str) -> DataFrame:
    """Fits per year and status."""
    return garch_fit(spark, d).groupBy("year", "status").agg(F.count("*").alias("n"))


@query()
def garch_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts with the parameters fitted to the years before, which are checked."""
    rows = panel(spark, d)
    parameters = staged(garch.garch_parameters(rows))
    guards.require(parameters, {"bad_parameters": guards.bad_parameters()}, "GARCH parameters")
    return garch.garch_forecasts(rows, parameters).filter("forecast is not null")
