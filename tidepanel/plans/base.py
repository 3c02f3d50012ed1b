"""Base tables of the queries, one row per key, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import finite
from tidepanel.operators.timeseries import by_entity, rolling_std
from tidepanel.sources.tables import table

c = F.col
MODELS = {"naive": "forecast_naive", "ewma": "forecast_ewma", "garch": "forecast_garch", "random_forest": "forecast_random_forest", "xgboost": "forecast_xgboost"}


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(permno, d, r): one row per security and day, the latest delivery with a return that is a number; no reading is cut."""
    r = F.when(finite(c("dlyret")), c("dlyret"))
    return table(spark, d, "daily_prices").filter("permno is not null and dlycaldt is not null").groupBy("permno", c("dlycaldt").alias("d")).agg(F.max_by(r, F.when(r.isNotNull(), c("row_id"))).alias("r"))


PANEL = """panel as (select permno, dlycaldt d, arg_max(r, row_id) filter (where r is not null) r from (select *, case when isfinite(dlyret) then dlyret end r from daily_prices)
  where permno is not null and dlycaldt is not null group by permno, dlycaldt)"""


def volatility(spark: SparkSession, d: str) -> DataFrame:
    """The panel with its trailing 21-row volatility."""
    return panel(spark, d).withColumn("vol", rolling_std(c("r"), 21, by_entity("permno", "d")))


VOL = PANEL + """, vols as (select *, case when count(r) over w = 21 then stddev_samp(r) over w end vol, row_number() over (partition by permno order by d) k,
  lead(d, 21) over (partition by permno order by d) target_end from panel window w as (partition by permno order by d rows between 20 preceding and current row)),
 targets as (select *, lead(vol, 21) over (partition by permno order by d) target from vols)"""


def index_levels(spark: SparkSession, d: str) -> DataFrame:
    """(d, v): one valid close per date, the latest delivery; no level is cut."""
    ok = finite(c("vix_close")) & c("withdrawn_at").isNull() & c("date").isNotNull()
    return table(spark, d, "vix").filter(ok).groupBy(c("date").alias("d")).agg(F.max_by("vix_close", "vix_row_id").alias("v"))


INDEX = """idx as (select date d, arg_max(vix_close, vix_row_id) v from vix where isfinite(vix_close) and withdrawn_at is null and date is not null group by date)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """The five-model panel: one row per key, the latest of a known regime with complete positive values."""
    values = ["target_forward_21d", *MODELS.values()]
    rows = table(spark, d, "final_panel").select("panel_id", "permno", "dlycaldt", "target_end_date", "has_earnings_forward_21d", F.lower(F.trim("vix_regime")).alias("regime"), *values)
    good = c("regime").isin("low", "middle", "high") & c("has_earnings_forward_21d").isNotNull() & c("permno").isNotNull() & c("dlycaldt").isNotNull()
    for v in values:
        good = good & (c(v) > 0) & (c(v) < float("inf")) & ~F.isnan(v)
    kept = [x for x in rows.columns if x not in ("panel_id", "permno", "dlycaldt")]
    one = rows.filter(good).groupBy("permno", "dlycaldt").agg(F.max_by(F.struct(*kept), "panel_id").alias("x"))
    return one.select("permno", "dlycaldt", "x.*")


FORECASTS = (
    "fc as (select * from (select permno, dlycaldt, target_end_date, has_earnings_forward_21d, lower(trim(vix_regime)) regime, target_forward_21d, "
    + ", ".join(MODELS.values())
    + ", row_number() over (partition by permno, dlycaldt order by panel_id desc) k from final_panel where lower(trim(vix_regime)) in ('low', 'middle', 'high') and has_earnings_forward_21d is not null and permno is not null and dlycaldt is not null"
    + "".join(f" and {v} > 0 and isfinite({v})" for v in ["target_forward_21d", *MODELS.values()])
    + ") where k = 1), losses as ("
    + " union all ".join(
        f"select permno, dlycaldt, regime, has_earnings_forward_21d ev, '{m}' model, (target_forward_21d - {f}) ** 2 se, abs(target_forward_21d - {f}) ae, target_forward_21d ** 2 / {f} ** 2 - ln(target_forward_21d ** 2 / {f} ** 2) - 1 ql from fc"
        for m, f in MODELS.items()
    )
    + ")"
)
