"""Queries of the data-quality operators over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import rounded
from tidepanel.operators.asof import asof_attributes, attribute_intervals
from tidepanel.operators.references import orphan_counts, orphan_references, padded_key
from tidepanel.operators.rolling import idle_days, trailing_totals
from tidepanel.operators.spikes import LEVEL_RULE, RETURN_RULE, flag_spikes
from tidepanel.sources.tables import table

c = F.col


def _spikes(spark: SparkSession, d: str) -> DataFrame:
    prices, vix = table(spark, d, "daily_prices"), table(spark, d, "vix")
    marks = table(spark, d, "earnings_dates").select(c("permno").alias("source"), c("anndats").alias("day")).distinct()
    returns = flag_spikes(prices, RETURN_RULE, source=c("permno"), time=c("dlycaldt"), value=c("dlyret"), order=c("row_id"), impossible=c("dlyret") < -1, exempt=c("dlydelflg") == "Y", marks=marks)
    close = c("vix_close")
    outside = F.coalesce(close > F.nanvl("vixh", F.lit(None)), F.lit(False)) | F.coalesce(close < F.nanvl("vixl", F.lit(None)), F.lit(False))
    levels = flag_spikes(vix, LEVEL_RULE, source=F.lit(0), time=c("date"), value=close, order=c("vix_row_id"), impossible=(close <= 0) | outside, exempt=F.lit(False))
    return returns.withColumn("source_table", F.lit("daily_prices")).unionByName(levels.withColumn("source_table", F.lit("vix")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings of returns and of the index, by row."""
    return _spikes(spark, d).select("source_table", c("order").alias("row_id"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The implausible readings and which of the three rules each breaks."""
    return _spikes(spark, d).select("source_table", c("order").alias("row_id"), "impossible", "spike", "stuck")


def p1_innovations(spark: SparkSession, d: str) -> DataFrame:
    """The implausible readings with the standardised innovation of the filter."""
    return _spikes(spark, d).select("source_table", c("order").alias("row_id"), F.round("innovation", 6).alias("innovation"))


def _activity(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    return table(spark, d, "daily_prices"), {"entity": c("permno"), "day": c("dlycaldt"), "value": c("dlyret"), "order": c("row_id")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Days whose trailing week holds no return."""
    rows, names = _activity(spark, d)
    return idle_days(rows, **names).select(c("entity").alias("permno"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of returns over the last 7 and 30 days, for every calendar day."""
    rows, names = _activity(spark, d)
    figures = [rounded(c(f"{k}_{n}"), 10).alias(f"{k}_{n}") for n in (7, 30) for k in ("total", "average")]
    return trailing_totals(rows, **names).select(c("entity").alias("permno"), F.date_format("day", "yyyy-MM-dd").alias("day"), *figures, "values_7", "values_30")


def _orphans(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    prices, vix, panel = (table(spark, d, t) for t in ("daily_prices", "vix", "final_panel"))
    month = lambda x: F.date_format(x, "yyyy-MM")
    closed = c("vix_close").isNotNull() & ~F.isnan("vix_close")
    return {
        "daily_prices": orphan_references(prices, vix, record=c("row_id"), reference=c("dlycaldt"), at=c("loaded_at"), key=c("date"), known=c("loaded_at"), valid=closed & c("withdrawn_at").isNull(), period=month("dlycaldt")),
        "vix": orphan_references(vix.filter(closed), table(spark, d, "trading_days"), record=c("vix_row_id"), reference=c("date"), at=c("loaded_at"), key=c("trade_date"), period=month("date")),
        "final_panel": orphan_references(panel, table(spark, d, "company"), record=c("panel_id"), reference=padded_key(c("gvkey")), at=c("loaded_at"), key=padded_key(c("gvkey")), known=c("loaded_at"), valid=c("deleted_at").isNull(), period=month("dlycaldt")),
    }


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose reference has no record behind it."""
    parts = [x.select(F.lit(t).alias("source_table"), c("record").alias("row_id")) for t, x in _orphans(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    parts = [orphan_counts(x.withColumn("reference", c("reference").cast("string")), t) for t, x in _orphans(spark, d).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "link_history").filter(c("linktype").isin("LC", "LU") & c("linkprim").isin("P", "C"))
    tie = F.concat(F.date_format("linkdt", "yyyyMMdd"), c("linkprim"))
    linked = attribute_intervals(links, entity=c("permno"), start=c("linkdt"), end=c("linkenddt"), known=c("recorded_on"), value=c("gvkey"), tie=tie, name="gvkey_then")
    spells = attribute_intervals(table(spark, d, "universe"), entity=c("permno"), start=c("universe_start"), end=c("universe_end"), known=c("recorded_on"), value=F.lit("1"), tie=F.lit(""), name="member_then")
    prices = table(spark, d, "daily_prices")
    carry = {"gvkey": c("gvkey"), "member": c("in_sp500_membership")}
    joined = asof_attributes(prices, linked.unionByName(spells), ["gvkey_then", "member_then"], record=c("row_id"), entity=c("permno"), time=c("dlycaldt"), carry=carry)
    return joined.select(c("record").alias("row_id"), "gvkey", c("member").cast("boolean").alias("member"), "gvkey_then", c("member_then").isNotNull().alias("member_then"))


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Each price row with the company key and membership valid and known on its day."""
    return _attributes(spark, d).select("row_id", "gvkey_then", "member_then")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Price rows whose own attributes say otherwise than those known on the day."""
    wrong = (c("gvkey").isNotNull() & ~c("gvkey").eqNullSafe(c("gvkey_then"))) | (c("member").isNotNull() & (c("member") != c("member_then")))
    return _attributes(spark, d).filter(wrong).select("row_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_innovations, p2_found, p2_totals, p4_found, p4_report, p5_found, p5_attributes)}

#: Each price row's readings on the previous date and the median around it, by plain window functions.
_P1 = """
with p as (select row_id, permno, dlycaldt d, dlyret r, dlydelflg y, row_number() over (partition by permno order by dlycaldt, row_id) k,
    row_number() over (partition by permno, dlycaldt order by row_id) copy, row_number() over (partition by permno, dlycaldt order by row_id desc) back
  from daily_prices where dlyret is not null and not isnan(dlyret) and permno is not null and dlycaldt is not null),
 day as (select *, lag(r) over w pr, lag(d) over w pd, median(case when r <> 0 then abs(r) end) over (partition by permno order by d rows between 30 preceding and 30 following) m
  from p where copy = 1 window w as (partition by permno order by d)),
 last as (select permno, d, r from p where back = 1),
 idle as (select permno, sum(case when r = 0 and (pr is null or pr <> 0) then 1 else 0 end) runs, count(*) n from day group by permno),
 j as (select p.*, day.m, day.pr, day.pd, last.r pl, i.runs >= 3 and i.runs > 0.08 * i.n lazy
  from p join day using (permno, d) join idle i using (permno) left join last on last.permno = p.permno and last.d = day.pd),
 share as (select d, count(distinct permno) n, count(distinct case when abs(r) >= 10 * m then permno end) b from j group by d),
 big as (select j.* from j join share s using (d) where abs(r) > 20 * m and coalesce(y, 'N') <> 'Y' and not (b >= 3 and b > 0.5 * n)),
 excused as (select distinct big.row_id from big join earnings_dates e on e.permno = big.permno and e.anndats between coalesce(big.pd, date '0001-01-01') and big.d),
 v as (select vix_row_id, date d, vix_close r, vixl, vixh, row_number() over (partition by date order by vix_row_id) copy, row_number() over (partition by date order by vix_row_id desc) back
  from vix where vix_close is not null and not isnan(vix_close) and date is not null),
 vd as (select *, lag(r) over (order by d) pr, lag(d) over (order by d) pd, median(abs(r)) over (order by d rows between 5 preceding and 5 following) m from v where copy = 1),
 vj as (select v.*, vd.m, vd.pr, l.r pl from v join vd using (d) left join v l on l.d = vd.pd and l.back = 1),
 f as (select 'daily_prices' source_table, row_id, coalesce(r < -1, false) impossible,
   row_id in (select row_id from big where row_id not in (select row_id from excused)) spike, coalesce(copy = 1 and (r = pr or r = pl) and not (lazy and r = 0), false) stuck from j
  union all
  select 'vix', vix_row_id, coalesce(r <= 0 or r > case when not isnan(vixh) then vixh end or r < case when not isnan(vixl) then vixl end, false),
   coalesce(r > 2 * m or r < m / 2, false), coalesce(copy = 1 and (r = pr or r = pl), false) from vj)
"""

_P2 = """
with p as (select permno, dlycaldt d, row_id, case when isfinite(dlyret) then dlyret end r from daily_prices where permno is not null and dlycaldt is not null),
 one as (select permno, d, arg_max(r, row_id) filter (where r is not null) r from p group by permno, d),
 ends as (select permno, min(d) a, max(d) b from one group by permno),
 days as (select permno, unnest(generate_series(a, b, interval 1 day))::date d from ends),
 x as (select permno, d, r from days left join one using (permno, d)),
 t as (select permno, strftime(d, '%Y-%m-%d') as day,
  sum(r) over w7 s7, count(r) over w7 n7, sum(r) over w30 s30, count(r) over w30 n30 from x
  window w7 as (partition by permno order by d rows between 6 preceding and current row), w30 as (partition by permno order by d rows between 29 preceding and current row))
"""

_P4 = """
with k as (select date, min(loaded_at) since from vix where vix_close is not null and not isnan(vix_close) and withdrawn_at is null group by date),
 f as (select panel_id, dlycaldt, loaded_at, case when regexp_full_match(trim(gvkey), '[0-9]{1,6}') then lpad(trim(gvkey), 6, '0') else trim(gvkey) end g from final_panel where trim(gvkey) <> ''),
 co as (select case when regexp_full_match(trim(gvkey), '[0-9]{1,6}') then lpad(trim(gvkey), 6, '0') else trim(gvkey) end g, min(loaded_at) since from company where deleted_at is null group by 1),
 o as (select 'daily_prices' source_table, row_id, strftime(dlycaldt, '%Y-%m') as period, cast(dlycaldt as varchar) reference, k.since is null missing from daily_prices p left join k on k.date = p.dlycaldt where dlycaldt is not null and (k.since is null or k.since > p.loaded_at)
 union all select 'vix', vix_row_id, strftime(date, '%Y-%m'), cast(date as varchar), true from vix where vix_close is not null and not isnan(vix_close) and date is not null and date not in (select trade_date from trading_days)
 union all select 'final_panel', panel_id, strftime(dlycaldt, '%Y-%m'), f.g, co.since is null from f left join co using (g) where co.since is null or co.since > f.loaded_at)
"""

_P5 = """
with right_key as (select p.row_id, arg_max(l.gvkey, (l.recorded_on, strftime(l.linkdt, '%Y%m%d') || l.linkprim, l.gvkey)) g
  from daily_prices p join (select distinct * from link_history where linktype in ('LC', 'LU') and linkprim in ('P', 'C')) l
  on l.permno = p.permno and p.dlycaldt between l.linkdt and coalesce(l.linkenddt, date '9999-12-31') and l.recorded_on <= p.dlycaldt group by p.row_id),
 right_member as (select distinct p.row_id from daily_prices p join universe u on u.permno = p.permno and p.dlycaldt between u.universe_start and u.universe_end and u.recorded_on <= p.dlycaldt),
 a as (select p.row_id, p.gvkey, p.in_sp500_membership member, k.g gvkey_then, m.row_id is not null member_then
  from daily_prices p left join right_key k using (row_id) left join right_member m using (row_id))
"""

SQL = {
    "p1_found": _P1 + "select source_table, row_id from f where impossible or spike or stuck",
    "p1_reasons": _P1 + "select * from f where impossible or spike or stuck",
    "p2_found": _P2 + "select permno, day from t where n7 = 0",
    "p2_totals": _P2 + "select permno, day, round(s7, 10) + 0.0 total_7, round(s7 / n7, 10) + 0.0 average_7, round(s30, 10) + 0.0 total_30, round(s30 / n30, 10) + 0.0 average_30, n7 values_7, n30 values_30 from t",
    "p4_found": _P4 + "select source_table, row_id from o",
    "p4_report": _P4 + "select source_table, period, case when missing then 'missing' else 'late' end reason, count(*) orphans, count(distinct reference) distinct_references from o group by 1, 2, 3",
    "p5_found": _P5 + "select row_id from a where (gvkey is not null and gvkey is distinct from gvkey_then) or member <> member_then",
    "p5_attributes": _P5 + "select row_id, gvkey_then, member_then from a",
}
