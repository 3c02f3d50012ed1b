"""Queries of the training-data operators over the test tables, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.automaton import encode_corpus
from tidepanel.llm.mixing import folded_name, mix_plan, mix_shares, mix_sources
from tidepanel.llm.sampling import SampleLedger, proportional_quotas, proportional_sample
from tidepanel.llm.subjects import assign_subjects
from tidepanel.session import collected, kept_folder, staged
from tidepanel.sources.files import qualified
from tidepanel.sources.tables import table

c = F.col

#: The states of the panel at which the sample grew: rows loaded before each day, then all.
LEDGER_CUTS = ("2017-01-01", "2020-01-01", "2023-01-01", None)
LEDGER_RATE = 0.02
SAMPLE_RATE = 0.05
SEED = "panel-sample-1"


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    key = ["permno", "dlycaldt"]
    arrived = staged(table(spark, d, "final_panel").select(*key, "loaded_at").dropna(subset=key).groupBy(*key).agg(F.min("loaded_at").alias("arrived")))
    place = qualified(spark, f"{d}/final_panel")
    identity = hashlib.sha256("|".join([place, *key, str(LEDGER_RATE), SEED]).encode()).hexdigest()[:32]
    ledger = SampleLedger(spark, kept_folder(spark, f"ledger-{identity}"), key, LEDGER_RATE, SEED)
    # a ledger that has been through the early states goes on with the table as it is now
    for cut in LEDGER_CUTS[min(ledger.generation, len(LEDGER_CUTS) - 1) :]:
        ledger.update(arrived if cut is None else arrived.filter(c("arrived") < F.lit(cut).cast("timestamp_ntz")))
    return ledger.read()


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of the panel's keys that keeps its members as the table in folder ``d`` grows.

    The first call takes the sample through four states of the table; each later
    one, also of another session with the same ``spark.checkpoint.dir``, joins the
    members kept before and adds to them.
    """
    return _ledger(spark, d).select("permno", "dlycaldt", "generation")


_CATEGORY = ["panel_year", "vix_regime"]


def _population(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "final_panel").select("panel_id", "permno", "dlycaldt", folded_name(c("vix_regime")).alias("vix_regime")).filter(c("vix_regime").isin("low", "middle", "high") & c("permno").isNotNull() & c("dlycaldt").isNotNull())
    keys = rows.groupBy("permno", "dlycaldt").agg(F.max_by("vix_regime", "panel_id").alias("vix_regime"))
    targets = table(spark, d, "sample_targets").withColumn("vix_regime", folded_name(c("vix_regime")))
    population = keys.withColumn("panel_year", F.year("dlycaldt"))
    return population, proportional_quotas(population, targets, category=_CATEGORY, share="target_share", least="min_rows", rate=SAMPLE_RATE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The categories whose target can't be met."""
    return _population(spark, d)[1].filter("short").select(*_CATEGORY)


def p6_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Target, available and sampled numbers per category, with the shortfall."""
    return _population(spark, d)[1].withColumn("shortfall", c("wanted") - c("granted"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample of the panel's keys that matches the target proportions."""
    population, quotas = _population(spark, d)
    return proportional_sample(population, quotas, category=_CATEGORY, key=["permno", "dlycaldt"], seed=SEED).select("permno", "dlycaldt", *_CATEGORY)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents"), key=c("doc_id"), text=c("text")).select(c("key").alias("doc_id"), "ids")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = encode_corpus(table(spark, d, "documents"), key=c("doc_id"), text=c("text"), count_only=True, group=folded_name(c("source")))
    sizes = staged(counted.select("key", c("group").alias("source"), c("n_tokens").alias("size")))
    plan = mix_plan(sizes, table(spark, d, "mix_targets"))
    return mix_sources(sizes, plan), plan


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each document used, and how often."""
    return _mix(spark, d)[0].select(c("key").alias("doc_id"), "source", c("size").alias("n_tokens"), "uses")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of tokens that the mix reached per source."""
    return mix_shares(*_mix(spark, d))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in collected(table(spark, d, "subject_areas").select("subject").dropna().distinct())]
    return assign_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"), names).filter("posterior >= 0.5")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject, and their share of all documents with text."""
    total = table(spark, d, "documents").filter(F.length(F.trim("text")) > 0).count()
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("share").alias("weight")).withColumn("share_of_corpus", c("documents") / F.lit(max(total, 1)))


QUERIES = {f.__name__: f for f in (p3_sample, p6_found, p6_quotas, p6_sample, p7_ids, p8_mix, p8_shares, p9_found, p9_composition)}

_P3_STEP = """
 t{g} as (select floor(0.02 * count(*))::bigint - (select count(*) from s{p}) need from k where {cut}),
 s{g} as (select * from s{p} union all select permno, dlycaldt, {g} from (select permno, dlycaldt, row_number() over (order by priority, permno, dlycaldt) r from k
   where {cut} and not exists (select 1 from s{p} where s{p}.permno = k.permno and s{p}.dlycaldt = k.dlycaldt)) where r <= (select need from t{g}))"""

#: The population's members and counts per category, and the targets with the counts (y, r: category; s: share; f: minimum; a: members).
_P6_POPULATION = """with recursive m as (select permno, dlycaldt, arg_max(lower(trim(vix_regime)), panel_id) vix_regime from final_panel
   where lower(trim(vix_regime)) in ('low', 'middle', 'high') and permno is not null and dlycaldt is not null group by permno, dlycaldt),
 n as (select count(*) // 20 n from m), h as (select year(dlycaldt) y, vix_regime r, count(*) a from m group by 1, 2),
 t as (select panel_year y, lower(trim(t.vix_regime)) r, coalesce(target_share, 0) s, coalesce(min_rows, 0)::bigint f, coalesce(a, 0) a
  from sample_targets t left join h on h.y = t.panel_year and h.r = lower(trim(t.vix_regime)))"""

#: Largest remainders within floors and caps, in whole numbers: shares in parts of 10^12; each step fixes the categories beyond a bound.
_P6 = _P6_POPULATION + """,
 b as (select y, r, s, a, n, greatest(f, ceil(round(s * n, 9)))::bigint w, least(f, a)::hugeint lo, a::hugeint hi, round(s * 1e12)::hugeint p, row_number() over (order by y, r) i from t, n),
 st as (select 0 step, i, p, lo, hi, n, case when hi = 0 then 0::hugeint end fixed from b
  union all
  select step + 1, i, p, lo, hi, n, case when fixed is not null then fixed when below >= above and part < lo * whole then lo when below < above and part > hi * whole then hi end
  from (select *, sum(case when fixed is null then greatest(lo * whole - part, 0) else 0 end) over () below, sum(case when fixed is null then greatest(part - hi * whole, 0) else 0 end) over () above
   from (select *, greatest(whole_p, 1) whole, greatest(rest, 0) * p part from (select *, sum(case when fixed is null then p else 0 end) over () whole_p, n - sum(coalesce(fixed, 0)) over () rest from st)))
  where below > 0 or above > 0),
 last as (select *, greatest(sum(case when fixed is null then p else 0 end) over (), 1) whole, greatest(n - sum(coalesce(fixed, 0)) over (), 0) * p part from st where step = (select max(step) from st)),
 down as (select *, coalesce(fixed, part // whole) got, part % whole left_over from last),
 more as (select *, n - sum(got) over () missing, row_number() over (partition by fixed is null order by left_over desc, i) k from down),
 q as (select b.*, (got + case when fixed is null and k <= missing and got < more.hi then 1 else 0 end)::bigint quota from more join b using (i))"""

SQL = {
    "p3_sample": f"""with k as (select permno, dlycaldt, min(loaded_at) arrived, md5('{SEED}|' || permno || '|' || dlycaldt) priority from final_panel where permno is not null and dlycaldt is not null group by permno, dlycaldt),
 s0 as (select permno, dlycaldt, 0 generation from k where false),"""
    + ",".join(_P3_STEP.format(g=g, p=g - 1, cut=f"arrived < timestamp '{x} 00:00:00'" if x else "true") for g, x in enumerate(LEDGER_CUTS, start=1))
    + f" select permno, dlycaldt, generation from s{len(LEDGER_CUTS)}",
    "p6_found": """with m as (select distinct permno, dlycaldt, lower(trim(vix_regime)) vix_regime from final_panel where lower(trim(vix_regime)) in ('low', 'middle', 'high') and permno is not null and dlycaldt is not null),
 n as (select count(distinct (permno, dlycaldt)) // 20 n from m), h as (select year(dlycaldt) y, vix_regime r, count(*) a from m group by 1, 2)
 select t.panel_year, lower(trim(t.vix_regime)) vix_regime from sample_targets t left join h on h.y = t.panel_year and h.r = lower(trim(t.vix_regime)), n
 where coalesce(a, 0) < greatest(min_rows, ceil(round(target_share * n, 9)))""",
    "p6_quotas": _P6 + """ select y panel_year, r vix_regime, s target, a available, w wanted, quota, least(a, w) granted, a < w short, greatest(w - a, 0) shortfall from q""",
    "p6_sample": _P6 + f""", ranked as (select permno, dlycaldt, year(dlycaldt) y, vix_regime r,
   row_number() over (partition by year(dlycaldt), vix_regime order by md5('{SEED}|' || permno || '|' || dlycaldt), permno, dlycaldt) k from m)
 select permno, dlycaldt, x.y::int panel_year, x.r vix_regime from ranked x join q on q.y = x.y and q.r = x.r where k <= quota""",
}
