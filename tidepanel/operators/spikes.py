"""Implausible readings: spikes, stuck values and impossible values per source.

A Gaussian local-level state-space model is filtered over the log sizes of each
source's readings, forwards and backwards in time. Its observation and state
variances are estimated from the source's own readings, so that an innovation is
judged against what is normal for that source. A reading whose standardised
innovation exceeds the threshold in either pass is flagged; its update is
withheld, so that a spike doesn't drag the level. The same filter without
observation noise forecasts the last reading; where its innovations vanish against
their running variance, a source is flagged as stuck.

Only what the filters flag is held against the exact rules: the ratio to the median
of the readings around it, and equality with the reading before.

Deliveries of one (source, time) are folded to one observation with map-side
combine, so that the sequence of a source is bounded by its calendar even if one
source holds a third of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import sized, staged


@dataclass(frozen=True)
class SpikeRule:
    """Parameters of the detection.

    ``two_sided``: level series (both multiples and fractions of the median are
    spikes); otherwise the size of a signed series is judged. ``threshold`` is the
    standardised innovation from which a reading is flagged; it lies below what a
    reading at ``ratio`` times the usual gives, so that the exact rule has the last
    word on what the filter flags. ``vanishing`` is the innovation, in running
    standard deviations of the innovations, below which a reading is flagged as stuck.
    ``observation_variance`` and ``state_variance`` are what a source of few
    readings is taken to have. ``market_ratio`` and ``market_share``: a time is
    common to the sources when more than this share of at least ``market_least``
    sources move by that multiple. ``idle_share``: runs of zeros per reading from
    which idle days are normal.
    """

    ratio: float
    half_window: int
    two_sided: bool
    threshold: float
    observation_variance: float
    state_variance: float
    vanishing: float = 1e-3
    market_ratio: float = 10.0
    market_share: float = 0.5
    market_least: int = 3
    idle_share: float = 0.08


RETURN_RULE = SpikeRule(ratio=20.0, half_window=30, two_sided=False, threshold=1.5, observation_variance=1.2, state_variance=0.02)
LEVEL_RULE = SpikeRule(ratio=2.0, half_window=5, two_sided=True, threshold=2.5, observation_variance=0.001, state_variance=0.005)
#: Readings that the prior variances count for, the lag at which the state's variance shows, its least share of the
#: observation's, most standard deviations that a reading near zero pulls the level down, and memory of the running variance.
PRIOR_READINGS, FAR_LAG, LEAST_STATE, LEAST_PULL, MEMORY = 20, 20, 0.01, 2.0, 0.9


def noise_variances(y: np.ndarray, rule: SpikeRule) -> tuple[float, float]:
    """(observation, state) variance of a source's local-level model.

    A change over k readings has the variance 2 observation + k state; both follow
    from the changes over one and over FAR_LAG readings, whose variances are taken
    from median deviations, which spikes don't move. Few readings lean on the rule.
    """
    z = y[np.isfinite(y)]
    n = len(z)
    if n < 4:
        return rule.observation_variance, rule.state_variance
    spread = lambda d: float((1.4826 * np.median(np.abs(d - np.median(d)))) ** 2)
    k = max(2, min(FAR_LAG, n // 2))
    near, far = spread(z[1:] - z[:-1]), spread(z[k:] - z[:-k])
    state = max((far - near) / (k - 1), 0.0)
    observation = max((near - state) / 2, 0.0)
    own = n / (n + PRIOR_READINGS)
    observation = own * observation + (1 - own) * rule.observation_variance
    return observation, max(own * state + (1 - own) * rule.state_variance, LEAST_STATE * observation)


def kalman_levels(y: np.ndarray, rule: SpikeRule, noise: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step forecast levels, forecast deviations and withheld flags of a local-level model.

    ``y`` is the log size of each reading, NaN where there is none: the state
    then ages without an update. Updates whose standardised innovation is beyond
    the threshold are withheld, unless more than ``half_window`` in a row agree,
    which is a change of level. The filter starts at the median of the first readings.
    """
    n = len(y)
    levels, deviations, held = np.empty(n), np.empty(n), np.zeros(n, bool)
    head = y[: max(2 * rule.half_window, 1)]
    head = head[np.isfinite(head)]
    if not len(head):
        finite = y[np.isfinite(y)]
        head = finite if len(finite) else np.zeros(1)
    level = float(np.median(head))
    observation, state = noise_variances(y, rule) if noise is None else noise
    variance, squared = observation, rule.threshold**2
    run, side = 0, 0.0
    for i, value in enumerate(y.tolist()):
        variance += state
        total = variance + observation
        levels[i] = level
        deviations[i] = total
        if value != value:
            continue
        innovation = value - level
        if innovation * innovation > squared * total and (rule.two_sided or innovation > 0):
            held[i] = True
            run = run + 1 if innovation * side > 0 else 1
            side = innovation
            if run <= rule.half_window:
                continue
        else:
            if not rule.two_sided and innovation < 0:
                innovation = max(innovation, -LEAST_PULL * math.sqrt(total))  # a return near zero says little of the scale
            run = 0
        gain = variance / total
        level += gain * innovation
        variance *= 1.0 - gain
    return levels, np.sqrt(deviations), held


def vanishing_variance(innovations: np.ndarray, usual: float, rule: SpikeRule) -> np.ndarray:
    """Whether each innovation vanishes against the running variance of those before it.

    The variance is an exponentially weighted one over some ten readings, starts
    at ``usual``, and decays through a stuck stretch. NaN: no innovation.
    """
    out, state, bound = np.zeros(len(innovations), bool), usual, rule.vanishing**2
    for i, x in enumerate((innovations * innovations).tolist()):
        if x == x:
            out[i] = x <= bound * state
            state = min(MEMORY * state + (1 - MEMORY) * x, 1e300)
    return out


#: Columns that a source's filter reports for times with a finding.
FOUND = pa.schema([
    ("source", pa.int64()), ("day", pa.int32()), ("head", pa.int64()), ("centre", pa.float64()), ("move", pa.float64()),
    ("innovation", pa.float64()), ("stuck_first", pa.bool_()), ("excused", pa.bool_()),
])


def source_findings(source: int, day: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray, marked: np.ndarray, rule: SpikeRule) -> dict[str, np.ndarray]:
    """The findings of one source, whose observations come in time order.

    ``order``: that of the first delivery; ``first``/``last``: reading of the first and last delivery; ``low``/``high``:
    least and greatest size among them, NaN where a day has no reading;
    ``marked``: announcement at that time, which also excuses the next reading.
    """
    has = ~np.isnan(first)
    # an announcement at or after the previous reading's time, up to this one
    marks = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(has)
    if not len(at):
        return {k: np.empty(0) for k in FOUND.names}
    before = np.concatenate([[at[0] if len(at) else 0], at[:-1]])
    excused = marks[at + 1] - marks[before] > 0
    if marked[: at[0] + 1].any():
        excused[0] = True
    day, order, first, last, low, high = day[at], order[at], first[at], last[at], low[at], high[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        # a level has no size at or below 0: its log is taken as that of 0
        size = (lambda v: np.maximum(v, 0.0)) if rule.two_sided else np.abs
        y, top, bottom = np.log(size(first)), np.log(size(high)), np.log(size(low))
        y[~np.isfinite(y)] = np.nan
    noise = noise_variances(y, rule)
    forth, forth_sd, _ = kalman_levels(y, rule, noise)
    back, back_sd, _ = (x[::-1] for x in kalman_levels(y[::-1], rule, noise))
    # every delivery of a day is an observation that the forecasts of both passes are held against
    above = np.maximum((top - forth) / forth_sd, (top - back) / back_sd)
    innovation, candidate = above, above > rule.threshold
    if rule.two_sided:
        below = np.minimum((bottom - forth) / forth_sd, (bottom - back) / back_sd)
        candidate |= ~(below >= -rule.threshold)
        innovation = np.where(np.abs(below) > above, below, above)
    # without observation noise the forecast is the last reading, of the previous day's first or last delivery
    with np.errstate(invalid="ignore"):
        change = np.minimum(np.abs(np.diff(first, prepend=np.nan)), np.abs(first - np.concatenate([[np.nan], last[:-1]])))
    steps = change[np.isfinite(change)]
    stuck = vanishing_variance(change, float(np.median(steps)) ** 2 if len(steps) else 0.0, rule)
    stuck[1:] &= (first[1:] == first[:-1]) | (first[1:] == last[:-1])  # the exact rule
    zero = first == 0.0
    runs = int(np.sum(zero & ~np.concatenate([[False], zero[:-1]])))
    if not rule.two_sided and runs >= 3 and runs > rule.idle_share * len(first):
        stuck &= ~zero
    sizes = np.abs(first)
    sizes[~np.isfinite(sizes) | ((sizes == 0) & (not rule.two_sided))] = np.nan
    centre, move = np.full(len(first), np.nan), np.full(len(first), np.nan)
    for i in np.flatnonzero(candidate):
        part = sizes[max(0, i - rule.half_window) : i + rule.half_window + 1]
        part = part[~np.isnan(part)]
        if len(part):
            centre[i] = np.median(part)
            move[i] = np.abs(high[i]) / centre[i] if centre[i] > 0 else np.inf
    keep = np.flatnonzero(stuck | candidate)
    return {
        "source": np.full(len(keep), source), "day": day[keep], "head": order[keep], "centre": centre[keep], "move": move[keep],
        "innovation": innovation[keep], "stuck_first": stuck[keep], "excused": excused[keep],
    }


def spike_findings(observations: DataFrame, rule: SpikeRule) -> DataFrame:
    """Findings per (source, day) of ``observations`` (source, day, head, first, last, low, high, marked)."""

    def run(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("day", "ascending")]))
        number = lambda name: t.column(name).to_numpy(zero_copy_only=False).astype(float)
        head = t.column("head").fill_null(-1).to_numpy()
        found = source_findings(key[0].as_py(), t.column("day").to_numpy().astype(np.int32), head, *(number(c) for c in ("first", "last", "low", "high")), number("marked").astype(bool), rule)
        yield pa.RecordBatch.from_arrays([pa.array(found[f.name]).cast(f.type) for f in FOUND], schema=FOUND)

    schema = "source long, day int, head long, centre double, move double, innovation double, stuck_first boolean, excused boolean"
    return observations.groupBy("source").applyInArrow(run, schema)


def flag_spikes(readings: DataFrame, rule: SpikeRule, *, source: Column, time: Column, value: Column, order: Column, impossible: Column, exempt: Column, marks: DataFrame | None = None) -> DataFrame:
    """Every row of ``readings`` that can't be true: (order, impossible, spike, stuck, innovation).

    ``order`` is a unique number that also orders the deliveries of one time.
    ``marks`` (source, day) names times whose readings, and the next ones, are
    excused from the ratio rule, as are rows with ``exempt`` and times at which
    most sources move alike.

    A null or NaN reading, and one without source or time, is never flagged.
    Infinite readings count as readings out of proportion. Repeated deliveries of
    a time are judged each by its own value, but only the first can be stuck.
    Empty input gives no rows. Other columns of ``readings`` are ignored.
    """
    rows = readings.select(
        source.cast("long").alias("source"), F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), F.nanvl(value.cast("double"), F.lit(None)).alias("value"),
        order.cast("long").alias("order"), F.coalesce(impossible, F.lit(False)).alias("impossible"), F.coalesce(exempt, F.lit(False)).alias("exempt"),
    ).filter("source is not null and day is not null and value is not null")
    size = F.abs("value") if not rule.two_sided else F.col("value")
    observed = rows.select("source", "day", "value", "order", size.alias("size"), F.lit(0).alias("mark"))
    if marks is not None:
        none = F.lit(None).cast("double")
        marked = marks.select(
            F.col("source").cast("long").alias("source"), F.datediff(F.col("day").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"),
            none.alias("value"), F.lit(None).cast("long").alias("order"), none.alias("size"), F.lit(1).alias("mark"),
        ).filter("source is not null and day is not null")
        observed = observed.unionByName(marked)
    folded = observed.groupBy("source", "day").agg(
        F.min_by("value", "order").alias("first"), F.max_by("value", "order").alias("last"),
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("mark").alias("marked"), F.min("order").alias("head"),
    )
    found = staged(spike_findings(folded, rule))
    # days on which most sources move alike; the calendar bounds their number
    moved = found.filter(F.col("move") >= rule.market_ratio).groupBy("day").agg(F.count("*").alias("moved")).filter(F.col("moved") >= rule.market_least)
    totals = rows.select("source", "day").join(sized(moved), "day").groupBy("day").agg(F.countDistinct("source").alias("sources"), F.max("moved").alias("moved"))
    common = totals.filter(F.col("moved") > rule.market_share * F.col("sources")).select("day", F.lit(True).alias("common"))
    found = found.join(sized(common), "day", "left")
    found = found.withColumn("centre", F.nanvl("centre", F.lit(None)))  # NaN would exceed every reading
    judged = rows.join(sized(found), ["source", "day"], "left")
    at = F.col("value") if rule.two_sided else F.abs("value")
    out = at > rule.ratio * F.col("centre")
    if rule.two_sided:
        out = out | (at < F.col("centre") / rule.ratio)
    else:
        out = out & ~F.col("exempt") & ~F.col("excused") & F.col("common").isNull()
    return judged.select(
        "order", "impossible", F.coalesce(out, F.lit(False)).alias("spike"),
        F.coalesce(F.col("stuck_first") & (F.col("order") == F.col("head")), F.lit(False)).alias("stuck"), "innovation",
    ).filter("impossible or spike or stuck")
