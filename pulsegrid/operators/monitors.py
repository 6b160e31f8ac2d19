"""Data-health monitors over counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


DAY = 86_400


def _trailing(counts: DataFrame, key: str, seconds: int, own=F.sum, rest=F.sum, both=lambda x, y: F.coalesce(x + y, x, y), **sums: str) -> DataFrame:
    """``counts`` (key, t, ...) with sums, or another aggregate, over the trailing range of each row.

    Stretches of time are as long as ranges, so a range is the stretch up to its row and the end of the one before. Both
    are running aggregates, ``own`` and, from the latest row back, ``rest``: a step a row, however many rows a range has.
    Where a range begins is looked up among the rows of the stretch before; ``both`` puts the two together, null for none.
    """
    width = seconds + 1
    stretch = Window.partitionBy(key, "_stretch")
    up, down = stretch.orderBy("t"), stretch.orderBy(F.desc("t"))
    ends = F.struct(*[rest(F.col(c)).over(down).alias(to) for to, c in sums.items()])
    rows = counts.where("t is not null").withColumn("_stretch", F.floor(F.col("t") / width)).withColumns({f"_own_{to}": own(F.col(c)).over(up) for to, c in sums.items()} | {"_rest": ends})
    place = F.struct(F.col("_stretch").alias("_in"), F.col("t").alias("_at"), F.lit(False).alias("_asks"))
    start = F.struct((F.col("_stretch") - 1).alias("_in"), (F.col("t") - seconds).alias("_at"), F.lit(True).alias("_asks"))
    met = rows.withColumn("_p", F.explode(F.array(place, start))).select("*", "_p.*")
    back = Window.partitionBy(key, "_in").orderBy(F.desc("_at"))
    asked = met.withColumn("_before", F.last(F.when(~F.col("_asks"), F.col("_rest")), ignorenulls=True).over(back)).where("_asks")
    return asked.select(*counts.columns, *[both(F.col(f"_before.{to}"), F.col(f"_own_{to}")).alias(to) for to in sums])


def trailing_share(events: DataFrame, key: str, at: str, bad: str, seconds: int, limit: float) -> DataFrame:
    """For every second with events: the share of bad rows in the trailing range, and whether it is above the limit."""
    counts = events.groupBy(key, F.unix_timestamp(at).alias("t")).agg(F.count("*").alias("n"), F.count_if(bad).alias("m"))
    share = F.col("bad").cast("double") / F.col("all").cast("double")
    return _trailing(counts, key, seconds, bad="m", all="n").select(key, "t", share.alias("share")).withColumn("firing", F.col("share") > limit)


def _runs(states: DataFrame, flag: str, order: str, *by: str) -> DataFrame:
    """The runs of equal flags in order: flag, since, until. Where there is ``apart``, a state that has it begins a run in any case."""
    w = Window.partitionBy(*by).orderBy(order)
    breaks = F.coalesce(F.lag(flag).over(w) != F.col(flag), F.lit(True)) | (F.col("apart") if "apart" in states.columns else F.lit(False))
    numbered = states.withColumn("_s", F.when(breaks, 1).otherwise(0)).withColumn("_i", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*by, flag, "_i").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_i")


def runs(states: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """(key, flag, since, until): the longest stretches of equal flags of each key.

    A day is summarised by its runs. Those between its first and its last one are done; only these two can go on into the
    neighbouring days, so two rows a day and key are all that is merged over a key's history, however often a flag flips.
    """
    daily = states.select(key, flag, F.col(at).alias("since"), F.col(at).alias("until"), F.floor(F.col(at) / DAY).alias("_day"))
    found = _runs(daily, flag, "since", key, "_day")
    day = Window.partitionBy(key, "_day")
    placed = found.withColumns({"_first": F.min("since").over(day), "_last": F.max("since").over(day), "_n": F.count("*").over(day)})
    edge = (F.col("since") == F.col("_first")) | (F.col("since") == F.col("_last"))
    inner = placed.where(~edge).select(key, flag, "since", "until")
    # a day's last run doesn't go on from its first one where others lie between
    ends = placed.where(edge).select(key, flag, "since", "until", ((F.col("_n") > 2) & (F.col("since") == F.col("_last"))).alias("apart"))
    return _runs(ends, flag, "since", key).unionByName(inner)


def sustained(states: DataFrame, key: str, at: str, flag: str, seconds: int) -> DataFrame:
    """The stretches in which a flag holds without a break for at least so long."""
    held = runs(states, key, at, flag).where(flag)
    return held.where(F.col("until") - F.col("since") >= seconds).select(key, "since", "until")


def stale_sources(events: DataFrame, key: str, at: str, now, seconds: int) -> DataFrame:
    """Sources that have been seen last more than ``seconds`` ago, or never; ``rate`` counts what came a second since then."""
    seen = F.unix_timestamp(at)
    last = events.groupBy(key).agg(F.max(seen).alias("last_seen"), (F.count_if(seen > now - seconds) / float(seconds)).alias("rate"))
    return last.withColumn("stale", F.coalesce(F.lit(now) - F.col("last_seen") > seconds, F.lit(True)))


def trailing_count(events: DataFrame, key: str, at: str, bad, seconds: int, limit: int) -> DataFrame:
    """For every second with events: how many bad rows the trailing range has, and whether that is above the limit."""
    counts = events.groupBy(key, F.unix_timestamp(at).alias("t")).agg(F.count_if(bad).alias("m"))
    return _trailing(counts, key, seconds, n="m").select(key, "t", "n").withColumn("firing", F.col("n") > limit)


def _with_neighbour(samples: DataFrame, key: str, value: str, name: str, ahead: bool) -> DataFrame:
    """``samples`` (key, t, ...) with the value of the sample before (or after) each, of any distance.

    Windows are of a key and a day; the first (last) sample of each day looks at a table of a row a day.
    """
    dealt = samples.withColumn("_day", F.floor(F.col("t") / DAY))
    end = F.min_by(value, "t") if ahead else F.max_by(value, "t")
    days, inside = Window.partitionBy(key).orderBy("_day"), Window.partitionBy(key, "_day").orderBy("t")
    look = F.lead if ahead else F.lag
    carried = dealt.groupBy(key, "_day").agg(end.alias("_end")).withColumn("_carried", look("_end").over(days)).select(F.col(key).alias("_key"), F.col("_day").alias("_of"), "_carried")
    joined = dealt.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_day") == F.col("_of")))
    return joined.withColumn(name, F.coalesce(look(value).over(inside), "_carried")).drop("_day", "_key", "_of", "_carried")


def increments(counters: DataFrame, key: str, value: str) -> DataFrame:
    """``counters`` (key, t, a cumulative count) with ``increment`` since the sample before.

    A count that is less than before has been reset and counts from 0 again. A first sample tells of no increment.
    """
    before = _with_neighbour(counters, key, value, "_before", ahead=False)
    return before.withColumn("increment", F.when(F.col("_before").isNull(), 0).when(F.col(value) < F.col("_before"), F.col(value)).otherwise(F.col(value) - F.col("_before"))).drop("_before")


def increase(counters: DataFrame, key: str, value: str, seconds: int) -> DataFrame:
    """(key, t, increase, rate): what a counter counted in the trailing range of each sample, resets or not, and that a second.

    The range is (t - seconds, t]. Counts are as they are, not stretched to the ends of the range.
    """
    found = _trailing(increments(counters, key, value), key, seconds - 1, increase="increment")
    return found.select(key, "t", "increase", (F.col("increase") / float(seconds)).alias("rate"))


def delta(gauges: DataFrame, key: str, value: str, seconds: int) -> DataFrame:
    """(key, t, delta): how much a gauge has changed over the samples in the trailing range of each; changes may be negative."""
    sample = gauges.withColumn("_sample", F.struct(value))  # a sample without a value is one, too
    found = _trailing(sample, key, seconds - 1, F.first, F.last, F.coalesce, _first="_sample")
    return found.select(key, "t", (F.col(value) - F.col(f"_first.{value}")).alias("delta"))


def evaluated(samples: DataFrame, key: str, value: str, step: int, look_back: int, until: int) -> DataFrame:
    """(key, t, value, absent): the samples (key, t, value) as they are seen at each multiple of ``step`` from a key's first one to ``until``.

    What is seen is the last sample, unless it is ``look_back`` old; from then on to the next one the value is absent. So
    a condition can hold, and a source can be missed, at times at which nothing comes.
    """
    after = _with_neighbour(samples.where(F.col("t") <= until).select(key, "t", value), key, "t", "_next", ahead=True)
    first = F.ceil(F.col("t") / step) * step
    last = F.floor((F.coalesce(F.col("_next") - 1, F.lit(until))) / step) * step
    points = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))
    seen = after.select(key, F.col("t").alias("_at"), value, F.explode(points).alias("t"))
    absent = F.col("t") - F.col("_at") >= look_back
    return seen.select(key, "t", F.when(~absent, F.col(value)).alias(value), absent.alias("absent"))


def alert_states(points: DataFrame, key: str, condition, hold: int, step: int) -> DataFrame:
    """(key, pending_at, firing_at, resolved_at): the alerts of a condition over the points of an evaluation (key, t, ...).

    An alert is pending from the first point at which the condition holds, firing from the first one at which it has held for
    ``hold``, and resolved at the first one at which it doesn't. ``firing_at`` is null for one that never fired,
    ``resolved_at`` for one that still is. A condition that is null doesn't hold.
    """
    states = points.select(key, "t", F.coalesce(condition, F.lit(False)).alias("_holds"))
    ends = states.groupBy(F.col(key).alias("_key")).agg(F.max("t").alias("_end"))
    found = runs(states, key, "t", "_holds").where("_holds").join(ends, F.col(key).eqNullSafe(F.col("_key")))
    fires = F.ceil((F.col("since") + hold) / step) * step
    return found.select(key, F.col("since").alias("pending_at"), F.when(fires <= F.col("until"), fires).alias("firing_at"), F.when(F.col("until") < F.col("_end"), F.col("until") + step).alias("resolved_at"))


def held_alerts(shares: DataFrame, key: str, hold: int, step: int, until: int, look_back: int = 300) -> DataFrame:
    """The alerts of a share or count that is firing at each point of an evaluation for ``hold`` without a break."""
    return alert_states(evaluated(shares.select(key, "t", "firing"), key, "firing", step, look_back, until), key, F.col("firing"), hold, step)


def inactive_queries(progress: DataFrame, until: int, step: int, look_back: int, hold: int) -> DataFrame:
    """The alerts of streaming queries (name, at) of which no batch has been seen for ``look_back``, found between batches."""
    batches = progress.groupBy("name", F.unix_timestamp("at").alias("t")).agg(F.count("*").alias("batches"))
    return alert_states(evaluated(batches, "name", "batches", step, look_back, until), "name", F.col("absent"), hold, step)
