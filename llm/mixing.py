"""Operator 1: mix sources to target weights.

Weighted sampling without replacement after Efraimidis and Spirakis: each document draws the key ``-ln(u) / q``
with a uniform ``u`` hashed from seed, id and text and a quality weight ``q``; the documents of a source, sorted by
that key, are taken until their prefix-summed sizes fill the source's budget. Complete epochs of a source come first;
only the rest of its budget is filled by selection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, range_numbered, table, word_count

#: Up to so many sources their plan is broadcast; its size is counted first.
BROADCAST_SOURCES = 10_000


def quality(text: Column) -> Column:
    """A quality weight from 0.05 to 1: the mean length of a word, with its space, should be as in prose."""
    mean = F.length(text).cast("double") / word_count(text).cast("double")
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.lit(1.5) - F.abs(mean - 6.5) / 10.0))
    return F.when(word_count(text) > 0, weight).otherwise(F.lit(0.05))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """The exponential key; equal for repeated rows of one id and text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) with each source's ``target``.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share`` of all sizes by weight; no
    target passes ``limit`` times its source's size, and what is cut off goes to the others by weight, until none is
    above: the level at which the capped shares add up to the total. One row a source goes through one task; sources
    are the entries of a mixing plan, not data that grows with the documents.
    """
    everything = Window.partitionBy()
    ranked = sizes.select(
        "source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_rank")
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(float(limit)) * F.col("source_size").cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")), "_rank")
    levels = capped.withColumn("_total", F.lit(share) * F.sum(F.col("source_size").cast("double")).over(everything)).withColumn(
        "_level",
        (F.col("_total") - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    )
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_rank"), F.col("_level").alias("level")))
    return levels.withColumn("_at", F.min(fits).over(everything)["level"]).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_at"), F.col("_cap"))).alias("target")
    )


def _keyed(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    text = F.col("text")
    return docs.select("doc_id", "source", word_count(text).alias("size"), sampling_key(F.col("doc_id"), text, weight if weight is not None else quality(text), seed).alias("key"))


def _with_sources(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    plan = plan.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: int = 3, share: float = 1.0, seed: int = 0, weight: Column | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """The narrow rows (doc_id, source, size, key), the plan of each source, and whether the plan is small enough to broadcast.

    The plan has source, source_size, target, epochs, ``cutoff`` (documents with a key up to it are taken once more)
    and ``closer``, the key of one more document whose size fills the budget's rest best, if one makes it smaller.
    Texts are read once; the sort by (source, key) splits a hot source over range partitions, and prefix sums within
    a part are shifted by the sums of the parts before it.
    """
    rows = range_numbered(_keyed(docs, seed, weight), "source", "key", "doc_id")
    plan = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit, share)
    size = F.col("source_size").cast("double")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / size), F.lit(limit))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs").cast("double") * size)))
    few = plan.count() <= BROADCAST_SOURCES

    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "part").orderBy("idx")
    summed = rows.withColumn("_inside", F.sum("size").over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))
    )
    prefix = _with_sources(summed.select("source", "key", "doc_id", "size", (F.col("_start") + F.col("_inside")).alias("prefix")), plan, few)
    # Equal keys are repeated rows: they are taken together or not at all.
    ends = prefix.groupBy("source", "key").agg(F.max("prefix").alias("prefix"), F.first("rest").alias("rest"))
    cutoffs = ends.where("prefix <= rest").groupBy("source").agg(F.max("key").alias("cutoff"), F.max("prefix").alias("filled"))
    plan = plan.join(cutoffs.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c")
    plan = cut(plan.withColumn("gap", F.col("rest") - F.coalesce(F.col("filled"), F.lit(0)).cast("double")))

    left = _with_sources(rows.select("source", "key", "size"), plan.select("source", "cutoff", "gap"), few)
    left = left.where((F.col("gap") > 0) & (F.col("cutoff").isNull() | (F.col("key") > F.col("cutoff"))))
    best = left.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).groupBy("source").agg(
        F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), F.col("key"))).alias("best"), F.first("gap").alias("_gap")
    )
    closer = best.where(F.col("best.miss") < F.col("_gap")).select(F.col("source").alias("_c"), F.col("best.key").alias("closer"))
    plan = plan.join(closer, F.col("source").eqNullSafe(F.col("_c")), "left")
    return rows, cut(plan.select("source", "source_size", "target", "epochs", "cutoff", "closer")), few


def copies() -> Column:
    """How often the plan takes a document."""
    key = F.col("key")
    more = F.coalesce(key <= F.col("cutoff"), F.lit(False)) | F.coalesce(key == F.col("closer"), F.lit(False))
    return F.col("epochs") + F.when(more & (F.col("size") > 0), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: what the mix takes of every document, in words.

    Null texts and texts without words have size 0 and are taken 0 words. A null source is a source of its own, the
    last one. An empty table gives no rows. Rows with equal id and text share a key and are taken alike. Other columns
    of ``docs`` are neither read nor returned.
    """
    rows, plan, few = mixing_plan(docs, **options)
    return _with_sources(rows, plan, few).select("doc_id", "source", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 0, weight: Column | None = None, **options) -> DataFrame:
    """``docs``, each row as often as the mix takes it, with its own columns.

    The source plan decides, so texts aren't shuffled; a document without words is taken as often as its source has
    complete epochs.
    """
    _, plan, few = mixing_plan(docs, seed=seed, weight=weight, **options)
    text = F.col("text")
    key = sampling_key(F.col("doc_id"), text, weight if weight is not None else quality(text), seed)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "source", word_count(text).alias("size"), key.alias("key"))
    taken = _with_sources(whole, plan, few).select("_doc", copies().alias("_n")).where("_n > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_doc.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with base as (
  select doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
weighed as (
  select *, case when size > 0 then least(1.0::double, greatest(0.05::double, 1.5::double - abs(length(text)::double / size::double - 6.5::double) / 10.0::double)) else 0.05::double end as q
  from base),
keyed as (
  select doc_id, source, size,
    -ln((('0x' || substr(md5('0:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double) / q as key
  from weighed),
sizes as (select source, sum(size)::bigint as source_size from keyed group by 1),
ranked as (select *, row_number() over (order by source nulls last) - 1 as rnk from sizes),
capped as (select *, [5.0::double, 2.0::double, 1.0::double][rnk % 3 + 1] as w, 3.0::double * source_size::double as cap from ranked),
levels as (
  select *, (sum(source_size::double) over () - coalesce(sum(cap) over (order by cap / w, rnk rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, rnk rows between current row and unbounded following) as lvl from capped),
chosen as (select lvl from levels where lvl <= cap / w order by cap / w, rnk limit 1),
plan as (
  select source, source_size, least(cap, w * (select lvl from chosen)) as target,
    case when source_size > 0 then least(floor(least(cap, w * (select lvl from chosen)) / source_size::double), 3) else 0 end::bigint as epochs
  from levels),
rest as (select *, greatest(0.0::double, target - epochs::double * source_size::double) as rest from plan),
summed as (
  select k.*, r.source_size, r.target, r.epochs, r.rest, sum(size) over (partition by k.source order by key, doc_id rows unbounded preceding) as prefix
  from keyed k join rest r on k.source is not distinct from r.source),
flagged as (select *, prefix <= rest as inside, rest - coalesce(max(case when prefix <= rest then prefix end) over (partition by source), 0)::double as gap from summed),
best as (select source, arg_min(key, (abs(gap - size), key)) as key, min(abs(gap - size)) as miss, any_value(gap) as gap from flagged where not inside and gap > 0 group by 1)
select f.doc_id, f.size, f.source_size, f.target,
  (f.size * (f.epochs + case when f.size > 0 and (f.inside or (b.miss < b.gap and f.key = b.key)) then 1 else 0 end))::bigint as taken
from flagged f left join best b on f.source is not distinct from b.source
"""
