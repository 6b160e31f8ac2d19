"""Operator 6: delete later copies of repeated runs of lines.

Lines get ids; prefix doubling gives every suffix of a document's line sequence its rank by the first 1, 2, 4, ...
lines. Suffixes sorted by the last of these ranks are the suffix array; the ranks also tell the longest common prefix of
neighbours in it. Where that is shorter than a run, one interval of suffixes that share the run ends and the next
begins: these are the longest-common-prefix intervals. Of an interval the first occurrence stays, later copies go.

A run counts from ``min_words`` words. The shortest such runs from every line forward and from every line backward
together cover exactly the lines of all maximal repeated runs of that size, and have ``min_words`` lines at most; so
the number of doubling rounds is bounded, however long the copies are, and common prefixes are followed to the power of
two that the longest of these runs fits in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, range_numbered, released, table, word_count

MIN_WORDS = 50
_LAST = (1 << 63) - 1


def _identified(docs: DataFrame) -> DataFrame:
    """id and hash name a document; null ids come after all others."""
    doc_id = F.col("doc_id")
    return docs.withColumns({"id": F.coalesce(doc_id.cast("long"), F.lit(_LAST)), "hash": F.xxhash64(doc_id.isNull(), F.col("text").isNull(), F.col("text"))})


def _full_lines(text: Column) -> Column:
    """(at, line) of the lines that have a word."""
    numbered = F.transform(F.split(text, "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    return F.filter(numbered, lambda x: x["line"].rlike(r"\S"))


def _ranked(keys: DataFrame, *by: str, to: str) -> DataFrame:
    """Distinct keys with a rank ``to`` that follows their order, by a distributed sort."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(to, F.monotonically_increasing_id())


def _doubled(level: DataFrame, span: int) -> DataFrame:
    """``level`` with one more rank of each suffix, by twice as many lines; where a stretch ends, that comes before any line."""
    ahead = Window.partitionBy("id", "hash").orderBy("pos").rangeBetween(span, span)
    rank = F.element_at("ranks", -1)
    pairs = level.withColumn("rank", rank).withColumn("then", F.coalesce(F.first("rank").over(ahead), F.lit(-1)))
    ranked = _ranked(pairs.select("rank", "then").distinct(), "rank", "then", to="longer")
    return cut(pairs.join(ranked, ["rank", "then"]).select("id", "hash", "pos", F.array_append("ranks", F.col("longer")).alias("ranks")))


def _stretches(level: DataFrame, min_words: int) -> DataFrame:
    """``level`` with unbroken stretches of repeated lines: their name, first and last place, and sums of words.

    Only a stretch of ``min_words`` words can hold a repeated run; others go.
    """
    stretched = level.withColumn("stretch", F.col("pos") - F.row_number().over(Window.partitionBy("id", "hash").orderBy("pos")))
    stretch = Window.partitionBy("id", "hash", "stretch")
    summed = stretched.withColumns({"until": F.sum("words").over(stretch.orderBy("pos")), "all": F.sum("words").over(stretch)})
    ends = {"before": F.col("until") - F.col("words"), "last": F.max("pos").over(stretch), "first": F.min("pos").over(stretch)}
    return summed.where(F.col("all") >= min_words).withColumns(ends)


def _windows(stretches: DataFrame, min_words: int) -> DataFrame:
    """(pos, lines) of the shortest runs with ``min_words`` words from each line forward and from each line backward."""
    stretch = Window.partitionBy("id", "hash", "stretch")
    far = (Window.unboundedPreceding, -min_words)
    ends = stretches.withColumns({
        "next": F.min("pos").over(stretch.orderBy(F.col("before").desc()).rangeBetween(*far)),
        "prev": F.max("pos").over(stretch.orderBy("until").rangeBetween(*far)),
    })
    end = F.coalesce(F.col("next"), F.when(F.col("all") - F.col("before") >= min_words, F.col("last") + 1))
    start = F.coalesce(F.col("prev") + 1, F.when(F.col("until") >= min_words, F.col("first")))
    runs = F.array(F.struct(F.col("pos").alias("pos"), (end - F.col("pos")).alias("lines")), F.struct(start.alias("pos"), (F.col("pos") + 1 - start).alias("lines")))
    found = ends.select("id", "hash", F.explode(runs).alias("run")).select("id", "hash", "run.pos", "run.lines").where("lines is not null")
    return found.distinct()


def _agreeing(a: str, b: str, levels: Column | None = None) -> Column:
    """At how many levels two suffixes have the same rank, of the first so many; they differ at all longer ones."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.coalesce(F.aggregate(same if levels is None else F.slice(same, F.lit(1), levels), F.lit(0), lambda n, x: n + x), F.lit(0))


#: The lines of the longest level at which two suffixes agree.
_STEP = "if(agree > 0, shiftleft(1, agree - 1), 0)"


def _suffix_array(suffixes: DataFrame) -> DataFrame:
    """``suffixes`` in sorted order, (part, idx), each with the one before it: ``agree`` and its place p, null for the first.

    Equal ranks are told apart by place, so that a run that is everywhere is dealt to many parts. The last suffixes of the
    parts, a row a part, are broadcast.
    """
    numbered = range_numbered(suffixes.withColumn("rank", F.element_at("ranks", -1)), "rank", "id", "hash", "pos")
    own = F.struct("id", "hash", "pos", "ranks")
    order = Window.partitionBy("part").orderBy("idx")
    last = numbered.groupBy("part").agg(F.max_by(own, "idx").alias("p")).select("part", F.lag("p").over(Window.orderBy("part")).alias("edge"))
    placed = numbered.withColumn("p", F.lag(own).over(order)).join(F.broadcast(last), "part").withColumn("p", F.coalesce("p", "edge"))
    return cut(placed.withColumn("agree", _agreeing("ranks", "p.ranks")).select("part", "idx", "id", "hash", "pos", "left", "depths", "agree", F.expr(_STEP).alias("matched"), F.col("p.id").alias("p_id"), F.col("p.hash").alias("p_hash"), F.col("p.pos").alias("p_pos")))


def _common_prefixes(array: DataFrame, level: DataFrame, levels: int) -> DataFrame:
    """``array`` with ``lcp``: how many lines each suffix shares with the one before it.

    The largest power of two of lines that both share is passed over, then the next one behind it, as often as there are
    levels. A prefix is followed as far as it may reach the shortest run that starts there, and no further than the longest.
    """
    places = level.select("id", "hash", F.col("pos").alias("at"), F.col("ranks").alias("own"))
    theirs = level.select(F.col("id").alias("p_id"), F.col("hash").alias("p_hash"), F.col("pos").alias("p_at"), F.col("ranks").alias("other"))
    may = (F.expr("shiftleft(1, agree)") > F.array_min("depths")) & (F.col("matched") < F.col("left")) & F.col("agree").between(2, levels - 1)
    state = ["part", "idx", "id", "hash", "at", "p_id", "p_hash", "p_at", "matched", "agree"]
    going = cut(array.where(may).withColumns({"at": F.col("pos") + F.col("matched"), "p_at": F.col("p_pos") + F.col("matched")}).select(*state))
    ended = []
    while not going.isEmpty():
        met = going.withColumn("below", F.col("agree") - 1).join(places, ["id", "hash", "at"], "left").join(theirs, ["p_id", "p_hash", "p_at"], "left")
        more = met.withColumn("agree", _agreeing("own", "other", F.col("below")))
        more = cut(more.withColumns({c: F.col(c) + F.expr(_STEP) for c in ("at", "p_at", "matched")}).select(*state))
        ended.append(more.where("agree < 2").select("part", "idx", F.col("matched").alias("followed")))
        going = more.where("agree > 1")
    if ended:
        array = array.join(reduce(DataFrame.unionByName, ended), ["part", "idx"], "left").withColumn("matched", F.coalesce("followed", "matched"))
    return array.withColumn("lcp", F.least("matched", "left"))


def _intervals(array: DataFrame) -> DataFrame:
    """(id, hash, pos, lines, interval) of all runs: those of equal lines and interval are copies of each other.

    Intervals of a length are numbered in each part of the suffix array; what earlier parts have is added, a row a part and length.
    """
    runs = array.select("part", "idx", "id", "hash", "pos", F.explode("depths").alias("lines"), "lcp").withColumn("new", (F.col("lcp") < F.col("lines")).cast("long"))
    counted = runs.withColumn("nth", F.sum("new").over(Window.partitionBy("part", "lines").orderBy("idx")))
    before = Window.partitionBy("lines").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.groupBy("part", "lines").agg(F.sum("new").alias("new")).select("part", "lines", F.coalesce(F.sum("new").over(before), F.lit(0)).alias("carry"))
    return counted.join(carried, ["part", "lines"]).select("id", "hash", "pos", "lines", (F.col("carry") + F.col("nth")).alias("interval"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, gone): for each document that has them, the places of the lines, among those with a word, in later copies."""
    lines = _identified(docs).select("id", "hash", F.posexplode(_full_lines(F.col("text"))).alias("pos", "entry"))
    line = F.col("entry.line")
    lines = cut(lines.select("id", "hash", "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), word_count(line).cast("int").alias("words")))
    repeated = lines.groupBy("a", "b").count().where("count > 1").drop("count")
    first = lines.join(_ranked(repeated, "a", "b", to="rank"), ["a", "b"]).select("id", "hash", "pos", "words", "rank")
    # a row that is there twice is one document
    once = first.repartition("id", "hash").dropDuplicates(["id", "hash", "pos"])
    stretches = cut(_stretches(once, min_words))
    windows = cut(_windows(stretches, min_words))
    longest = windows.agg(F.max("lines")).first()[0] or 0

    level, span, levels = stretches.select("id", "hash", "pos", F.array("rank").alias("ranks")), 1, 1
    while span < longest:
        shorter, level = level, _doubled(level, span)
        if span > 1:
            released(shorter)
        span, levels = span * 2, levels + 1
    places = stretches.select("id", "hash", "pos", (F.col("last") + 1 - F.col("pos")).alias("left"))
    starts = windows.groupBy("id", "hash", "pos").agg(F.collect_set("lines").alias("depths"))
    suffixes = level.join(places, ["id", "hash", "pos"]).join(starts, ["id", "hash", "pos"])
    named = cut(_intervals(_common_prefixes(_suffix_array(suffixes), level, levels)))
    released(level if span > 1 else lines, windows)
    intervals = named.groupBy("lines", "interval").agg(F.min(F.struct("id", "hash", "pos")).alias("kept"), F.count("*").alias("n"))
    # written first: a join of two plain shuffles is one whose hot keys Spark splits
    later = named.join(cut(intervals.where("n > 1")), ["lines", "interval"]).where(F.struct("id", "hash", "pos") != F.col("kept"))
    gone = later.select("id", "hash", F.explode(F.expr("sequence(pos, pos + lines - 1)")).alias("pos"))
    return gone.groupBy("id", "hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _cleaned(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, all of a row's columns; text, what is left; lines, removed)."""
    named = _identified(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text"))
    joined = named.join(later_copies(docs, min_words), ["id", "hash"], "left")
    split = F.split("text", "\n")
    places = F.transform(F.col("gone"), lambda p: F.get(F.col("full"), p)["at"])
    found = joined.withColumn("full", F.when(F.col("gone").isNotNull(), _full_lines(F.col("text")))).withColumn("removed", F.coalesce(places, F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("removed"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    return found.withColumn("all", split).select("doc", left.alias("text"), F.size(F.coalesce("all", F.array())).cast("long").alias("lines"), "removed")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of runs of lines, with two more columns, ``_lines`` and ``_removed``.

    A run is a stretch of lines of one document, of ``min_words`` words or more, that occurs elsewhere in the corpus
    or in the document. Its copy with the least (doc_id, text hash, place) stays; null ids come last. Copies within a
    document may overlap: of a line that repeats on and on each run but the first goes, also the lines that it shares
    with the first, so fewer than ``min_words`` words of it may stay. Lines without a word are no part of a run and
    always stay. ``_lines`` counts the lines of a text and ``_removed`` lists the places of deleted ones from 0. Null
    texts stay null, and null and empty texts have nothing to delete. Very long texts are one row a line. Rows with equal
    id and text are one document and end alike. An empty table gives no rows; other columns stay as they are.
    """
    done = _cleaned(docs, min_words)
    columns = [F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    return done.select(*columns, F.col("lines").alias("_lines"), F.col("removed").alias("_removed"))


def remaining(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` as above in its own columns, with n_chars, if there, counted anew; a document of which no word is left goes."""
    done = _cleaned(docs, min_words).where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_lines").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.array_join("_removed", ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with base as (select doc_id, string_split(text, chr(10)) as ls from documents),
lines as (
  select doc_id, ix - 1 as ix, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w, row_number() over (partition by doc_id order by ix) as pos
  from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as ix from base)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
summed as (select *, sum(w) over (partition by doc_id order by pos) as until from lines),
dense as (select doc_id, list(line order by pos) as full_lines from lines group by 1),
forward as (
  select a.doc_id, a.pos, min(b.pos) as stop from summed a join summed b on a.doc_id = b.doc_id and b.pos >= a.pos and b.pos <= a.pos + 49
  where b.until - a.until + a.w >= 50 group by all),
backward as (
  select b.doc_id, max(a.pos) as pos, b.pos as stop from summed a join summed b on a.doc_id = b.doc_id and b.pos >= a.pos and b.pos <= a.pos + 49
  where b.until - a.until + a.w >= 50 group by b.doc_id, b.pos),
runs as (select doc_id, pos, stop from forward union select doc_id, pos, stop from backward),
named as (select r.*, md5(array_to_string(list_slice(full_lines, pos, stop), chr(10))) as name from runs r join dense using (doc_id)),
later as (select * from (select *, row_number() over (partition by name order by doc_id, pos) as nth from named) where nth > 1),
gone as (select distinct l.doc_id, l.ix from later x join lines l on l.doc_id = x.doc_id and l.pos between x.pos and x.stop),
removed as (select doc_id, list(ix order by ix) as removed from gone group by 1)
select b.doc_id, len(b.ls)::bigint as n_lines, coalesce(len(r.removed), 0)::bigint as n_removed,
  coalesce(array_to_string(r.removed, ','), '') as removed,
  sha256(array_to_string(list_filter(b.ls, lambda line, i: not coalesce(list_contains(r.removed, i - 1), false)), chr(10))) as kept_sha256
from base b left join removed r using (doc_id)
"""
