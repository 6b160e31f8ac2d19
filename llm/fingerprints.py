"""Operator 5: document fingerprints.

A bottom-k sketch of the hashes of a text's word shingles: the k smallest distinct hashes. Sketches of parts merge into
the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles. Everything is an
expression over built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import positions, table, words

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
NO_ID = -(1 << 63)  # stands for a null id
_ALL = 1 << 30  # slice() overflows beyond


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the shingles of ``width`` words; fewer words make one shingle, none an empty array."""

    def paired(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))

    # a shingle's hash is made of its words' hashes, over arrays of doubling span
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def combined(h: Column) -> Column:
        done, span = h, 1
        while span * 2 <= width:
            done, span = paired(done, F.slice(done, span + 1, _ALL)), span * 2
        while span < width:
            done, span = paired(done, F.slice(h, span + 1, _ALL)), span + 1
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) < width, whole).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0))))

    # binding the array once keeps it from being computed for every use
    return F.flatten(F.transform(F.array(hashes), combined))


def bottom_k(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    """The k smallest distinct hashes, of which the upper 32 bits are kept."""
    return F.transform(F.slice(F.sort_array(F.array_distinct(hashes)), 1, k), lambda h: F.shiftright(h, 32).cast("int"))


def sketch(text: Column, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> Column:
    """The bottom-k sketch of a text; null counts as the empty text, whose sketch is empty."""
    return bottom_k(shingle_hashes(text, width), k)


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def compared(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """What two sketches say of their union: ``union``, its sketch, and ``both``, how many of its hashes are in either one.

    Kept as a column, it gives the estimates of resemblance and containment without another comparison.
    """
    union = merged(a, b, k)
    return F.struct(union.alias("union"), F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double").alias("both"))


def _resemblance(pair: Column) -> Column:
    n = F.size(pair["union"])
    return F.when(n == 0, F.lit(1.0)).otherwise(pair["both"] / F.greatest(n, F.lit(1)).cast("double"))


def _containment(pair: Column, a: Column, k: int = SKETCH_SIZE) -> Column:
    shared = _resemblance(pair) * distinct_shingles(pair["union"], k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The estimated Jaccard similarity of two sketches; 1 for two empty ones."""
    return _resemblance(compared(a, b, k))


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + float(1 << 31)) / float(1 << 32)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / spread)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The estimated share of a's shingles that b has; 1 for an empty a."""
    return _containment(compared(a, b, k), a, k)


def as_string(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), " ")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, and of the text with its last third replaced by the start of the next document.

    Next: in descending doc_id, null ids last, rows of one id by text hash; after the last, the first. Null texts count
    as empty. Rows with equal id and text are one document in that order, and each of them gets its result. A single
    document is its own next. An empty table gives no rows. Other columns of ``docs`` are neither read nor returned. A
    very long text is sketched whole, inside its row. ``contained_*`` is the share of the text's shingles that the edited
    or the next one has, and ``distinct_shingles`` how many it has, both as the sketches estimate them.

    The order comes from a distributed sort of narrow rows. Texts are shuffled once, by id; both joins use that
    shuffle, which carries their sketches, and what travels to the preceding document is the piece that it needs and a
    sketch of fixed size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.col("doc_id").isNull()
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(none, text).alias("hash"), none.alias("none"), text.alias("text"))
    whole = named.select("id", "hash", "text", sketch(F.col("text")).alias("own"))
    narrow = named.select("id", "hash", "none", F.char_length("text").alias("n"))
    ordered = positions(narrow.distinct(), F.col("none").asc(), F.col("id").desc(), F.col("hash").asc()).drop("none")
    total = ordered.count()
    repeated = docs.select("doc_id").count() > total
    texts = whole.dropDuplicates(["id", "hash"]) if repeated else whole

    ahead = ordered.select(F.col("id").alias("to_id"), F.col("hash").alias("to_hash"), F.floor(F.col("n") / 3).cast("int").alias("need"), F.expr(f"(position + 1) % {max(total, 1)}L").alias("position"))
    wanted = ordered.select("id", "hash", "position").join(ahead, "position").drop("position")
    pieces = texts.join(wanted, ["id", "hash"]).select(
        F.col("to_id").alias("id"), F.col("to_hash").alias("hash"), F.expr("substring(text, 1, need)").alias("piece"), F.col("own").alias("next_sketch")
    )
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 3)"), F.col("piece"))
    joined = texts.join(pieces, ["id", "hash"]).select("id", "hash", n.cast("long").alias("n_chars"), "own", edited.alias("edited"), "next_sketch")
    done = joined.select("*", sketch(F.col("edited")).alias("changed"))
    own, edits, nexts = F.col("own"), F.col("edits"), F.col("nexts")
    done = done.select("*", compared(own, F.col("changed")).alias("edits"), compared(own, F.col("next_sketch")).alias("nexts"))
    result = done.select(
        "id",
        "hash",
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("changed")).alias("edited_fingerprint"),
        _resemblance(edits).alias("near_edited"),
        _resemblance(nexts).alias("near_next"),
        _containment(edits, own).alias("contained_edited"),
        _containment(nexts, own).alias("contained_next"),
        distinct_shingles(own).alias("distinct_shingles"),
    )
    if repeated:
        result = whole.select("id", "hash").join(result, ["id", "hash"])
    return result.drop("id", "hash")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
