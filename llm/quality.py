"""Operator 2: a quality classifier.

Logistic regression over hashed word n-grams, trained with follow-the-regularised-leader (FTRL-proximal) updates and
scored as sparse dot products. The words of a text enter as they are and by their shape (upper and lower case, digits,
punctuation, with runs collapsed), both also as bigrams, and a word that repeats the one before it is a feature too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table

#: The bound on labelled documents that the model is fitted on; all are used if they are fewer.
TRAIN_ROWS = 8_000
DIMENSIONS = 1 << 18
SHARDS, EPOCHS = 4, 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.0
THRESHOLD = 0.3
#: Bytes of text that are turned into features at a time, a multiple of the powers below.
PART = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# the class of a byte in a word's shape; 0: no class of its own, as the bytes of other scripts
_CLASS = np.zeros(256, np.uint64)
_CLASS[33:127] = np.arange(33, 127)
for _from, _to in (("A", "Z"), ("a", "z"), ("0", "9")):
    _CLASS[ord(_from) : ord(_to) + 1] = ord(_from)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE_POWERS, _RUN_POWERS = _powers(0x100000001B3, 1 << 12), _powers(0xD6E8FEB86659FD93, 1 << 10)


def _slots(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _ODD) >> np.uint64(64 - 18)).astype(np.int64)


def _spelled(inside: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (inside.astype(np.uint64) + np.uint64(1)) * _BYTE_POWERS[place & 0xFFF]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the bytes begins, the hash of its bytes and that of its shape."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(~space)
    first = np.concatenate(([0], np.cumsum(end - begin)[:-1]))
    word = np.repeat(np.arange(len(begin)), end - begin)
    spelled = np.add.reduceat(_spelled(data[inside], np.arange(len(inside)) - first[word]), first)
    kinds = _CLASS[data[inside]]
    # a run begins where a class follows another one or a word begins
    classed = np.flatnonzero(kinds)
    kinds, owner = kinds[classed], word[classed]
    run = np.ones(len(kinds), bool)
    run[1:] = (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
    kinds, owner = kinds[run], owner[run]
    shapes = np.zeros(len(begin), np.uint64)
    if len(kinds):
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        nth = np.arange(len(kinds)) - np.repeat(head, np.diff(np.append(head, len(kinds))))
        shapes[owner[head]] = np.add.reduceat(kinds * _RUN_POWERS[nth & 0x3FF], head)
    return begin, spelled, shapes


def long_word(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of a single word, as word_hashes has them, a part at a time."""
    spelled, shape, last, runs = np.zeros(1, np.uint64), np.zeros(1, np.uint64), 0, 0
    for at in range(0, len(raw), PART):
        data = np.frombuffer(raw[at : at + PART], np.uint8)
        spelled += _spelled(data, np.arange(len(data))).sum(dtype=np.uint64)
        kinds = _CLASS[data]
        kinds = kinds[kinds > 0]
        if len(kinds):
            starts = kinds[np.concatenate(([kinds[0] != last], kinds[1:] != kinds[:-1]))]
            shape += (starts * _RUN_POWERS[(runs + np.arange(len(starts))) & 0x3FF]).sum(dtype=np.uint64)
            last, runs = kinds[-1], runs + len(starts)
    return spelled, shape


def features(doc: np.ndarray, spelled: np.ndarray, shapes: np.ndarray, carried: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Text and slot of each feature of words in order; a ``carried`` first word counts in its pair alone."""
    new = slice(1 if carried else 0, None)
    pairs = np.flatnonzero(doc[1:] == doc[:-1])
    again = pairs[spelled[pairs] == spelled[pairs + 1]]
    two = lambda h: h[pairs] * np.uint64(0xC2B2AE3D27D4EB4F) + h[pairs + 1]
    texts = np.concatenate((doc[new], doc[new], doc[pairs], doc[again], doc[pairs]))
    slots = (_slots(spelled[new], 1), _slots(shapes[new], 2), _slots(two(shapes), 3), _slots(np.zeros(len(again), np.uint64), 4), _slots(two(spelled), 5))
    return texts, np.concatenate(slots)


def _next_space(raw: bytes, at: int) -> int:
    """The place of the first space from ``at`` on, or the end."""
    for start in range(at, len(raw), PART):
        found = np.flatnonzero(_SPACE[np.frombuffer(raw[start : start + PART], np.uint8)])
        if len(found):
            return start + int(found[0])
    return len(raw)


def _parts(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of a very long text's words, in order, cut between words; a word longer than a part is one of its own."""
    at = 0
    while at < len(raw):
        stop = min(at + PART, len(raw))
        if stop < len(raw):
            spaces = np.flatnonzero(_SPACE[np.frombuffer(raw[at:stop], np.uint8)])
            if not len(spaces):
                stop = _next_space(raw, stop)
                yield long_word(raw[at:stop])
                at = stop
                continue
            stop = at + int(spaces[-1]) + 1
        yield word_hashes(raw[at:stop])[1:]
        at = stop


def _counted(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The slots of a text's features, how often each is one, and the text's words. A text in parts has the features that it has whole."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    words = 0
    last = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    for spelled, shapes in _parts(raw):
        if len(spelled):
            both = np.concatenate((last[0], spelled)), np.concatenate((last[1], shapes))
            found.append(np.unique(features(np.zeros(len(both[0]), np.int8), *both, carried=len(last[0]) > 0)[1], return_counts=True))
            words += len(spelled)
            last = spelled[-1:], shapes[-1:]
        if len(found) > 1:  # one table for all parts so far
            slots, place = np.unique(np.concatenate([s for s, _ in found]), return_inverse=True)
            found = [(slots, np.bincount(place, np.concatenate([n for _, n in found])).astype(np.int64))]
    slots, counts = found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return slots, counts, words


def dot_products(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """The sum over each text's features of weight times share of the text's words; 0 without words."""
    total = np.zeros(len(texts))
    held: list[bytes] = []
    which: list[int] = []

    def score_held() -> None:
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        begin, spelled, shapes = word_hashes(b" ".join(held))
        doc = np.searchsorted(starts, begin, side="right") - 1
        owner, slots = features(doc, spelled, shapes)
        words = np.bincount(doc, minlength=len(held))
        total[which] = np.bincount(owner, weights[slots], minlength=len(held)) / np.maximum(words, 1)
        held.clear()
        which.clear()

    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > PART:
            slots, counts, words = _counted(raw)
            total[i] = weights[slots] @ counts / max(words, 1)
            continue
        held.append(raw)
        which.append(i)
        size += len(raw)
        if size >= PART:
            score_held()
            size = 0
    if held:
        score_held()
    return total


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    slots, counts, words = _counted(text.encode("utf-8", "surrogatepass"))
    return slots, counts / max(words, 1)


def ftrl(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by slot, the bias last."""
    rows = []
    for text in texts:
        slots, values = _vector(text)
        rows.append((np.append(slots, DIMENSIONS), np.append(values, 1.0)))
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[at])
            n[at] += gradient * gradient
            z[at] += gradient - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(slice(None))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of up to ``bound`` labelled documents that aren't held out: those with the least id hashes.

    The bounded sample is joined to the documents by broadcast. Rows without id or label don't train. Of several texts of
    one id the one with the least hash does, so that there are no more rows than labels were drawn.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label")).where(~held_out).distinct()
    chosen = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label"))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1)) == remainder


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", apart: Column | None = None, bound: int = TRAIN_ROWS) -> np.ndarray:
    """The weights: shards of the training rows are fitted in tasks of their own and averaged.

    What reaches the driver is at most one weight a dimension. Without a labelled row all weights are 0.
    """
    ship_code(docs.sparkSession)
    rows = training_rows(docs, labels, label, apart if apart is not None else held_out(5, 0), bound)
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(SHARDS)).cast("int"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label", "text"])
        rows = rows.sample(frac=1, random_state=5)
        w = ftrl(rows["text"].tolist(), rows["label"].tolist())
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "weight": w[at]})

    # by range, so that each shard is a task of its own
    fitted = sharded.repartitionByRange(SHARDS, "shard").groupBy("shard").applyInPandas(fit, "slot long, weight double")
    shards = sharded.select("shard").distinct().count()
    weights = np.zeros(DIMENSIONS + 1)
    for slot, weight in fitted.groupBy("slot").agg(F.sum("weight")).collect():  # at most DIMENSIONS + 1 rows
        weights[slot] = weight / max(shards, 1)
    return weights


def probability(text: Column, weights: np.ndarray) -> Column:
    """The probability of label 1 for the whole text of a column; null counts as empty."""
    small, bias = weights[:-1].astype(np.float32).tobytes(), float(weights[-1])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = np.frombuffer(small, np.float32).astype(np.float64)
        for batch in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(dot_products(batch.tolist(), own) + bias, -35, 35))))

    return scored(text)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A model of the documents alone: labels, ids, languages and sources are no inputs of a score. Null texts score as
    empty ones, a null id is not held out, repeated rows repeat, an empty table gives no rows. A very long text, or a
    text of one very long word, is read in parts and scores as it would whole. Other columns are neither read nor
    returned.
    """
    apart = held_out(5, 0)
    weights = train(docs, labels, apart=apart)
    done = docs.select("doc_id", probability(F.col("text"), weights).alias("score"))
    return done.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
