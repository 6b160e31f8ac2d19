"""Operator 9: toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits in place of letters, punctuation to spaces) and scanned by an
Aho-Corasick automaton of lexicon entries, word beginnings or whole words with a weight each. Exception phrases of one
or two words cancel the entries in them. The summed weight and its share of the text's length give the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table
from llm.quality import held_out, training_rows

#: The bound on labelled documents that lexicon and score are fitted on; all are used if they are fewer.
TRAIN_ROWS = 20_000
#: An entry's log ratio of rates in toxic and clean texts, and the likelihood-ratio statistic G2 of the two, at least.
WEIGHT, SIGNIFICANT = 1.5, 24.0
#: Letters of the longest word beginning that is tried; longer words are tried whole.
LONGEST = 32
#: In so many clean texts an exception is at least.
EXCEPTION = 3
THRESHOLD = 0.3
#: Letters of other scripts and digits that stand for Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}


class _Folding(dict):
    """What each character becomes; filled as characters come up."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        if c in LOOK_ALIKES:
            out = LOOK_ALIKES[c]
        elif 0xFF01 <= code <= 0xFF5E:
            out = self[ord(chr(code - 0xFEE0).lower())]
        elif c.isalnum() or ord(c) > 0x2FF and not c.isspace() and not c.isprintable():
            out = code
        else:
            out = code if c.isalnum() else " "
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """The folded text between spaces; words are what spaces separate."""
    return f" {(text or '').lower().translate(_FOLDING)} "


def pair_evidence(rows: DataFrame) -> DataFrame:
    """(prev, word, toxic, clean): in how many toxic and clean training texts a word follows another, or none at the start."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    words = F.array_remove(F.split(F.col("folded"), " +"), "")
    pairs = F.array_distinct(F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda prev, word: F.concat(prev, F.lit(" "), word)))
    found = rows.select("label", folded("text").alias("folded")).select("label", F.explode(pairs).alias("pair")).where("pair is not null")
    counted = found.groupBy("pair").agg(F.count_if(F.expr("label = 1")).alias("toxic"), F.count_if(F.expr("label = 0")).alias("clean"))
    return counted.select(F.split_part("pair", F.lit(" "), F.lit(1)).alias("prev"), F.split_part("pair", F.lit(" "), F.lit(2)).alias("word"), "toxic", "clean")


def significance(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """G2 of t of ``toxic`` against c of ``clean``."""
    both, rest = t + c, toxic + clean - t - c

    def term(seen: Column, row: int, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen.cast("double") * (toxic + clean) / (float(row) * column))).otherwise(0.0)

    return 2 * (term(t, toxic, both) + term(toxic - t, toxic, rest) + term(c, clean, both) + term(clean - c, clean, rest))


def beginnings(word: str, longest: str) -> str:
    """SQL: the beginnings of a string that are shorter than it, up to LONGEST letters."""
    return f"transform(sequence(1, greatest(1, least({LONGEST}, {longest}))), n -> left({word}, n))"


def learn_lexicon(rows: DataFrame) -> tuple[list[tuple[str, float]], list[str]]:
    """Entries (pattern, weight) and exception phrases.

    What counts is after how many different words a word stands in toxic and in clean texts, so copies of a text tell
    nothing more. Of all beginnings of words, and whole words, those are entries that are significantly more frequent in
    toxic texts; of several on one line of beginnings the most significant, the longer one of equals. Words, and pairs of
    words, that hold an entry and are more frequent in clean texts are exceptions. Both are as many as the bounded
    training rows support.
    """
    pairs = cut(pair_evidence(rows))
    toxic, clean, toxic_texts, clean_texts = (float(x or 0) for x in pairs.agg(F.count_if(F.expr("toxic > 0")), F.count_if(F.expr("clean > 0")), F.sum("toxic"), F.sum("clean")).first())
    words = cut(pairs.groupBy("word").agg(F.count_if(F.expr("toxic > 0")).alias("t"), F.count_if(F.expr("clean > 0")).alias("c")))
    starts = words.select("t", "c", F.explode(F.expr(f"concat({beginnings('word', 'char_length(word)')}, array(concat(word, ' ')))")).alias("start")).groupBy("start").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    found = starts.select("start", weight.alias("weight"), significance(F.col("t"), F.col("c"), toxic, clean).alias("g")).where((F.col("weight") >= WEIGHT) & (F.col("g") >= SIGNIFICANT))
    found = cut(found)
    lines = found.select("start", "g", F.explode(F.expr(beginnings("start", "char_length(start) - 1"))).alias("begin")).where("begin <> start")
    lines = lines.join(found.select(F.col("start").alias("begin"), F.col("g").alias("begin_g")), "begin")
    beaten = lines.select(F.when(F.col("begin_g") > F.col("g"), F.col("start")).otherwise(F.col("begin")).alias("start"))
    entries = cut(found.join(beaten, "start", "left_anti").select("start", "weight"))

    whole = words.select("word", "t", "c", F.explode(F.expr(f"concat({beginnings('word', 'char_length(word)')}, array(concat(word, ' ')))")).alias("start"))
    held = cut(whole.join(entries, "start", "left_semi").select("word", "t", "c").distinct())
    benign = held.where((F.col("c") >= EXCEPTION) & (F.col("c") * toxic > F.col("t") * clean)).select("word")
    open_ = held.join(benign, "word", "left_anti").select("word")
    mild = pairs.where((F.col("clean") >= EXCEPTION) & (F.col("clean") * toxic_texts > F.col("toxic") * clean_texts) & (F.col("prev") != ""))
    phrases = mild.join(open_, "word", "left_semi").unionByName(mild.join(open_.withColumnRenamed("word", "prev"), "prev", "left_semi").select(*mild.columns)).select(F.concat_ws(" ", "prev", "word").alias("word")).distinct()
    exceptions = sorted(f" {r['word']} " for r in benign.unionByName(phrases).collect())
    return sorted((f" {r['start']}", r["weight"]) for r in entries.collect()), exceptions


def automaton(entries: Sequence[tuple[str, float]], exceptions: Sequence[str]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for phrase in exceptions:
        built.add_word(phrase, (len(phrase), 0.0, [i for i, c in enumerate(phrase[:-1]) if c == " "]))
    for pattern, weight in entries:
        if pattern not in built:
            built.add_word(pattern, (len(pattern), weight, None))
    built.make_automaton()
    return built


def evidence(text: str | None, built) -> tuple[float, float]:
    """The log of one plus the summed weight of a text's entries, and of one plus that weight for a thousand characters."""
    folded = fold(text)
    hits: dict[int, float] = {}
    excused = set()
    if len(built):
        for end, (length, weight, begins) in built.iter(folded):
            start = end - length + 1
            if begins is None:
                hits[start] = max(weight, hits.get(start, 0.0))
            else:  # an exception: entries that begin at its words don't count
                excused.update(start + i for i in begins)
    total = sum(w for at, w in hits.items() if at not in excused)
    return float(np.log1p(total)), float(np.log1p(1000 * total / len(folded)))


def fit_score(features: np.ndarray, labels: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps on two features and a bias."""
    x = np.column_stack((features, np.ones(len(features))))
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (p - labels) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def measured(text: Column, entries, exceptions) -> Column:
    """The two features of a column of texts, as a struct."""

    @F.pandas_udf("struct<sum: double, share: double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        built = automaton(entries, exceptions)
        for batch in batches:
            yield pd.DataFrame([evidence(t, built) for t in batch], columns=["sum", "share"], dtype=float)

    return features(text)


def classified(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Lexicon and score are fitted on labelled texts that aren't held out; labels, ids, languages and sources are no
    inputs of a score. Null texts score as empty ones, a null id is not held out, repeated rows repeat, an empty table
    gives no rows, and without toxic training rows the lexicon is empty. Very long texts are scanned whole, in time in
    proportion to their length. Other columns are neither read nor returned.
    """
    ship_code(docs.sparkSession)
    apart = held_out(4, 2)
    rows = training_rows(docs, labels, "toxic", apart, bound)
    entries, exceptions = learn_lexicon(rows) if not rows.where("label = 1").isEmpty() else ([], [])
    sample = rows.select(measured(F.col("text"), entries, exceptions).alias("f"), "label").select("f.sum", "f.share", "label").collect()  # at most ``bound`` rows
    data = np.array([tuple(r) for r in sample], float).reshape(-1, 3)
    a, b, c = (float(w) for w in fit_score(data[:, :2], data[:, 2]))
    found = docs.select("doc_id", measured(F.col("text"), entries, exceptions).alias("f"))
    done = found.select("doc_id", apart.alias("held_out"), (1 / (1 + F.exp(-(a * F.col("f.sum") + b * F.col("f.share") + c)))).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
