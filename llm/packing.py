"""Operator 13: pack documents into sequences of a fixed width whose sources keep their target proportions.

Every source is a queue of its documents' tokens. Deficit round-robin fills one window after the other: a queue is
owed its share of each window, gets the whole tokens that it is owed, and what is left over in a window goes to those
owed most; what a queue is still owed, or has had too much, is carried to the next window. As all tokens are packed,
a queue's target proportion is its share of all tokens, and all queues end together.

Windows are dealt in blocks that are independent of each other: how much of every queue precedes a block has a closed
form, the proportional order in which token i of a queue of t stands at (i + 1/2) / t. So deficits are carried over
block borders without a task waiting for another, and each task deals only the blocks that its documents meet.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from fractions import Fraction
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table

WIDTH = 1024
#: The id that ends every document.
END = 0
#: Windows of a block.
BLOCK = 256
#: Up to so many sources are a queue each; more are dealt to so many queues by their hash, so that a window's state stays small.
QUEUES = 4096
#: Up to so many (task, source) pairs their starts are broadcast; they are counted first.
BROADCAST_STARTS = 200_000
#: A Python worker keeps the units of text that it met last, at least so many and at most twice as many.
REMEMBERED = 1 << 19
#: Characters of text that are encoded at a time.
GROUP = 1 << 22
Path = str | Callable[[], str]
#: What the tokenizer's pattern takes for white space.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: White space and what follows it up to the next. The pattern ends a match before white space that follows other
#: characters, so these units have the ids in a text that they have alone.
_UNIT = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: A text without any of these, in which white space is single spaces and line ends between other characters, is cut by split().
_OTHER_ASCII, _OTHER = "\t\x0b\x0c\r", "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_PAIRS = ("  ", "\n\n", " \n", "\n ")


class Units:
    """The packed ids of the units met last, each encoded once; ``text`` tells what a unit stands for."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], text: Callable[[str], str] = str):
        self.encode, self.text = encode, text
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, units: list[str]) -> list[bytes]:
        """The packed ids of different units."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        if missing := [unit for unit in units if unit not in young]:
            new = [unit for unit in missing if unit not in old]
            young.update((unit, old[unit]) for unit in missing if unit in old)
            young.update(zip(new, self.encode([self.text(unit) for unit in new])))
        return [young[unit] for unit in units]

    def joined(self, lists: pa.ListArray, skip: int = 0) -> list[bytes]:
        """The packed ids of each list of units, but for its first ``skip`` units; each different unit is looked up once."""
        found = lists.flatten().dictionary_encode()
        ids = pa.array(self(found.dictionary.to_pylist()), pa.large_binary()).take(found.indices)
        if not len(ids):
            return [b""] * len(lists)
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), memoryview(ids.buffers()[2])
        bounds = lists.offsets.to_numpy()
        return [bytes(raw[a:b]) for a, b in zip(ends[np.minimum(bounds[:-1] + skip, bounds[1:])].tolist(), ends[bounds[1:]].tolist())]


class Encoder:
    """Ids of whole texts by a tokenizer's file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # a token of a byte-level vocabulary has a character for each of its bytes
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.spaced = Units(self._encode, lambda unit: unit if unit[:1] == "\n" else " " + unit)
        self.units = Units(self._encode)

    def _encode(self, units: list[str]) -> list[bytes]:
        """The ids of units that begin with white space are found in strings of 64 of them, for less work; the others' alone."""
        alone = [i for i, u in enumerate(units) if u[0] not in " \n" or u[-1] in " \n"]
        long = sorted(set(range(len(units))).difference(alone))
        out: list[bytes] = [b""] * len(units)
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            for i, found in zip(some, self.tokenizer.encode_batch_fast([units[i] for i in some], add_special_tokens=False)):
                out[i] = np.array(found.ids, self.kind).tobytes()
        for at in range(0, len(long), 4096):
            some = long[at : at + 4096]
            strings = ["".join(units[i] for i in some[k : k + 64]) for k in range(0, len(some), 64)]
            ids = np.concatenate([np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)])
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(units[i].encode()) for i in some])) + 1
            raw, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            for i, a, b in zip(some, [0, *ends], ends):
                out[i] = raw[a:b]
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        plain = [bool(t) and not t[0].isspace() and not any(x in t for x in _PAIRS) and not any(x in t for x in _OTHER_ASCII) and (t.isascii() or not any(x in t for x in _OTHER)) for t in texts]
        # Line ends become units' first characters. The first unit of a text is like that of a line, without the line end's
        # id; before it is an empty unit.
        lines = pa.array([("\n" + t).replace("\n", " \n") for t, p in zip(texts, plain) if p], pa.string())
        fast = iter(self.spaced.joined(pc.split_pattern(lines, " "), 1))
        slow = iter(self.units.joined(pa.array([_UNIT.findall(t) for t, p in zip(texts, plain) if not p], pa.list_(pa.string()))))
        return [next(fast)[self.kind.itemsize :] if p else next(slow) for p in plain]

    def _parts(self, text: str) -> Iterator[str]:
        """A long text, cut before white space that follows other characters."""
        at = 0
        for found in re.finditer(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])", text):
            if found.start() - at >= GROUP:
                yield text[at : found.start()]
                at = found.start()
        yield text[at:]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of each text, in order; texts are taken in groups, very long ones in parts."""
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._group(group)
                group, size = [], 0
                yield b"".join(self._group([part])[0] for part in self._parts(text))
                continue
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a Python worker."""
    return Encoder(path)


def tokenised(docs: DataFrame, path: Path) -> DataFrame:
    """doc_id, source, part, within, n, ids: each document's packed ids with the closing one, and their number.

    ``part`` is the task that encoded it and ``within`` the ids of its source that this task saw before it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path() if callable(path) else path)
        end, part = np.array([END], own.kind).tobytes(), TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                sources = rows.column("source").to_pylist()
                ids = [x + end for x in own.encode_all(t or "" for t in rows.column("text").to_pylist())]
                sizes = [len(x) // own.kind.itemsize for x in ids]
                within = []
                for source, n in zip(sources, sizes):
                    within.append(before.get(source, 0))
                    before[source] = within[-1] + n
                columns = [rows.column("doc_id"), rows.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(within, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "part", "within", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, f"doc_id {kind}, source string, part int, within long, n long, ids binary")


class Plan:
    """Which tokens of each queue stand in which window.

    Windows of ``width`` are filled whole; the rest after the last one goes to windows of falling powers of two, as
    these need no padding.
    """

    def __init__(self, totals: Sequence[int], width: int = WIDTH, block: int = BLOCK):
        self.totals, self.total, self.width, self.block = list(totals), sum(totals), width, block
        rest = self.total % width
        self.tail = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        self.whole = self.total // width
        self.windows = self.whole + len(self.tail)
        self.before = lru_cache(maxsize=256)(self._before)
        self.dealt = lru_cache(maxsize=64)(self._dealt)

    def capacity(self, window: int) -> int:
        """Tokens before a window."""
        over = max(0, min(window, self.windows) - self.whole)
        return min(window, self.whole) * self.width + sum(self.tail[:over])

    def _before(self, block: int) -> np.ndarray:
        """Tokens of each queue before a block: those that come first in the proportional order, queues in turn at ties."""
        n, total = self.capacity(block * self.block), self.total
        # token i of t comes before n / total if (2 i + 1) total < 2 n t
        taken = [(2 * n * t + total - 1) // (2 * total) for t in self.totals]
        short = n - sum(taken)
        if short > 0:
            key = lambda q: (Fraction(2 * taken[q] + 1, 2 * self.totals[q]), q)
            queue = [key(q) for q, t in enumerate(self.totals) if taken[q] < t]
            heapq.heapify(queue)
            for _ in range(short):
                q = heapq.heappop(queue)[1]
                taken[q] += 1
                if taken[q] < self.totals[q]:
                    heapq.heappush(queue, key(q))
        elif short < 0:
            key = lambda q: (-Fraction(2 * taken[q] - 1, 2 * self.totals[q]), -q)
            queue = [key(q) for q in range(len(taken)) if taken[q]]
            heapq.heapify(queue)
            for _ in range(-short):
                q = -heapq.heappop(queue)[1]
                taken[q] -= 1
                if taken[q]:
                    heapq.heappush(queue, key(q))
        return np.array(taken, np.int64)

    def _dealt(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """By queue and window of a block: the queue's tokens before the window, with the end of the last one, and its offset there."""
        first = block * self.block
        sizes = [self.capacity(w + 1) - self.capacity(w) for w in range(first, min(first + self.block, self.windows))]
        start, all_sizes = self.before(block), sum(sizes)
        left = self.before(block + 1) - start
        quantum, owed = left.copy(), np.zeros(len(left), np.int64)  # owed tokens are counted in units of 1 / all_sizes
        served = np.zeros((len(sizes), len(left)), np.int64)
        for w, size in enumerate(sizes):
            owed += quantum * size
            give = np.minimum(np.maximum(owed, 0) // all_sizes, left)
            if (free := size - int(give.sum())) < 0:  # the window is full before all are served
                order = np.argsort(-owed, kind="stable")
                filled = np.minimum(np.cumsum(give[order]), size)
                give[order] = np.diff(filled, prepend=0)
            while free > 0:
                open_ = np.flatnonzero(give < left)
                most = open_[np.argsort(give[open_] * all_sizes - owed[open_], kind="stable")][:free]
                give[most] += 1
                free -= len(most)
            owed -= give * all_sizes
            left -= give
            served[w] = give
        bounds = start + np.concatenate([np.zeros((1, len(left)), np.int64), np.cumsum(served, axis=0)])
        return np.ascontiguousarray(bounds.T), np.ascontiguousarray((np.cumsum(served, axis=1) - served).T)

    def windows_of(self, queue: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that take tokens ``start`` to ``end`` of a queue: the first token, its offset there, and the window.

        A window that takes none has the first token of the next one.
        """
        block = min(start * self.total // (self.totals[queue] * self.width * self.block), (self.windows - 1) // self.block)
        while self.before(block)[queue] > start:
            block -= 1
        while self.before(block + 1)[queue] <= start:
            block += 1
        found, at = [], start
        while at < end:
            bounds, offsets = (x[queue] for x in self.dealt(block))
            found.append((bounds[:-1], offsets, block * self.block + np.arange(len(offsets))))
            at, block = int(bounds[-1]), block + 1
        return tuple(np.concatenate(x) for x in zip(*found))

    def pieces(self, queue: int, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of documents that follow each other in a queue, up to ``end``: each piece's first token, its document, length, window and offset there."""
        first, offsets, windows = self.windows_of(queue, int(starts[0]), end)
        cuts = np.unique(np.concatenate((starts, first[(first > starts[0]) & (first < end)])))
        at = np.searchsorted(first, cuts, "right") - 1
        return cuts, np.searchsorted(starts, cuts, "right") - 1, np.diff(cuts, append=end), windows[at], offsets[at] + cuts - first[at]


def _runs(queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of documents that follow each other in a queue, in their order."""
    order = np.lexsort((first, queue))
    new = (np.diff(queue[order]) != 0) | (first[order][1:] != (first + n)[order][:-1])
    yield from np.split(order, np.flatnonzero(new) + 1)


def queues(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """(source, part, queue, first): each task's place in its source's queue, and the tokens of every queue.

    Sources by code point, null last, are a queue each; beyond QUEUES of them a queue holds the sources of a hash. There
    is a row for each task and source, narrow ones; nothing else comes to the driver than a total a queue.
    """
    sums = cut(rows.groupBy("source", "part").agg(F.sum("n").alias("n")))
    sources = sums.groupBy("source").agg(F.sum("n").alias("n"))
    many = sources.limit(QUEUES + 1).count() > QUEUES
    if many:
        queue = F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("int")
        numbered = sums.withColumn("queue", queue)
    else:
        rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("queue")  # at most QUEUES rows
        of = sources.select(F.col("source").alias("_source"), rank)
        numbered = sums.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(numbered.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))))
    totals = {r["queue"]: r["n"] for r in starts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    return starts.select("source", "part", "queue", "first"), [totals.get(q, 0) for q in range(max(totals, default=-1) + 1)]


def pack(docs: DataFrame, path: Path, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row a piece of a document.

    ``path`` is a tokenizer's file, on every machine, or a function that finds it there. A document is the ids of its
    whole text, none for null and empty ones, and END. Each id lies in one piece. Sequences before the last ones are
    full, the last ones are powers of two, so nothing is padded; a source has in every sequence its share of all ids
    but for fractions that are carried on. A null source is one of its own. Very long texts are encoded in parts and
    cut like others. Ids of any value, null ones and repeated rows are documents of their own. An empty table gives no
    rows. Other columns are not read. Which sequence a piece is in depends on how the table is split into tasks.
    """
    ship_code(docs.sparkSession)
    rows = cut(tokenised(docs, path))
    starts, totals = queues(rows.select("source", "part", "n"))
    few = starts.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS
    starts = starts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "queue", "first")
    placed = rows.join(F.broadcast(starts) if few else starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(totals, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                queue, first, n = (rows.column(c).to_numpy() for c in ("queue", "first", "n"))
                ids, found, sums = rows.column("ids"), [], []
                for run in _runs(queue, first, n):
                    cuts, document, length, window, offset = plan.pieces(int(queue[run[0]]), first[run], int(first[run[-1]] + n[run[-1]]))
                    raw = b"".join(ids[i].as_py() for i in run.tolist())
                    raw = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[run].sum() else "<u4").astype("<u4").tobytes())
                    edges = (4 * (np.append(cuts, cuts[-1] + length[-1]) - cuts[0])).tolist()
                    sums += [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])]
                    found.append((run[document], cuts - first[run][document], length, window, offset))
                row, start, length, window, offset = (np.concatenate(x) for x in zip(*found))
                columns = [rows.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(n[row]), pa.array(window), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = placed.select("doc_id", "queue", (F.col("first") + F.col("within")).alias("first"), "n", "ids")
    return narrow.mapInArrow(pieces, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "byte_bpe_50k.json"))
