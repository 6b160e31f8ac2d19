"""Operator 8: byte-level BPE encoding and decoding.

The pieces of a batch of texts that aren't known yet are merged together, as one linked list with a stop between
pieces. A queue of merge ranks holds list positions: each rank has a bucket, a two-level bitmap marks the buckets
that hold any, and find-first-set yields the next rank. A bucket is merged at once over arrays, entries that an
earlier merge made stale are skipped, and new neighbours go to their buckets. Time is in proportion to the bytes,
for very long pieces too.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from llm.common import ship_code, table

#: A Python worker forgets the pieces that it knows when they are more than these.
REMEMBERED = 1 << 17
#: Characters of text that are cut into pieces at a time.
GROUP = 1 << 20
#: Rows of a batch that are in Python at a time.
ROWS = 1 << 9
Path = str | Callable[[], str]
#: Unicode white space, which the pattern's \s means.
_SPACE = r"\t-\r \x85\xa0  -     　"

#: Ranks under a word of the bitmap's lower level.
SPAN_BITS = 8
NONE = -1


class PairRanks:
    """The merged rank of two neighbouring tokens, looked up for arrays of them in an open-addressing table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = 20
        pairs, merged = array("q"), array("i")  # a pair is there once, as the token that it makes and its place in it tell
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left = ranks.get(token[:i])
                if left is not None and (right := ranks.get(token[i:])) is not None:
                    pairs.append(left << self.bits | right)
                    merged.append(rank)
        keys, values = np.array(pairs, np.int64), np.array(merged, np.int32)
        self.size_bits = max(4, int(len(pairs) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.size_bits, -1, np.int64), np.full(1 << self.size_bits, NONE, np.int32)
        slots = self._slot(keys)
        while len(keys):  # what finds its slot taken goes on to the next one
            free = self.keys[slots] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(slots, return_index=True)[1]] = True
            now = free & first
            self.keys[slots[now]], self.values[slots[now]] = keys[now], values[now]
            keys, values, slots = keys[~now], values[~now], (slots[~now] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.size_bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << self.bits | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap.

    The lower level is built only for the word of ranks that is being emptied; what comes in for another word waits
    in an inbox, which is dealt out by word when the present one is empty or a lower one comes up.
    """

    def __init__(self) -> None:
        self.top = 0  # the words that hold any
        self.word = NONE  # the word whose buckets are open
        self.marked = 0  # its ranks that hold any
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        self.inbox: list[tuple[np.ndarray, np.ndarray]] = []
        self.lowest = 1 << 60  # of the words in the inbox
        self.buckets: dict[int, list[np.ndarray]] = defaultdict(list)

    def push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        if not len(ranks):
            return
        own = ranks >> SPAN_BITS == self.word
        if own.any():
            self._open(ranks[own], at[own])
            ranks, at = ranks[~own], at[~own]
        if len(ranks):
            self.inbox.append((ranks, at))
            self.lowest = min(self.lowest, int(ranks.min()) >> SPAN_BITS)

    def _open(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for rank, part in zip(ranks[starts].tolist(), np.split(at, starts[1:])):
            self.buckets[rank].append(part)
            self.marked |= 1 << (rank & ((1 << SPAN_BITS) - 1))

    def _deal(self) -> None:
        if self.inbox:
            ranks, at = (np.concatenate(x) for x in zip(*self.inbox))
            self.inbox, self.lowest = [], 1 << 60
            words = (ranks >> SPAN_BITS).astype(np.int16)
            order = np.argsort(words, kind="stable")
            ranks, at, words = ranks[order], at[order], words[order]
            starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            for word, r, p in zip(words[starts].tolist(), np.split(ranks, starts[1:]), np.split(at, starts[1:])):
                self.waiting[word].append((r, p))
                self.top |= 1 << word

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The least rank and its positions in order, each once."""
        while not self.marked or self.lowest < self.word:
            if self.marked:  # a lower word comes first: close this one
                for rank, parts in self.buckets.items():
                    self.waiting[self.word] += [(np.full(len(x), rank, np.int32), x) for x in parts]
                self.top |= 1 << self.word
                self.buckets.clear()
                self.marked = 0
            self._deal()
            if not self.top:
                self.word = NONE
                return None
            self.word = (self.top & -self.top).bit_length() - 1
            self.top &= self.top - 1
            ranks, at = (np.concatenate(x) for x in zip(*self.waiting.pop(self.word)))
            self._open(ranks, at)
        low = (self.marked & -self.marked).bit_length() - 1
        self.marked &= self.marked - 1
        rank = self.word << SPAN_BITS | low
        return rank, np.unique(np.concatenate(self.buckets.pop(rank)))


class Encoding:
    """A vocabulary; packed ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pair_ranks = PairRanks(self.ranks)
        self.stop = (1 << self.pair_ranks.bits) - 1
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", rf"[{_SPACE}]").replace(r"\S", rf"[^{_SPACE}]"))
        self.known: dict[str, bytes] = {}

    def merged(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece, none of them empty."""
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes + 1) - 1
        token = self.bytes[raw]
        token[stops] = self.stop
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        alive[stops] = False
        pair = np.full(n, NONE, np.int32)
        pair[:-1] = self.pair_ranks(token[:-1], token[1:])
        queue = RankQueue()
        at = np.flatnonzero(pair >= 0)
        queue.push(pair[at], at)
        while (top := queue.pop()) is not None:
            rank, at = top
            at = at[pair[at] == rank]  # the others are stale
            if len(at) > 1:
                # Of overlapping pairs every second one is merged, from the left.
                follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if follows.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            end = after[gone]
            after[at], before[end] = end, at
            token[at], pair[gone], alive[gone] = rank, NONE, False
            left = before[at]
            has = left >= 0
            near, right = np.concatenate((at, left[has])), np.concatenate((end, at[has]))
            new = self.pair_ranks(token[near], token[right])
            pair[near] = new
            got = new >= 0
            queue.push(new[got], near[got])
        ids = token[alive].astype("<u4")
        return np.split(ids, np.cumsum(np.add.reduceat(alive, stops - sizes))[:-1])

    def _learn(self, pieces: Iterable[str]) -> None:
        whole, parts = {}, []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            else:
                whole[piece] = None
                parts.append(raw)
        if parts:
            self.known.update(zip(whole, (x.tobytes() for x in self.merged(parts))))

    def _packed(self, cut: list[list[str]]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if missing := set().union(*cut).difference(self.known):
            self._learn(missing)
        find = self.known.__getitem__
        return [b"".join(map(find, pieces)) for pieces in cut]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The packed ids of each text, in order. Texts are taken in groups, very long ones in parts."""
        group, size = [], 0
        for text in texts:
            if len(text) > GROUP:
                yield from self._packed([self.pattern.findall(x) for x in group])
                group, size = [], 0
                pieces = (m.group() for m in self.pattern.finditer(text))
                yield b"".join(self._packed([part])[0] for part in iter(lambda: list(islice(pieces, GROUP // 8)), []))
                continue
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._packed([self.pattern.findall(x) for x in group])
                group, size = [], 0
        yield from self._packed([self.pattern.findall(x) for x in group])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> Encoding:
    """One a Python worker."""
    return Encoding(path, pattern)


def _column(result: str, path: Path, pattern: str, each: Callable[[Encoding, pa.Array], list]):
    """A function of a column, by Arrow batches of a few rows at a time."""

    kind = to_arrow_type(StructType.fromDDL(f"x {result}")[0].dataType)

    @F.arrow_udf(result)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoding(path() if callable(path) else path, pattern)
        for batch in batches:
            parts = [pa.array(each(own, batch.slice(at, ROWS)), kind) for at in range(0, len(batch), ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return column


def _texts(batch: pa.Array) -> list[str]:
    return [t or "" for t in batch.to_pylist()]


def encoded(text: Column, path: Path, pattern: str) -> Column:
    """The packed ids of every whole text of a column, little-endian unsigned 32-bit integers; null counts as empty.

    ``path`` names the ranks (a token in base64 and its rank a line), a file on every machine, or is a function that
    finds it there; ``pattern`` cuts texts into pieces, which are merged separately. Special tokens are ordinary text.
    Empty texts have no ids. No other column is touched, and nothing is shuffled: texts are independent of each other.
    """
    return _column("binary", path, pattern, lambda own, batch: list(own.encode_all(_texts(batch))))(text)


def decoded(ids: Column, path: Path, pattern: str) -> Column:
    """The bytes that packed ids stand for; null counts as none."""
    return _column("binary", path, pattern, lambda own, batch: [own.decode(x or b"") for x in batch.to_pylist()])(ids)


def encoded_and_decoded(text: Column, path: Path, pattern: str) -> Column:
    """A struct of ``ids`` as ``encoded`` has them, and ``decoded_sha256``, the SHA-256 of the bytes that these ids decode to."""
    row = lambda own, ids: {"ids": ids, "decoded_sha256": hashlib.sha256(own.decode(ids)).hexdigest()}
    return _column("struct<ids: binary, decoded_sha256: string>", path, pattern, lambda own, batch: [row(own, x) for x in own.encode_all(_texts(batch))])(text)


def round_trip(docs: DataFrame, path: Path, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again.

    Null texts count as empty. Ids of any value and null ones stay as they are, repeated rows repeat, and an empty table
    gives no rows. Very long texts are encoded in parts, cut where the pattern cuts. Other columns are not read.
    """

    def row(own: Encoding, ids: bytes) -> dict:
        return {"n": len(ids) // 4, "ids": hashlib.sha256(ids).hexdigest(), "bytes": hashlib.sha256(own.decode(ids)).hexdigest()}

    ship_code(docs.sparkSession)
    done = _column("struct<n: bigint, ids: string, bytes: string>", path, pattern, lambda own, batch: [row(own, x) for x in own.encode_all(_texts(batch))])
    both = docs.select("doc_id", done(F.col("text")).alias("d"))
    return both.select("doc_id", F.col("d.n").alias("n_tokens"), F.col("d.ids").alias("ids_sha256"), F.col("d.bytes").alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
