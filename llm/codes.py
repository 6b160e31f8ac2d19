"""Operator 11: product codes of vectors by dual-tree Lloyd.

Vectors of integers are cut into equal parts, and each part position has a codebook of its own. A block of vectors has,
for each part position, a tree over its parts: boxes with the number and the sum of what they hold. A round builds a
tree over the entries of each codebook and walks both together: bounds of the squared distance between two boxes prune
entry nodes that hold no nearest entry of a part node; a part node with one entry left is assigned as a whole, by its
cached sum. Leaves that stay uncertain are compared with their entries part by part. All of it is in integers, so
results are exact and don't depend on how rows are dealt.

The trees are built once and written to the checkpoint folder; a round reads them and returns a sum for each entry.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table
from llm.vectors import gathered, lengths, matrix, scaled, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts of a leaf at most.
LEAF = 16
#: Up to so many labels their sums are broadcast; they are counted first.
BROADCAST_LABELS = 100_000


class Tree:
    """A balanced tree over the rows of an integer array. Node i of a level has the nodes 2 i and 2 i + 1 below it."""

    def __init__(self, points: np.ndarray, leaf: int):
        n = len(points)
        self.order = np.arange(n)
        edges, self.levels = np.array([0, n]), []
        while True:
            sizes = np.diff(edges)
            sorted_, some = points[self.order], sizes > 0
            starts = edges[:-1][some]
            low, high, total = (np.zeros((len(sizes), points.shape[1]), np.int64) for _ in range(3))
            for to, of in ((low, np.minimum), (high, np.maximum), (total, np.add)):
                if points.shape[1]:
                    to[some] = of.reduceat(sorted_, starts, axis=0)
            self.levels.append((edges, low, high, total))
            if sizes.max(initial=0) <= leaf:
                return
            widest = np.argmax(high - low, axis=1) if points.shape[1] else np.zeros(len(sizes), np.int64)
            node = np.repeat(np.arange(len(sizes)), sizes)
            along = sorted_[np.arange(n), widest[node]] if points.shape[1] else node
            self.order = self.order[np.lexsort((along, node))]
            edges = np.sort(np.concatenate((edges, edges[:-1] + sizes // 2)))


def box_distances(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest squared distance of points in two boxes each."""
    near = np.maximum(0, np.maximum(other_low - high, low - other_high))
    far = np.maximum(high - other_low, other_high - low)
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def dominated(low: np.ndarray, high: np.ndarray, best: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Whether all points of a box are strictly nearer to ``best``: the corner that lies furthest towards ``entry`` is."""
    corner = np.where(entry > best, high, low)
    return ((corner - best) ** 2).sum(axis=1) < ((corner - entry) ** 2).sum(axis=1)


def assigned(points: np.ndarray, tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point, ties to the lower index, and the sum and number of each entry's points."""
    book = Tree(entries, 1)
    codes = np.zeros(len(points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    part, node = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of nodes, at a level of each tree
    level = depth = 0
    while len(part):
        edges, low, high, total = tree.levels[level]
        book_edges, book_low, book_high, _ = book.levels[depth]
        near, far = box_distances(low[part], high[part], book_low[node], book_high[node])
        bound = np.full(len(edges) - 1, np.iinfo(np.int64).max)
        np.minimum.at(bound, part, far)
        stay = near <= bound[part]
        if depth == len(book.levels) - 1:  # every node is an entry
            entry = book.order[book_edges[node]]
            first = np.lexsort((entry, far, part))
            heads = first[np.concatenate(([True], part[first][1:] != part[first][:-1]))]
            best = np.zeros(len(edges) - 1, np.int64)
            best[part[heads]] = entry[heads]
            stay &= (entry == best[part]) | ~dominated(low[part], high[part], entries[best[part]], entries[entry])
            part, node, entry = part[stay], node[stay], entry[stay]
            left = np.bincount(part, minlength=len(edges) - 1)
            sure = left[part] == 1
            for p, e in zip(part[sure].tolist(), entry[sure].tolist()):
                codes[tree.order[edges[p] : edges[p + 1]]] = e
                sums[e] += total[p]
                counts[e] += edges[p + 1] - edges[p]
            part, node, entry = part[~sure], node[~sure], entry[~sure]
            if level == len(tree.levels) - 1:
                _leaves(points, tree.order, edges, part, entry, entries, codes, sums, counts)
                return codes, sums, counts
        else:
            part, node = part[stay], node[stay]
            part, node = np.repeat(part, 2), np.stack((2 * node, 2 * node + 1), axis=1).ravel()
            depth += 1
            there = np.diff(book.levels[depth][0])[node] > 0
            part, node = part[there], node[there]
        if level < len(tree.levels) - 1:
            part, node = np.stack((2 * part, 2 * part + 1), axis=1).ravel(), np.repeat(node, 2)
            level += 1
            there = np.diff(tree.levels[level][0])[part] > 0
            part, node = part[there], node[there]
    return codes, sums, counts


def _leaves(points: np.ndarray, order: np.ndarray, edges: np.ndarray, part: np.ndarray, entry: np.ndarray, entries: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Assign the points of uncertain leaves, each compared with the entries that its leaf has left."""
    if not len(part):
        return
    open_ = np.zeros((len(edges) - 1, len(entries)), bool)
    open_[part, entry] = True
    leaves = np.unique(part)
    leaf = np.repeat(leaves, np.diff(edges)[leaves])
    at = order[np.concatenate([np.arange(edges[i], edges[i + 1]) for i in leaves.tolist()])]
    apart = ((points[at][:, None, :] - entries[None]) ** 2).sum(axis=2)
    code = np.argmin(np.where(open_[leaf], apart, np.iinfo(np.int64).max), axis=1)
    codes[at] = code
    np.add.at(sums, code, points[at])
    np.add.at(counts, code, 1)


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal parts of the vectors; zeros fill the last one where the length is no multiple."""
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))
    return [np.ascontiguousarray(x[:, i * width : (i + 1) * width]) for i in range(parts)]


def _forest(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """(vec_id, label, block): blocks of vectors with a tree for each part position, written to the checkpoint folder."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = _parts(matrix(batch.column("x"), length), parts)
            packed = pickle.dumps([(p.astype(np.int32), Tree(p, LEAF)) for p in own], protocol=5)
            columns = [pa.array([batch.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("vec_id", pa.int64()), ("label", pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([packed], pa.binary())], ["vec_id", "label", "block"])

    return gathered(cut(rows.where(F.col("length") == length).select("vec_id", "label", "x").mapInArrow(plant, "vec_id array<long>, label array<string>, block binary")))


def _round(forest: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the floored mean of its parts, an unused one as it was."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for block in batch.column("block"):
                for i, (points, tree) in enumerate(pickle.loads(block.as_buffer())):
                    _, more, n = assigned(points.astype(np.int64), tree, books[i])
                    sums[i] += more
                    counts[i] += n
        for i, n in enumerate(counts):
            entry = np.flatnonzero(n)
            columns = [pa.array(np.full(len(entry), i, np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[entry]), pa.array(sums[i][entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    found = forest.select("block").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    width = books[0].shape[1]
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
    new = [b.copy() for b in books]
    for r in total.collect():  # a row an entry
        new[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return new


def codebooks_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()


def _coded(forest: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every vector by these codebooks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in zip(batch.column("vec_id"), batch.column("label"), batch.column("block")):
                digits, error = [], np.zeros(len(ids), np.int64)
                for book, (points, tree) in zip(books, pickle.loads(block.as_buffer())):
                    points = points.astype(np.int64)
                    own = assigned(points, tree, book)[0]
                    error += ((points - book[own]) ** 2).sum(axis=1)
                    digits.append(own.astype(np.uint8))
                codes = [row.tobytes().hex() for row in np.stack(digits, axis=1)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return forest.mapInArrow(code, "vec_id long, label string, code string, error long").withColumn("codebooks_sha256", F.lit(codebooks_hash(books)))


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector without null or non-finite components.

    Components are floor(scale * c). Codebooks start as the parts of the rows with the least ids, null ids last, of equal
    ids the least vectors, fewer if there are fewer. Vectors of each length have codebooks of their own; where a length
    is no multiple of ``parts``, zeros fill it up. Repeated rows count as often as they come. Equal labels are equal as
    text, nulls together, over all lengths. An empty table gives no rows; other columns are not read. Codebooks, of
    entries x length integers, are all that comes to the driver.
    """
    if entries > 256:
        raise ValueError("a code has two digits a part")
    spark = vectors.sparkSession
    ship_code(spark)
    rows = scaled(vectors, scale, F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"))
    found = spark.createDataFrame([], "vec_id long, label string, code string, error long, codebooks_sha256 string")
    for length in lengths(rows):
        first = rows.where(F.col("length") == length).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
        books = _parts(np.array([r["x"] for r in first], np.int64).reshape(len(first), length), parts)
        forest = _forest(rows, length, parts)
        for _ in range(rounds):
            books = _round(forest, books)
        found = found.unionByName(_coded(forest, books))
    found = cut(found)
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    joined = found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same by plain comparison with all entries, a statement a round."""
    nearest = "arg_min(e.entry, (list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e.entry))"
    steps = [
        f"""kept as materialized (
  select vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
numbered as materialized (select *, row_number() over (order by vec_id nulls last, x) - 1 as row from kept),
parts as materialized (
  select row, part, list_slice(x, part * len(x) // {PARTS} + 1, (part + 1) * len(x) // {PARTS}) as v from numbered, range({PARTS}) as r(part)),
book0 as materialized (select part, row as entry, v from parts where row < {ENTRIES})"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"near{i} as materialized (select p.row, p.part, any_value(p.v) as v, {nearest} as entry from parts p join book{i} e using (part) group by p.row, p.part)")
        if i < ROUNDS:
            steps.append(
                f"""mean{i} as materialized (
  select part, entry, list(m order by pos) as v from (
    select part, entry, pos, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
    from (select part, entry, unnest(v) as c, generate_subscripts(v, 1) as pos from near{i}) group by part, entry, pos)
  group by part, entry),
book{i + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from book{i} b left join mean{i} m using (part, entry))"""
            )
    last = ROUNDS
    steps.append(
        f"""coded as materialized (
  select n.row, string_agg(printf('%02x', n.entry), '' order by n.part) as code,
    sum(list_sum(list_transform(list_zip(n.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::bigint as error
  from near{last} n join book{last} e using (part, entry) group by n.row),
hash as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as h from book{last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select h from hash) as codebooks_sha256
from numbered join coded using (row)"""
    )
    return "with " + ",\n".join(steps)


OP11_SQL = _sql()
