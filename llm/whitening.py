"""Operator 12: whiten embeddings along their principal components, found by Jacobi-Davidson.

The covariance is never formed. A distributed product with a few directions at once, of centred vectors, is all that the
solver asks of the data: every task multiplies its blocks and returns a row a dimension, which Spark sums up.

The solver keeps a search space with its products. Rayleigh-Ritz in it gives the leading pairs; those whose residual has
reached double precision are locked, and the search goes on orthogonal to them. For the others the correction equation,
projected away from locked and present vectors, is solved by a few steps of MINRES, all pairs together, so that a step
is one product; the corrections extend the space. What is left over is searched once more from new directions, so that
no larger value stays hidden.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import cut, ship_code, table
from llm.vectors import gathered, lengths, matrix, scaled, slices

COMPONENTS, SCALE = 4, 256
#: A residual is at double precision when its norm is at most so much of the largest value.
TOLERANCE = 2e-14
#: Steps of MINRES for a correction, and the share of the residual at which it ends earlier.
INNER, INNER_SHARE = 8, 1e-4
#: Directions of the search space beside the wanted ones, and the size in multiples of these at which it is restarted.
SPARE, RESTART = 4, 6
#: Rounds after which the solver gives up.
OUTER = 100
#: Beyond this a product of integers may not fit a long.
_LONG = (1 << 63) - 1

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(vectors: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the orthonormal columns of ``against``; dependent ones go."""
    out = np.zeros((len(vectors), 0))
    for v in vectors.T:
        size = np.linalg.norm(v)
        if size == 0 or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            for b in (*against, out):
                v = v - b @ (b.T @ v)
        if (size := np.linalg.norm(v)) > 1e-8:
            v = v / size
            for b in (*against, out):
                v = v - b @ (b.T @ v)
            out = np.column_stack((out, v / np.linalg.norm(v)))
    return out


def minres(product: Product, right: np.ndarray, steps: int = INNER, share: float = INNER_SHARE) -> np.ndarray:
    """Approximate solutions of product(x) = right, a column each, of least residual after a few Lanczos steps."""
    x, v_old, w, w_old = (np.zeros_like(right) for _ in range(4))
    beta = np.linalg.norm(right, axis=0)
    start = np.maximum(beta, np.finfo(float).tiny)
    v, eta = right / start, beta.copy()
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta_old, going = np.zeros_like(beta), beta > 0
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta_old * v_old
        beta = np.linalg.norm(p, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before
        delta = c * alpha - c_old * s * beta_old
        epsilon, gamma = s_old * beta_old, s * alpha + c_old * c * beta_old
        rho = np.hypot(delta, beta)
        going &= rho > 1e-14 * (np.abs(alpha) + beta + np.finfo(float).tiny)
        rho = np.where(going, rho, 1.0)
        c_old, s_old = c, s
        c, s = delta / rho, beta / rho
        w, w_old = (v - epsilon * w_old - gamma * w) / rho, w
        x = x + np.where(going, c * eta, 0.0) * w
        eta = -s * eta
        going &= (np.abs(eta) > share * start) & (beta > 1e-15 * start)
        if not going.any():
            break
        v_old, v, beta_old = v, np.where(going, p / np.where(beta > 0, beta, 1.0), 0.0), beta
    return x


def leading(product: Product, size: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest values of a symmetric positive semidefinite product, falling, and their unit vectors as columns."""
    wanted = min(wanted, size)
    block = min(size, wanted + SPARE)
    random = np.random.default_rng(seed)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    space = orthonormal(random.standard_normal((size, block)))
    images = product(space)
    largest = 0.0
    checked = False
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((space.T @ images + images.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        largest = max(largest, *theta[:1], *values[:1])
        if len(theta) > RESTART * block:
            turn, theta = turn[:, : 2 * block], theta[: 2 * block]
            space, images = space @ turn, images @ turn
            turn = np.eye(len(theta))
        open_ = wanted - locked.shape[1]
        now = min(max(open_, 1), len(theta))
        ritz = space @ turn[:, :now]
        residuals = images @ turn[:, :now] - ritz * theta[:now]
        residuals -= locked @ (locked.T @ residuals)
        good = np.linalg.norm(residuals, axis=0) <= TOLERANCE * max(largest, np.finfo(float).tiny)
        ready = int(np.argmin(good)) if not good.all() else now  # the leading ones that are good
        if open_ and ready:
            ready = min(ready, open_)
            locked, values = np.column_stack((locked, ritz[:, :ready])), np.concatenate((values, theta[:ready]))
            space, images = space @ turn[:, ready:], images @ turn[:, ready:]
            checked = False
            if locked.shape[1] < wanted and space.shape[1]:
                continue
        if locked.shape[1] == wanted or not space.shape[1]:
            if checked or locked.shape[1] == size:
                break
            # new directions, turned towards the largest of what is left
            fresh = orthonormal(random.standard_normal((size, 1 + SPARE)), locked, space)
            for _ in range(2):
                if fresh.shape[1]:
                    more = product(fresh)
                    more -= locked @ (locked.T @ more)
                    space, images = np.column_stack((space, fresh)), np.column_stack((images, more))
                    fresh = orthonormal(more, locked, space)
            checked = True
            if space.shape[1]:
                top = np.linalg.eigvalsh((space.T @ images + images.T @ space) / 2)[-1]
                worst = int(np.argmin(values)) if len(values) else 0
                if len(values) < wanted or top > values[worst] * (1 + 1e-9) + TOLERANCE * largest:
                    if len(values) == wanted:  # a larger one was hidden: the least locked one goes back
                        back = locked[:, [worst]]
                        space, images = np.column_stack((space, back)), np.column_stack((images, back * values[worst]))
                        locked, values = np.delete(locked, worst, axis=1), np.delete(values, worst)
                    checked = False
                    continue
            break
        away = np.column_stack((locked, ritz))

        def projected(x: np.ndarray) -> np.ndarray:
            x = x - away @ (away.T @ x)
            y = product(x) - x * theta[:now][np.newaxis]
            return y - away @ (away.T @ y)

        fixes = minres(projected, -(residuals - away @ (away.T @ residuals)))
        new = orthonormal(np.column_stack((fixes, residuals)), locked, space)[:, :block]
        if not new.shape[1]:
            new = orthonormal(random.standard_normal((size, block)), locked, space)
        if not new.shape[1]:  # the space is whole: its pairs are as good as they get
            locked, values = np.column_stack((locked, ritz)), np.concatenate((values, theta[:now]))
            break
        more = product(new)
        more -= locked @ (locked.T @ more)
        space, images = np.column_stack((space, new)), np.column_stack((images, more))
    else:
        raise ArithmeticError("the residuals don't reach double precision")
    locked = orthonormal(locked)
    theta, turn = np.linalg.eigh(locked.T @ product(locked))
    return theta[::-1], locked @ turn[:, ::-1]


class Centre:
    """The number and the sums of the distinct vectors of one length, by which vectors are centred."""

    def __init__(self, length: int, n: int, largest: int, sums: np.ndarray):
        self.length, self.n, self.largest, self.sums = length, n, largest, sums

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S of integer vectors, exact."""
        if 2 * self.n * self.largest <= _LONG:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def squared(self, deviations: np.ndarray) -> list[int | None]:
        """The exact sums of squares, null where one is no long."""
        if self.length * (2 * self.n * self.largest) ** 2 > _LONG:
            deviations = deviations.astype(object)
        return [int(s) if s <= _LONG else None for s in (deviations * deviations).sum(axis=1).tolist()]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


class Fit:
    """The distinct vectors of one length in blocks, and products with their covariance."""

    def __init__(self, rows: DataFrame, length: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                x = matrix(batch.column("x"), length)
                columns = [pa.array([len(x)], pa.int64()), pa.array([int(np.abs(x).max(initial=0))], pa.int64()), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["n", "largest", "sums", "block"])

        distinct = rows.where(F.col("length") == length).select("x").distinct()
        self.blocks = gathered(cut(distinct.mapInArrow(pack, "n long, largest long, sums array<long>, block binary")))
        n, largest = self.blocks.agg(F.sum("n"), F.max("largest")).first()
        sums = np.zeros(length, np.int64)
        for r in self.blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect():  # a row a dimension
            sums[r["i"]] = r["s"]
        self.centre = Centre(length, n, largest, sums)

    def reduced(self, each: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum over blocks of a function of centred vectors that gives a matrix of so many columns."""
        centre = self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column("block"):
                    own = each(centre.centred(np.frombuffer(block.as_buffer(), "<i4").reshape(-1, centre.length).astype(np.int64)))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], ["i", *(f"c{j}" for j in range(width))])

        sizes = ", ".join(f"c{j} double" for j in range(width))
        found = self.blocks.select("block").mapInArrow(run, f"i int, {sizes}").groupBy("i").agg(*[F.sum(f"c{j}") for j in range(width)])
        return np.array([list(r)[1:] for r in sorted(found.collect())])  # a row a dimension

    def product(self, directions: np.ndarray) -> np.ndarray:
        """The covariance times some directions."""
        if not directions.shape[1]:
            return directions.copy()
        return self.reduced(lambda c: c.T @ (c @ directions), directions.shape[1]) / self.centre.n

    def moments(self, components: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance of the vectors along some components, and the trace of the whole one."""
        k = components.shape[1]

        def each(c: np.ndarray) -> np.ndarray:
            w = c @ components
            return np.column_stack((np.vstack((w.T @ w, w.sum(axis=0))), np.full(k + 1, (c * c).sum())))

        total = self.reduced(each, k + 1) / self.centre.n
        mean = total[k, :k]
        return total[:k, :k] - np.outer(mean, mean), float(total[0, k])


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component.

    Of every vector without null or non-finite entries, x is floor(scale * c). The covariance is that of the distinct
    vectors, so repeated rows count once; each still gets its rows. A vector of fewer entries than ``components`` has a
    component an entry. A component without variance (one vector only, or fewer independent ones) has a null
    ``whitened``, and doesn't count for ``identity_error``; ``explained`` is null where nothing varies. ``deviation`` is
    exact, and null where it is no long. Vectors of each length are whitened by themselves. Null and repeated ids stay as
    they are. An empty table gives no rows; other columns are not read. A few directions of a vector's length are all
    that comes to the driver.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows = scaled(vectors, scale, F.col("vec_id").cast("long").alias("vec_id"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = spark.createDataFrame([], schema)
    for length in lengths(rows):
        if length:
            found = found.unionByName(_whitened(rows, Fit(rows, length), components, schema))
    return found


def _whitened(rows: DataFrame, fit: Fit, wanted: int, schema: str) -> DataFrame:
    centre = fit.centre
    values, axes = leading(fit.product, centre.length, wanted)
    covariance, trace = fit.moments(axes)
    varies = values > 1e-12 * max(values[0], np.finfo(float).tiny)
    scales = np.where(varies, np.sqrt(np.where(varies, values, 1.0)), np.nan)
    apart = np.abs(covariance / np.outer(scales, scales) - np.eye(len(values)))[np.ix_(varies, varies)]
    error = float(apart.max()) if varies.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in np.where(varies, values, 0.0)]
    length, k, n = centre.length, len(values), int(centre.n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch.column("x"), length)
            apart = centre.deviations(x)
            along = apart.astype(float) / n @ axes / scales
            m = len(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(np.repeat(np.array(centre.squared(apart), object), k).tolist(), pa.int64()), pa.array(along.ravel(), from_pandas=True), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.col("length") == length).select("vec_id", "x").mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
