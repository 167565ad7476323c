"""Embedding whitening: leading components of the covariance by contour integration, then projection of all rows.

Method (FEAST): the covariance is a small matrix (dimension by dimension) that Spark sums exactly in integers. Its
spectrum is cut into intervals by inertia counts. For an interval, Gauss-Legendre quadrature of complex shifted solves
along a half circle projects a random block onto the interval's eigenspace, Rayleigh-Ritz in the block extracts the
components, and the two steps repeat until the residuals vanish. The inertia counts at the interval's ends say how
many eigenvalues lie inside, so none is missed. A last Rayleigh-Ritz step over all blocks makes them orthonormal.

Rows stay where they are: one pass sums products, one measures the whitened covariance, one projects. What reaches the
driver is one number per pair of dimensions, whatever the number of rows.

Defined cases: a vector that is null, empty, or holds null or non-finite entries, or an entry whose x does not fit 53
bits, is dropped; of several vector lengths the most frequent one counts (ties: the longest) and the others are
dropped. Rows that repeat a vec_id each stay, a null vec_id stays null. Components without variance can't be whitened
and are left out, so n vectors give n - 1 components at most; an empty table gives no rows. ``deviation`` is null
where it passes 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm import core
from fieldtrace.llm.registry import query

COMPONENTS = 32
SCALE = 64  # x = floor(SCALE * c) + 1000000; the shift cancels in all that follows
NODES = 8  # quadrature nodes on the half circle
BLOCK = 12  # eigenvalues of an interval at most, where they are apart
ROUNDS = 40
LIMB = 40  # exact sums travel as three numbers of this many bits
ROWS = 2048  # rows that a task turns into a matrix at a time


# --- the small matrix: inertia, contour projection, Rayleigh-Ritz

def inertia(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` above ``shift``: signs of the pivots of L D L^T with complete
    pivoting by one or two rows; a vanishing rest has eigenvalues at the shift itself, which do not count."""
    m = a - shift * np.eye(len(a))
    alpha, above = (1 + 17 ** 0.5) / 8, 0
    tiny = np.finfo(float).eps * max(np.abs(m).max(initial=0.0), np.finfo(float).tiny)
    while len(m):
        diag = np.abs(np.diag(m))
        k = int(diag.argmax())
        off = np.abs(m - np.diag(np.diag(m)))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if max(diag[k], off[i, j]) <= tiny:
            break
        if diag[k] >= alpha * off[i, j]:
            above += m[k, k] > 0
            rest = np.delete(np.arange(len(m)), k)
            m = m[np.ix_(rest, rest)] - np.outer(m[rest, k], m[k, rest]) / m[k, k]
        else:
            above += 1  # a pivot block with negative determinant: one eigenvalue on each side
            pair = [i, j]
            rest = np.delete(np.arange(len(m)), pair)
            m = m[np.ix_(rest, rest)] - m[np.ix_(rest, pair)] @ np.linalg.solve(m[np.ix_(pair, pair)], m[np.ix_(pair, rest)])
        m = (m + m.T) / 2
    return int(above)


def intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), falling, that hold the ``wanted`` largest eigenvalues above noise."""
    norm = float(np.abs(a).sum(1).max(initial=0.0))
    floor, top = len(a) * np.finfo(float).eps * norm, norm * (1 + 1e-12)
    count = {floor: inertia(a, floor), top: 0} if norm else {floor: 0, top: 0}
    wanted = min(wanted, count[floor])
    out, todo = [], [(floor, top)] if wanted else []
    while todo and sum(n for _, _, n in out) < wanted:
        low, high = todo.pop()
        inside = count[low] - count[high]
        mid = (low + high) / 2
        if inside > BLOCK and high - low > 64 * floor and low < mid < high:
            count[mid] = inertia(a, mid)
            todo += [(low, mid), (mid, high)]  # the upper half is taken first
        elif inside:
            out.append((low, high, inside))
    return out


def projected(a: np.ndarray, low: float, high: float, inside: int, rng: np.random.Generator):
    """(Ritz values, orthonormal Ritz vectors) of the ``inside`` eigenvalues between ``low`` and ``high``."""
    d, norm = len(a), float(np.abs(a).sum(1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi * (nodes + 1) / 2
    size = min(d, inside + max(4, inside // 2))
    block, settled = rng.standard_normal((d, size)), False
    for _ in range(ROUNDS):
        space = np.zeros_like(block)
        for t, w in zip(angle, weights, strict=True):
            turn = np.exp(1j * t)
            solved = np.linalg.solve((centre + radius * turn) * np.eye(d) - a, block.astype(complex))
            space += (w / 2) * (radius * turn * solved).real
        basis = np.linalg.qr(space)[0]
        values, inner = np.linalg.eigh(basis.T @ a @ basis)
        vectors = basis @ inner
        # eigenvalues at an end belong to it as inertia counted them: take the innermost
        order = np.argsort(np.abs(values - centre), kind="stable")[:inside]
        residual = np.linalg.norm(a @ vectors[:, order] - vectors[:, order] * values[order], axis=0).max()
        reach = np.abs(values[order] - centre).max() <= radius + 64 * np.finfo(float).eps * norm
        if residual <= 32 * d * np.finfo(float).eps * norm and reach:
            if settled:
                return values[order], vectors[:, order]
            settled, block = True, vectors  # one more round takes what rounding left
            continue
        size = min(d, size + 2)
        block = np.hstack([vectors, rng.standard_normal((d, size - vectors.shape[1]))])
    raise ArithmeticError(f"the interval [{low}, {high}] did not give its {inside} components in {ROUNDS} rounds")


def ritz(a: np.ndarray, blocks: list[np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, orthonormal vectors) of the ``wanted`` largest in the span of all blocks, falling."""
    basis = np.linalg.qr(np.hstack(blocks))[0]
    values, inner = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (basis @ inner)[:, order]


def complete(a: np.ndarray, values: np.ndarray) -> bool:
    """No eigenvalue is missed or doubled: inertia just above and below the k-th value brackets k."""
    slack = 64 * len(a) * np.finfo(float).eps * float(np.abs(a).sum(1).max())
    return all(inertia(a, v + slack) <= k < inertia(a, v - slack) for k, v in enumerate(values))


def feast(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, orthonormal eigenvectors as columns) of the ``wanted`` largest eigenvalues, falling."""
    rng = np.random.default_rng(11)
    cuts = intervals(a, wanted)
    if not cuts:
        return np.zeros(0), np.zeros((len(a), 0))
    values, vectors = ritz(a, [projected(a, low, high, n, rng)[1] for low, high, n in cuts], wanted)
    if not complete(a, values):  # a cut went through a cluster: one interval for all
        values, vectors = ritz(a, [projected(a, cuts[-1][0], cuts[0][1], sum(n for _, _, n in cuts), rng)[1]], wanted)
        if not complete(a, values):
            raise ArithmeticError("inertia counts find components that the contour did not give")
    return values, vectors


# --- rows

def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, y): vectors that count, as whole numbers y = floor(64 c)."""
    c = F.col(f"`{vec_col}`").cast("array<double>")
    y = F.transform("c", lambda v: F.floor(v * F.lit(float(SCALE))).cast("long"))
    fits = F.size("c") > 0
    inside = F.forall("c", lambda v: F.coalesce(F.abs(v) < F.lit(2.0 ** 46), F.lit(False)))  # false for null, NaN and infinity too
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull() & fits & inside)
            .select("vec_id", y.alias("y")))


def matrices(batches, dim: int | None = None):
    """(batch of rows, their y as a matrix) in pieces of ROWS rows."""
    for batch in batches:
        if dim is not None and batch.num_rows:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("y")), dim))
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, np.asarray(part.column("y").flatten(), np.int64).reshape(part.num_rows, -1)


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y in exact whole numbers: in doubles where every sum stays below 2^53, else in long integers."""
    if not len(y) or len(y) * float(np.abs(y).max()) ** 2 < 2.0 ** 53:
        return (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object)
    return y.astype(object).T.dot(y.astype(object))


def _sums(dim: int):
    def run(batches):
        total = np.zeros((dim + 1, dim + 1), object)  # the first row and column hold the count and the plain sums
        for _, y in matrices(batches, dim):
            total += gram(np.hstack([np.ones((len(y), 1), np.int64), y]))
        i, j = np.triu_indices(dim + 1)
        mask = (1 << LIMB) - 1
        v = [int(x) for x in total[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array([(x >> s) & mask if s < 2 * LIMB else x >> s for x in v], pa.int64())
                                                                                              for s in (0, LIMB, 2 * LIMB)]], names=["i", "j", "v0", "v1", "v2"])

    return run


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums of y per dimension, covariance): exact sums of tasks' products, rounded once at the end.

    The numerator n * sum(y y') - S S' is that of centred products, so nothing cancels.
    """
    parts = rows.mapInArrow(_sums(dim), "i int, j int, v0 long, v1 long, v2 long").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("v0", "v1", "v2")])
    total = np.zeros((dim + 1, dim + 1), object)
    for r in parts.collect():  # one row per pair of dimensions
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v0"] + (r["v1"] << LIMB) + (r["v2"] << 2 * LIMB)
    n, sums = total[0, 0], [int(x) for x in total[0, 1:]]
    if not n:
        return 0, sums, np.zeros((dim, dim))
    cov = np.array([[(n * total[a + 1, b + 1] - sums[a] * sums[b]) / (n * n) for b in range(dim)] for a in range(dim)], float)
    return int(n), sums, cov


def centred(y: np.ndarray, n: int, sums: list[int]):
    """(n * y - sums as whole numbers, the same over n as doubles)."""
    big = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0) >= 1 << 62
    exact = n * y.astype(object) - np.array(sums, object) if big else n * y - np.array(sums, np.int64)
    return exact, (exact / n).astype(float)


def deviations(exact: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exact; null beyond 64 bits."""
    if exact.dtype != object and exact.shape[1] * float(np.abs(exact).max(initial=0)) ** 2 < 2.0 ** 62:
        return (exact * exact).sum(1).tolist()
    out = [sum(int(v) ** 2 for v in row) for row in exact]
    return [x if x < 1 << 63 else None for x in out]


def _spread(dim, n, sums, maps):
    def run(batches):
        total = np.zeros((maps.shape[1] + 1, maps.shape[1] + 1))
        for _, y in matrices(batches, dim):
            w = np.hstack([np.ones((len(y), 1)), centred(y, n, sums)[1] @ maps])
            total += w.T @ w
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    return run


def identity_error(rows: DataFrame, dim: int, n: int, sums: list[int], maps: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = maps.shape[1]
    total = np.zeros((k + 1, k + 1))
    for r in rows.mapInArrow(_spread(dim, n, sums, maps), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row per pair of components
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    mean = total[0, 1:] / n  # zero but for rounding, as rows are centred before
    return float(np.abs(total[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def _whiten(dim, n, sums, maps, explained, error):
    def run(batches):
        k = maps.shape[1]
        for part, y in matrices(batches, dim):
            exact, c = centred(y, n, sums)
            m = len(y)
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                                              pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(exact), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                                              pa.array((c @ maps).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                                             names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component; see the module's text for the columns' cases."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("y").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], OUT)
    dim = lengths["dim"]
    n, sums, cov = moments(rows, dim)
    values, vectors_ = feast(cov, components)
    if not len(values):
        return spark.createDataFrame([], OUT)
    maps = vectors_ / np.sqrt(values)
    error = identity_error(rows, dim, n, sums, maps)
    return rows.mapInArrow(_whiten(dim, n, sums, maps, values / np.trace(cov), error), OUT)


@query("op11_feast_whitening")
def op11(spark, sf_dir):
    return whiten(core.read(spark, sf_dir, "embeddings"))
