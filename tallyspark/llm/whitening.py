"""Whitening of embeddings on principal components found by QDWH spectral divide and conquer.

Vectors are put on an integer grid, each distinct one counts once, and sums, centred products and the check of the
result are summed over the written list of distinct vectors by tasks. Only matrices whose size depends on the dimension
alone reach the driver. There the covariance is split: the polar factor U of the covariance minus a shift has eigenvalues
+1 and -1, so (I + U) / 2 projects on the components above the shift; both invariant subspaces are split again until
single components are left. Subspaces below the wanted components are not entered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialise

#: Components returned, steps of the grid per unit, and what is added to each step.
COMPONENTS, GRID, OFFSET = 16, 64, 1_000_000
#: A component whose variance is below this share of the largest has none.
NO_VARIANCE = 1e-13
#: Tasks that merge the partial figures of the last check.
MERGERS = 64
_EPS = np.finfo(float).eps
_LARGEST = float(1 << 62)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps (QR where weights are large, else Cholesky)."""
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a)
    try:
        low = 1.0 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(n))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, _EPS), 1.0)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4.0 * (1.0 - square) / square**2)
        root = np.sqrt(1.0 + d)
        wa = root + 0.5 * np.sqrt(max(8.0 - 4.0 * d + 8.0 * (2.0 - square) / (square * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        low = min(low * (wa + wb * square) / (1.0 + wc * square), 1.0)
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            factor = np.linalg.cholesky(eye + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(_EPS) and 1.0 - low < 1e-14:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift that leaves neither empty."""
    n = len(a)
    mean = np.trace(a) / n
    centred = a - mean * np.eye(n)
    spread = np.linalg.norm(centred) / np.sqrt(n)
    start = np.random.default_rng(n).standard_normal((n, n))
    best = None
    # the mean lies strictly between the extreme eigenvalues; the others serve where it is (nearly) an eigenvalue itself
    for step in (0.0, 1e-3, -1e-3, 0.01, -0.01, 0.05, -0.05, 0.2, -0.2, 0.5, -0.5):
        u = polar(centred - step * spread * np.eye(n))
        above = (np.eye(n) + u) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < n:
            continue
        bases = []
        for projector, columns in ((above, start[:, :rank]), (np.eye(n) - above, start[:, rank:])):
            q = np.linalg.qr(projector @ columns)[0]
            bases.append(np.linalg.qr(projector @ q)[0])
        # what couples the two subspaces: rounding alone if the shift was apart from all eigenvalues
        left = np.linalg.norm(bases[1].T @ a @ bases[0]) + np.linalg.norm(a) * np.linalg.norm(bases[1].T @ bases[0])
        if best is None or left < best[0]:
            best = (left, *bases)
        if left <= 20 * _EPS * n * np.linalg.norm(a):
            break
    return best[1], best[2]


def eigen(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    wanted = min(wanted, n)
    diagonal = np.diag(a)
    if n == 1 or np.linalg.norm(a - np.diag(diagonal)) <= _EPS * np.linalg.norm(a):
        order = np.argsort(-diagonal, kind="stable")[:wanted]
        return diagonal[order], np.eye(n)[:, order]
    values, vectors = [], []
    for basis in _split(a):
        if wanted - sum(map(len, values)) > 0:
            part = basis.T @ a @ basis
            e, w = eigen((part + part.T) / 2, wanted - sum(map(len, values)))
            values.append(e)
            vectors.append(basis @ w)
    e, v = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass(frozen=True)
class Whitener:
    """n distinct vectors, their sums, components as columns, eigenvalues, their shares, and the largest departure from the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (_differences(x, self.n, self.sums).astype(float) / self.n) @ (self.components / np.sqrt(self.values))


def _differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in Python's numbers where 64 bits don't hold them."""
    if max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n < 1 << 61:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _deviations(differences: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond a long."""
    if differences.dtype != object and int(np.abs(differences).max(initial=0)) ** 2 * max(1, differences.shape[1]) < 1 << 63:
        return (differences * differences).sum(1).tolist()
    return [s if (s := sum(d * d for d in row)) < 1 << 63 else None for row in differences.tolist()]


def _grid(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows of usable vectors and their grid vectors."""
    edges = vectors.offsets.to_numpy()
    scaled = GRID * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    usable = np.abs(scaled) < _LARGEST  # false for NaN too
    bad = np.concatenate(([0], np.cumsum(~usable)))
    size = np.diff(edges)
    good = vectors.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (bad[edges[1:]] == bad[edges[:-1]])
    out = []
    for length in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == length))
        out.append((rows, np.floor(scaled[edges[rows][:, None] + np.arange(length)]).astype(np.int64) + OFFSET))
    return out


def _vectors(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.int64).reshape(-1, width)


def fit(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> Whitener | None:
    """The whitener of the distinct grid vectors of `rows`; None without any, or where they don't vary.

    Vectors of the commonest length (of the distinct ones; a tie goes to the longer) are fitted.
    """

    def to_grid(batches):
        for batch in batches:
            cells = [row.tobytes() for _, x in _grid(batch.column(1)) for row in x]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], ["x"])

    # read three times: copies are merged before the shuffle, the list is written once
    distinct = materialise(_vectors(rows, id_column, column).mapInArrow(to_grid, "x binary").distinct(), "whitening-fit")
    common = distinct.groupBy((F.length("x") / 8).cast("int").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return None
    n, width = common["n"], common["width"]
    fitted = distinct.filter(F.length("x") == 8 * width)

    def sums(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["s"])

    added = fitted.mapInArrow(sums, "s array<long>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    total = np.array([r["s"] for r in sorted(added.collect())], np.int64)

    def products(batches):
        held = np.zeros((width, width))
        for batch in batches:
            c = _differences(_matrix(batch.column(0), width), n, total).astype(float) / n
            held += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in held], pa.binary())], ["i", "row"])

    def added_rows(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[i] = held.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["i", "row"])

    kind = "i int, row binary"
    gathered = fitted.mapInArrow(products, kind).repartition("i").mapInArrow(added_rows, kind).collect()
    covariance = np.array([np.frombuffer(r["row"]) for r in sorted(gathered, key=lambda r: r["i"])]) / n
    covariance = (covariance + covariance.T) / 2
    if not covariance.any():
        return None
    e, v = eigen(covariance, components)
    varied = e > NO_VARIANCE * max(e[0], 0.0)
    made = Whitener(n, total, v[:, varied], e[varied], e[varied] / np.trace(covariance))

    def moments(batches):
        count, mean, m2 = 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = made.whiten(_matrix(batch.column(0), width))
            own = w.mean(0)
            count, mean, m2 = _merged((count, mean, m2), (len(w), own, (w - own).T @ (w - own)))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([mean.tobytes()], pa.binary()), pa.array([m2.tobytes()], pa.binary())], ["n", "mean", "m2"])

    def merged(batches):
        state = (0, 0.0, 0.0)
        for batch in batches:
            for r in batch.to_pylist():
                state = _merged(state, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(len(made.values), -1)))
        if state[0]:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1].tobytes()], pa.binary()), pa.array([state[2].tobytes()], pa.binary())], ["n", "mean", "m2"])

    kind = "n long, mean binary, m2 binary"
    state = (0, 0.0, 0.0)
    for r in fitted.mapInArrow(moments, kind).repartition(MERGERS).mapInArrow(merged, kind).collect():
        state = _merged(state, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"]).reshape(len(made.values), -1)))
    error = float(np.abs(state[2] / n - np.eye(len(made.values))).max())
    return Whitener(made.n, made.sums, made.components, made.values, made.explained, error)


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two parts together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.multiply.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, model: Whitener | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Left out: null and empty vectors, those with null or non-finite entries or entries beyond a long on the grid, and
    those of another length than the fitted ones. Components without variance are not made, so vectors that are all alike
    give no rows, and neither does an empty table. Repeated rows and rows with a null id each get their rows; a deviation
    beyond a long is null; other columns are ignored.
    """
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], kind)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # its size depends on the dimension alone

    def run(batches):
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for at, x in _grid(batch.column(1)):
                if x.shape[1] != len(m.sums):
                    continue
                many = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(many, m.n)), pa.array(_deviations(_differences(x, m.n, m.sums)), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(many, m.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return _vectors(rows, id_column, column).mapInArrow(run, kind)


def query(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings, fit(embeddings))
