"""Embedding whitening by FEAST: contour integration over slices of the spectrum.

Entries become whole numbers; each distinct vector is in the fit list once.  One pass over
the fit list gives its size and sums, a second the products of entries centred at the
nearest whole numbers, so the covariance is exact up to one rounding.  Inertia counts
(signs of the pivots of a symmetric elimination of V - s) cut the upper end of the
spectrum into slices with few eigenvalues, in gaps.  A task takes a slice: quadrature of
complex shifted solves on a circle around it filters a block of vectors, Rayleigh-Ritz
extracts pairs, and it repeats until as many pairs as the inertia counts say have small
residuals.  A last Rayleigh-Ritz step over all slices makes close pairs orthogonal.

The driver holds one matrix of the vectors' length squared, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
NODES = 8  # quadrature points on the upper half circle
IN_SLICE = 6  # eigenvalues that a slice should have at most
#: Components below this share of the largest eigenvalue aren't known to four digits in double precision.
LEAST = 1e-10
EXACT = 1 << 24  # centred entries up to here have exact products in whole numbers
LONG = 1 << 63


# ---------------------------------------------------------------- the eigenproblem


def inertia(m: np.ndarray, s: float) -> int:
    """How many eigenvalues of the symmetric matrix m exceed s: symmetric elimination with pivots of one or two rows."""
    a = m - s * np.eye(len(m))
    above = 0
    while len(a):
        at = np.abs(np.diag(a)).argmax()
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = np.unravel_index(off.argmax(), off.shape)
        if abs(a[at, at]) >= 0.64 * off[i, j]:
            pick, d = [at], a[at, at]
            above += int(d > 0)
            if d == 0:
                break  # all that is left is zero
        else:
            pick = [i, j]
            above += 1  # one of the two is positive, as the off-diagonal entry outweighs both
        rest = np.setdiff1d(np.arange(len(a)), pick)
        c = a[np.ix_(rest, pick)]
        a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(a[np.ix_(pick, pick)], c.T)
        a = (a + a.T) / 2
    return above


def slices(m: np.ndarray, wanted: int, within: int = IN_SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top until ``wanted`` eigenvalues are covered, cut in gaps."""
    span = float(np.abs(m).sum(axis=1).max())  # no eigenvalue is larger
    if span == 0:
        return []
    tiny = 1e-11 * span
    todo, out, have = [(-tiny * 4, span * (1 + 1e-9), inertia(m, -tiny * 4))], [], 0
    while todo and have < wanted:
        low, high, n = todo.pop()
        if n > within and high - low > 64 * tiny:
            for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65):
                cut = low + part * (high - low)
                up, down = inertia(m, cut + tiny), inertia(m, cut - tiny)
                if up == down:  # no eigenvalue at the cut
                    break
            else:
                cut = None
            if cut is not None:
                top = inertia(m, high)
                todo += [(low, cut, n - (up - top)), (cut, high, up - top)]
                continue
        if n:
            out.append((low, high, n))
            have += n
    return out


def feast(m: np.ndarray, low: float, high: float, n: int, nodes: int = NODES, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The n eigenpairs of m between low and high (values, vectors in columns)."""
    d, norm = len(m), float(np.abs(m).sum(axis=1).max())
    x, w = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - x)
    centre, radius = (low + high) / 2, (high - low) / 2
    shift = centre + radius * np.exp(1j * angle)
    rng = np.random.default_rng(11)
    size = min(d, n + max(4, n // 2))
    y = rng.standard_normal((d, size))
    best = None
    for k in range(rounds):
        # (1 / 2 pi i) of the contour integral of the resolvent; the lower half circle gives the conjugate
        q = sum((w[i] * radius / 2 * np.exp(1j * angle[i]) * np.linalg.solve(shift[i] * np.eye(d) - m, y.astype(complex))).real for i in range(nodes))
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > 1e-14 * s[0]] if s[0] > 0 else u
        e, z = np.linalg.eigh(u.T @ m @ u)  # of the projected problem, as small as the slice
        v = u @ z
        r = np.sqrt(((m @ v - v * e) ** 2).sum(axis=0))
        inside = np.flatnonzero((e > low) & (e < high))
        if len(inside) >= n:
            worst = r[inside].max()
            if best is None or len(best[0]) != n or worst < best[2]:
                best = e[inside], v[:, inside], worst
            if len(inside) == n and worst <= 4e-16 * norm * np.sqrt(d):
                break
        if k % 8 == 7 and (best is None or best[2] > 1e-13 * norm) and size < d:
            size = min(d, 2 * size)  # the block was too small for what lies close to the slice
        y = v if v.shape[1] == size else np.hstack([v[:, :size], rng.standard_normal((d, max(0, size - v.shape[1])))])
    if best is None or len(best[0]) != n:
        raise ArithmeticError(f"{n} eigenvalues between {low} and {high}, found {0 if best is None else len(best[0])}")
    return best[0], best[1]


def _solved(parts: DataFrame, matrices: dict[int, np.ndarray]) -> DataFrame:
    """(dim, value, vector) of all eigenpairs of the slices (dim, low, high, n); each slice is a task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, low, high, n in zip(*(c.to_pylist() for c in b.columns)):
                e, v = feast(matrices[dim], low, high, n)
                yield pa.record_batch([pa.array([dim] * n, pa.int32()), pa.array(e), pa.array(list(v.T), pa.list_(pa.float64()))], ["dim", "value", "vector"])

    return parts.mapInArrow(run, "dim int, value double, vector array<double>")


def components(spark: SparkSession, matrices: dict[int, np.ndarray], wanted: int = COMPONENTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each matrix its largest eigenvalues above LEAST, falling, and unit eigenvectors in columns."""
    cuts = [(dim, *x) for dim, m in matrices.items() for x in slices(m, min(wanted, dim))]
    found: dict[int, list] = {}
    if cuts:
        parts = spark.createDataFrame(cuts, "dim int, low double, high double, n int").repartition(len(cuts))
        for r in _solved(parts, matrices).collect():  # a few more pairs than wanted
            found.setdefault(r["dim"], []).append(r["vector"])
    out = {}
    for dim, m in matrices.items():
        if dim in found:
            q, _ = np.linalg.qr(np.array(found[dim]).T)
            e, z = np.linalg.eigh(q.T @ m @ q)
            top = np.argsort(-e, kind="stable")[:wanted]
            top = top[e[top] > LEAST * e[top[0]]] if e[top[0]] > 0 else top[:0]
            out[dim] = e[top], q @ z[:, top]
        else:
            out[dim] = np.empty(0), np.empty((dim, 0))
    return out


# ---------------------------------------------------------------- passes over vectors


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as long; what is beyond the range of long stays at its ends."""
    with np.errstate(over="ignore"):
        y = np.floor(values * SCALE)
    end = float(LONG - 2 * SHIFT)
    return np.where(np.abs(y) < end, np.where(np.abs(y) < end, y, 0).astype(np.int64), np.where(y > 0, LONG - 2 - 2 * SHIFT, 2 + 2 * SHIFT - LONG)) + SHIFT


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, x) of each usable (id, embedding), x little-endian longs."""
    for b in batches:
        lists = b.column(1)
        keep, xs = [], []
        for k, v in enumerate(lists):
            if v.is_valid and not v.values.null_count:
                c = v.values.to_numpy(zero_copy_only=False).astype(float)
                if np.isfinite(c).all():
                    keep.append(k)
                    xs.append(_whole(c).astype("<i8").tobytes())
        yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), pa.array([len(x) // 8 for x in xs], pa.int32()), pa.array(xs, pa.binary())], ["id", "dim", "x"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, vectors as rows) for each length in a batch (..., dim, x)."""
    dims = batch.column(batch.num_columns - 2).to_numpy()
    x = batch.column(batch.num_columns - 1)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, np.frombuffer(b"".join(x.take(pa.array(at)).to_pylist()), "<i8").reshape(len(at), int(dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, place, n, high, low, least, most) of a task's vectors: sums of entries in two halves, so that none overflows."""
    held: dict[int, list] = {}
    for b in batches:
        for dim, _, x in _by_dim(b):
            h = held.setdefault(dim, [0, np.zeros(dim, object), x.min(axis=0), x.max(axis=0)])
            h[0] += len(x)
            h[1] = h[1] + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0)
            h[2], h[3] = np.minimum(h[2], x.min(axis=0)), np.maximum(h[3], x.max(axis=0))
    for dim, (n, s, lo, hi) in held.items():
        yield pa.record_batch([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([v >> 32 for v in s], pa.int64()), pa.array([v & 0xFFFFFFFF for v in s], pa.int64()), pa.array(lo), pa.array(hi)], ["dim", "place", "n", "high", "low", "least", "most"])


class Fit:
    """What one pass over the fit list says about vectors of one length."""

    def __init__(self, n: int, sums: list[int], least: list[int], most: list[int]) -> None:
        self.n, self.sums = n, sums
        self.centre = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.centre)]  # n times the mean of centred entries
        self.reach = max(max(abs(lo - c), abs(hi - c)) for lo, hi, c in zip(least, most, self.centre))
        self.exact = self.reach <= EXACT
        # n x - S in longs, and its squares added up
        self.narrow = (n * self.reach + max(map(abs, self.rest))) ** 2 * len(sums) < LONG

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the centre: whole numbers as doubles, exact for entries up to EXACT."""
        return (x - np.array(self.centre, np.int64)).astype(float) if self.exact else x.astype(float) - np.array(self.centre, float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, null where it doesn't fit a long."""
        if self.narrow:
            d = self.n * (x - np.array(self.centre, np.int64)) - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        wide = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < LONG else None for v in wide]

    def from_mean(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return self.centred(x) - np.array([r / self.n for r in self.rest])


def _products(fits: dict[int, Fit]):
    """(dim, i, j, whole, part) of a task's vectors: sums of products of centred entries, i <= j, as a decimal or, beyond its exact range, as a double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        wide: dict[int, np.ndarray] = {}  # what longs may not hold much longer
        for b in batches:
            for dim, _, x in _by_dim(b):
                f = fits[dim]
                z = f.centred(x)
                if not f.exact:
                    held[dim] = held.get(dim, np.zeros((dim, dim))) + z.T @ z
                    continue
                step = (1 << 53) // max(1, f.reach) ** 2  # a double holds the sum of so many products exactly
                for lo in range(0, len(x), step):
                    sums = held.setdefault(dim, np.zeros((dim, dim), np.int64))
                    sums += (z[lo : lo + step].T @ z[lo : lo + step]).astype(np.int64)
                    if np.abs(sums).max() > 1 << 61:
                        wide[dim] = wide.get(dim, 0) + sums.astype(object)
                        sums[:] = 0
        for dim, g in held.items():
            i, j = np.triu_indices(dim)
            if fits[dim].exact:
                g = g + wide[dim] if dim in wide else g
                whole, part = [str(int(v)) for v in g[i, j]], [None] * len(i)
            else:
                whole, part = [None] * len(i), g[i, j].tolist()
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(whole, pa.string()), pa.array(part, pa.float64())], ["dim", "i", "j", "whole", "part"])

    return run


def _covariances(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    sums = fit.mapInArrow(_products(fits), "dim int, i int, j int, whole string, part double").groupBy("dim", "i", "j").agg(F.sum(F.col("whole").cast("decimal(38,0)")).alias("whole"), F.sum("part").alias("part"))
    out = {dim: np.zeros((dim, dim)) for dim in fits}
    for r in sums.collect():  # half a matrix of the vectors' length squared
        f, i, j = fits[r["dim"]], r["i"], r["j"]
        if r["whole"] is not None:  # (n * products - sums * sums) / n^2, rounded once
            v = float(Fraction(f.n * int(r["whole"]) - f.rest[i] * f.rest[j], f.n * f.n))
        else:
            v = r["part"] / f.n - (f.rest[i] / f.n) * (f.rest[j] / f.n)
        out[r["dim"]][i, j] = out[r["dim"]][j, i] = v
    return out


def _identity_errors(fit: DataFrame, fits: dict[int, Fit], found: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, float]:
    """Largest absolute entry of (covariance of whitened vectors of the fit list - identity), for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, x in _by_dim(b):
                e, q = found[dim]
                w = np.hstack([fits[dim].from_mean(x) @ (q / np.sqrt(e)), np.ones((len(x), 1))])
                held[dim] = held.get(dim, 0) + w.T @ w
        for dim, g in held.items():
            i, j = np.indices(g.shape).reshape(2, -1)
            yield pa.record_batch([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g.ravel())], ["dim", "i", "j", "v"])

    out, by = {}, {}
    for r in fit.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():  # 17 x 17 for each length
        by.setdefault(r["dim"], {})[r["i"], r["j"]] = r["v"]
    for dim, g in by.items():
        k, n = len(found[dim][0]), fits[dim].n
        m = np.array([[g[i, j] for j in range(k + 1)] for i in range(k + 1)]) / n
        c = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
        out[dim] = float(np.abs(c - np.eye(k)).max()) if k else 0.0
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Rows (id_col, component, n, deviation, whitened, explained, identity_error).

    A vector that is null or has null or non-finite entries gives no rows.  Vectors of each
    length are whitened by themselves, with an n and an identity_error of their own; empty
    ones have no components and give no rows.  Components are numbered by falling eigenvalue;
    there are ``wanted`` or as many as the vectors have entries, less those whose eigenvalue
    is no more than 1e-10 of the largest, as nothing can be divided by a variance of zero: equal
    vectors only, or one vector, give no rows.  Null and repeated ids are kept.  Repeated
    vectors count once in the fit list and get their rows each time.  Entries beyond the range
    of long stay at its ends; a deviation that doesn't fit a long is null.  An empty table
    gives an empty one.  Other columns aren't read, so their names don't matter.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding")).mapInArrow(_rows, f"id {kind}, dim int, x binary")
    fit = materialise(rows.where("dim > 0").select("dim", "x").distinct())
    sums = fit.mapInArrow(_sums, "dim int, place int, n long, high long, low long, least long, most long").groupBy("dim", "place")
    sums = sums.agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most"))
    by: dict[int, dict[int, tuple]] = {}
    for r in sums.collect():  # one row for each entry of a vector
        by.setdefault(r["dim"], {})[r["place"]] = (int(r["n"]), (int(r["high"]) << 32) + int(r["low"]), r["least"], r["most"])
    fits = {dim: Fit(v[0][0], *(list(x) for x in list(zip(*(v[k] for k in range(dim))))[1:])) for dim, v in by.items()}
    matrices = _covariances(fit, fits)
    found = components(spark, matrices, wanted)
    errors = _identity_errors(fit, fits, found)
    explained = {dim: e / np.trace(matrices[dim]) for dim, (e, _) in found.items() if len(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, x in _by_dim(b):
                e, q = found[dim]
                k = len(e)
                if not k:
                    continue
                f = fits[dim]
                w = f.from_mean(x) @ (q / np.sqrt(e))
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, f.n)),
                        pa.array([d for d in f.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained[dim], len(x))),
                        pa.array(np.full(len(x) * k, errors[dim])),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = rows.where("dim > 0").mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
