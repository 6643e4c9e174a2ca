"""Moment matrices and multi-start k-means: one mergeable aggregate per pass.

Each task reduces its Arrow batches to sums of a size fixed by the settings
(columns squared, or starts x clusters x columns); the sums are added by a
grouped aggregate, and only their totals reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = "i int, j int, v double"


def _matrix(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cols]).astype(np.float64)


def _cells(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(m.shape)
    return pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], ["i", "j", "v"])


def _total(cells: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def doubles(df: DataFrame, cols: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns as doubles, nulls as 0, and the row keys that are there."""
    return df.select(*[c for c in keep if c in df.columns], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    #: Sums of products of deviations from the mean.
    products: np.ndarray

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.diag(self.products) / max(1, self.n - 1))

    def correlation(self) -> np.ndarray:
        """NaN beside a constant column."""
        d = np.sqrt(np.diag(self.products))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.outer(d, d) > 0, self.products / np.outer(d, d), np.nan)


def moments(df: DataFrame, cols: list[str]) -> Moments:
    """Count, means and products of ``cols`` (nulls as 0) in one pass.

    A task sums its products about its own mean and sends them with its counts; totals are put together by the
    rule for pooled deviations, so large means cost no digits."""
    data, d = doubles(df, cols), len(cols)
    first = data.first()
    shift = np.array(first, dtype=float) if first is not None else np.zeros(d)

    def reduce(batches):
        out = np.zeros((d + 1, d + 1))
        for batch in batches:
            m = np.column_stack([_matrix(batch, cols) - shift, np.ones(batch.num_rows)])
            out += m.T @ m
        yield _cells(out)

    s = _total(data.mapInArrow(reduce, _CELLS), (d + 1, d + 1))
    n, sums = int(s[d, d]), s[d, :d]
    if not n:
        return Moments(0, np.zeros(d), np.zeros((d, d)))
    products = s[:d, :d] - np.outer(sums, sums) / n
    # a constant column's deviations are rounding only
    diagonal = np.diag(products).copy()
    tiny = diagonal <= 1e-12 * np.diag(s[:d, :d])
    products[tiny, :] = products[:, tiny] = 0.0
    return Moments(n, shift + sums / n, products)


def principal_components(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns are components, the largest entry of each positive) and variances of the standardised
    columns, largest first."""
    variance, loadings = np.linalg.eigh(m.correlation())
    variance, loadings = variance[::-1], loadings[:, ::-1]
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    return loadings * sign, variance


def project(df: DataFrame, cols: list[str], m: Moments, loadings: np.ndarray, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Scores of every row: standardised columns times loadings, as pc1, pc2 ..."""
    data = doubles(df, cols, keep)
    kept = [f for f in data.schema.fields if f.name not in cols]
    names, mean, sd = [f"pc{i + 1}" for i in range(loadings.shape[1])], m.mean, m.sd

    def score(batches):
        for batch in batches:
            z = (_matrix(batch, cols) - mean) / sd @ loadings
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in kept] + [pa.array(c) for c in z.T],
                                             names=[f.name for f in kept] + names)

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{n} double" for n in names])
    return data.mapInArrow(score, schema)


# ---- k-means -----------------------------------------------------------------------

def start_centres(data: DataFrame, cols: list[str], k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, columns): rows drawn without replacement for each start from the distinct rows among the
    ``8 k starts`` of smallest hash; runs and layouts agree."""
    few = data.select(*cols).distinct().orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(8 * k * starts).collect()
    rows = np.array([list(r) for r in few], dtype=float)
    if len(rows) < k:
        raise ValueError(f"fewer than {k} distinct rows")
    rng = np.random.default_rng(seed)
    return np.stack([rows[rng.choice(len(rows), k, replace=False)] for _ in range(starts)])


def _assigned(data: DataFrame, cols: list[str], centres: np.ndarray) -> np.ndarray:
    """(starts * k, columns + 2): sums of the rows nearest to each centre, their number and squared distance."""
    starts, k, d = centres.shape

    def reduce(batches):
        out = np.zeros((starts * k, d + 2))
        for batch in batches:
            x = _matrix(batch, cols)
            for s in range(starts):
                distance = ((x[:, None, :] - centres[s][None]) ** 2).sum(axis=2)
                near = distance.argmin(axis=1)
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), near] = 1
                out[s * k:(s + 1) * k, :d] += one.T @ x
                out[s * k:(s + 1) * k, d] += one.sum(axis=0)
                out[s * k:(s + 1) * k, d + 1] += one.T @ distance[np.arange(len(x)), near]
        yield _cells(out)

    return _total(data.mapInArrow(reduce, _CELLS), (starts * k, d + 2))


def kmeans(data: DataFrame, cols: list[str], centres: np.ndarray, max_iter: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lloyd's iterations of all starts together: (centres, sizes, costs) of every start, costs and sizes those of
    the returned centres.  ``data`` is read once an iteration for all starts still moving; an empty cluster keeps
    its centre."""
    starts, k, d = centres.shape
    centres, moving = centres.copy(), np.ones(starts, bool)
    for _ in range(max_iter):
        s = _assigned(data, cols, centres[moving]).reshape(-1, k, d + 2)
        n = s[:, :, d:d + 1]
        new = np.where(n > 0, s[:, :, :d] / np.maximum(n, 1), centres[moving])
        changed = (new != centres[moving]).any(axis=(1, 2))
        centres[moving] = new
        moving[np.flatnonzero(moving)[~changed]] = False
        if not moving.any():
            break
    s = _assigned(data, cols, centres).reshape(starts, k, d + 2)
    return centres, s[:, :, d].astype(np.int64), s[:, :, d + 1].sum(axis=1)
