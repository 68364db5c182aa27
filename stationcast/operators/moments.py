"""Counts, means and co-moments of many columns by group, and least squares from them.

A group's moments are the number of its rows, the mean of each value and, for each pair of
values, the sum of the products of their deviations from the means. Moments of parts add up
to those of the whole without loss, so one scan gives them for every fold block, station or
table: tasks combine what they read, at most one row for each group and task is shuffled
(a group may hold any share of the rows), and equal groups are combined again. Matrix
products run in Arrow batches; the work per row is a rank-one update, as in a Gram matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Groups that a task holds before it hands them on.
HELD = 4096
#: Columns whose variance given the columns before is below this share of their own are dependent.
TOLERANCE = 1e-10


@dataclass
class Groups:
    """Moments of several groups: one row of ``keys``, ``n``, ``mean`` and ``co`` each.

    ``co`` has the upper triangle of each group's matrix, row by row.
    """

    keys: pa.Table
    n: np.ndarray
    mean: np.ndarray
    co: np.ndarray

    def __len__(self) -> int:
        return len(self.n)


def _codes(keys: pa.Table, rows: int) -> np.ndarray:
    """A number for each row that is equal for equal keys (null is a key like any other)."""
    code = np.zeros(rows, np.int64)
    for column in keys.columns:
        own = column.combine_chunks().dictionary_encode(null_encoding="encode")
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        code = np.unique(code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def combine(keys: pa.Table, n: np.ndarray, mean: np.ndarray, co: np.ndarray | None = None) -> Groups:
    """One row for each distinct key. Single readings are groups with ``n`` of 1 and no ``co``."""
    code = _codes(keys, len(n))
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    n, mean = n[order].astype(float), mean[order]
    total = np.add.reduceat(n, starts)
    # deviations from the first value of the group first, so that large means cost no digits
    base = mean[starts]
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
    center = base + np.add.reduceat((mean - base[group]) * n[:, None], starts) / total[:, None]
    apart = (mean - center[group]) * np.sqrt(n)[:, None]
    upper = np.triu_indices(mean.shape[1])
    if len(starts) * 64 < len(order):
        stops = np.append(starts[1:], len(order))
        own = np.array([(apart[a:b].T @ apart[a:b])[upper] for a, b in zip(starts, stops, strict=True)])
    else:
        own = np.add.reduceat(apart[:, upper[0]] * apart[:, upper[1]], starts)
    if co is not None:
        own += np.add.reduceat(co[order], starts)
    return Groups(keys.take(pa.array(order[starts])), total, center, own)


def _joined(parts: list[Groups]) -> Groups:
    return combine(
        pa.concat_tables([p.keys for p in parts]),
        np.concatenate([p.n for p in parts]),
        np.concatenate([p.mean for p in parts]),
        np.concatenate([p.co for p in parts]),
    )


def _square(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def moments(df: DataFrame, values: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n``, ``means`` and ``co`` of the array ``values``; rows with a null or NaN value are left out.

    All arrays must have the same length.
    """
    ship(df.sparkSession)
    by = list(by)
    own = df.select(*by, values.cast("array<double>").alias("values"))
    known = own.filter(F.col("values").isNotNull() & ~F.exists("values", lambda v: v.isNull() | F.isnan(v)))

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Groups] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.Table.from_batches([batch]).select(by)
            held.append(combine(keys, np.ones(batch.num_rows), _square(batch.column(len(by)), batch.num_rows)))
            if sum(map(len, held)) > HELD or len(held) > 64:
                held = [_joined(held)]
                if len(held[0]) > HELD:
                    yield _made(held.pop(), by)
        if held:
            yield _made(_joined(held), by)

    return add_up(known.mapInArrow(by_task, _schema(df, by)), by)


def add_up(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of larger groups from those of their parts: rows of :func:`moments` (``n``, ``means``, ``co``) by ``by``."""
    ship(found.sparkSession)
    by = list(by)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; the last group of a batch may go on in the next."""
        last: list[Groups] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at = pa.Table.from_batches([batch]).select(by), len(by)
            own = combine(keys, batch.column(at).to_numpy(), *(_square(batch.column(at + i), batch.num_rows) for i in (1, 2)))
            whole = _joined([*last, own])
            here = np.ones(1, bool)
            if by:
                tail = pa.Table.from_batches([batch.slice(batch.num_rows - 1)]).select(by)
                code = _codes(pa.concat_tables([whole.keys, tail]), len(whole) + 1)
                here = code[:-1] == code[-1]
            last = [_part(whole, np.flatnonzero(here))]
            if not here.all():
                yield _made(_part(whole, np.flatnonzero(~here)), by)
        if last:
            yield _made(last[0], by)

    narrow = found.select(*by, "n", "means", "co")
    gathered = narrow.repartition(*by).sortWithinPartitions(*by) if by else narrow.repartition(1)
    return gathered.mapInArrow(by_group, _schema(found, by))


def _schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    lists = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("means", "co")]
    return T.StructType([*(df.schema[c] for c in by), T.StructField("n", T.LongType()), *lists])


def _made(found: Groups, by: Sequence[str]) -> pa.RecordBatch:
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (found.mean, found.co)]
    columns = [*(c.combine_chunks() for c in found.keys.columns), pa.array(found.n.astype(np.int64)), *lists]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, [*by, "n", "means", "co"])


def _part(found: Groups, at: np.ndarray) -> Groups:
    return Groups(found.keys.take(pa.array(at)), found.n[at], found.mean[at], found.co[at])


@dataclass(frozen=True)
class Fit:
    """A linear rule and the number of columns that it really depends on."""

    coefficients: np.ndarray
    intercept: float
    rank: int


def matrix_of(upper: np.ndarray) -> np.ndarray:
    """The symmetric matrix with this upper triangle."""
    size = int((np.sqrt(8 * len(upper) + 1) - 1) / 2)
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = upper
    return out + np.triu(out, 1).T


def independent(corr: np.ndarray, tolerance: float = TOLERANCE) -> tuple[list[int], np.ndarray]:
    """Columns that no others determine, by pivoted Cholesky, and the factor's rows for all columns."""
    left = corr.diagonal().copy()
    factor = np.zeros((len(corr), 0))
    chosen: list[int] = []
    while len(chosen) < len(corr):
        at = int(np.argmax(left))
        if left[at] <= tolerance:
            break
        row = (corr[:, at] - factor @ factor[at]) / np.sqrt(left[at])
        factor = np.column_stack([factor, row])
        chosen.append(at)
        left = left - row**2
        left[chosen] = -1.0
    return chosen, factor


def least_squares(mean: Sequence[float], co: Sequence[float], tolerance: float = TOLERANCE) -> Fit:
    """The fit of the last value to the others, of all best ones the one with the smallest coefficients.

    Constant and dependent columns are found by a pivoted Cholesky factor of the
    correlations; the solution over independent columns is then freed of its part in the
    null space, which gives the minimum-norm solution in the columns' own units.
    """
    mean, whole = np.asarray(mean, float), matrix_of(np.asarray(co, float))
    gram, moment = whole[:-1, :-1], whole[:-1, -1]
    size = len(moment)
    scale = np.sqrt(gram.diagonal())
    varied = np.flatnonzero(scale > 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300))
    solution = np.zeros(size)
    rank = 0
    if len(varied):
        corr = gram[np.ix_(varied, varied)] / np.outer(scale[varied], scale[varied])
        chosen, _ = independent(corr, tolerance)
        rank = len(chosen)
        core, wanted = corr[np.ix_(chosen, chosen)], (moment[varied] / scale[varied])[chosen]
        found = np.linalg.solve(core, wanted)
        found += np.linalg.solve(core, wanted - core @ found)  # one step of refinement
        solution[varied[chosen]] = found / scale[varied[chosen]]
        others = [i for i in range(len(varied)) if i not in chosen]
        if others:
            # each dependent column is a mixture of the chosen ones: that is a direction without effect
            mixture = np.linalg.solve(core, corr[np.ix_(chosen, others)])
            null = np.zeros((size, len(others)))
            null[varied[chosen]] = -mixture / scale[varied[chosen], None] * scale[varied[others]]
            null[varied[others], np.arange(len(others))] = 1.0
            solution -= null @ np.linalg.lstsq(null, solution, rcond=None)[0]
    return Fit(solution, float(mean[-1] - mean[:-1] @ solution), rank)


def merged(rows: Sequence) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and co of all ``rows`` of :func:`moments` together."""
    n, mean, co = (np.array([r[c] for r in rows], float) for c in ("n", "means", "co"))
    one = combine(pa.table({"all": pa.array([0] * len(rows))}), n, mean, co)
    return float(one.n[0]), one.mean[0], one.co[0]


#: Tasks that add up the matrices of all others, before one adds up theirs.
ADDERS = 32
#: A spread below this share of the values is rounding.
ROUNDING = 1e-13


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a``, ``column_b``, ``n`` and ``correlation`` of all pairs, over rows where both are known.

    For columns X (0 where unknown) and their masks K, the sums of every pair are the
    products K'K, X'K, (X*X)'K and X'X: one array for each task and a plan of constant
    size, however many columns there are. The least value of a column is taken off first,
    so that large means cost no digits. NaN counts as unknown; a column that is constant
    over the rows of a pair has no correlation with the other.
    """
    ship(df.sparkSession)
    columns = list(columns)
    size = len(columns)
    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    base = df.agg(*[F.min(v).alias(f"m{i}") for i, v in enumerate(value)]).first()
    shift = np.array([0.0 if m is None else m for m in base])
    rows = df.select(F.array(*value).alias("values"))
    schema = T.StructType([T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size) - shift
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        if total.any():
            yield one(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * size * size)
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield one(total)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = next(add(batches)).column(0).flatten().to_numpy().reshape(4, size, size)
        n, sums, squares, products = total
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, other = sums / n, (sums / n).T
            spread = squares / n - mean**2
            rounding = (ROUNDING * np.maximum(np.abs(mean + shift[:, None]), np.abs(mean))) ** 2 + ROUNDING * squares / n
            spread = np.where(spread > rounding, spread, np.nan)
            found = (products / n - mean * other) / np.sqrt(spread * spread.T)
        found = np.clip(found, -1.0, 1.0)
        found[np.arange(size), np.arange(size)] = np.where(np.isnan(spread.diagonal()), np.nan, 1.0)
        a, b = np.indices((size, size)).reshape(2, -1)
        names = pa.array(columns)
        lists = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n.ravel().astype(np.int64)), pa.array(found.ravel(), from_pandas=True)]
        yield pa.RecordBatch.from_arrays(lists, ["column_a", "column_b", "n", "correlation"])

    partial = rows.mapInArrow(by_task, schema).repartition(ADDERS).mapInArrow(add, schema)
    return partial.repartition(1).mapInArrow(finish, "column_a string, column_b string, n long, correlation double")
