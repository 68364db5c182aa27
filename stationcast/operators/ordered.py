"""Ordered series that survive skew.

Lags, rolling frames, fills and row numbers need the rows of one series in
order. ``Window.partitionBy(station)`` does that with one shuffle, but puts all
rows of a station into one task. :func:`arrange` therefore looks at
the rows per series first (:func:`measure`):

* No series above ``max_rows``: plain windows over the series keys.
* Otherwise the big series are range-sorted on (keys, order) and cut into
  *segments* of ``max_rows`` rows, however the rows are spread: one station, one
  date or one group of equal rows may hold most of the table. Windows then run
  per (keys, segment), and what crosses a segment edge (last known value, row
  count, the last few rows) comes from a summary with one row per segment.

Segments keep their size when the table grows; there are more of them. Summaries
and keys of big series are broadcast up to ``MAX_PIECES`` rows, which is counted
first, and joined on (keys, segment) beyond that.

Rows without a series key belong to no series: fills, history, numbers and sums
are null for them, however many there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE, READINGS, STATION
from ..session import durable

#: Rows of a series that one window takes, and of a segment.
MAX_ROWS = 2_000_000
#: Rows of keys or summaries that are broadcast.
MAX_PIECES = 10_000

SEGMENT = "_segment"
SEQUENCE = "_sequence"
TIE = "_tie"
OTHER_TIE = "_other_tie"
HALO = "_halo"
KIND = "_kind"


def attach(rows: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join a table with one row per group to rows of any skew.

    The groups are written and counted; up to MAX_PIECES of them are broadcast, so that
    rows of a few large groups stay where they are.
    """
    groups = durable(groups, "groups")
    few = groups.limit(MAX_PIECES + 1).count() <= MAX_PIECES
    return rows.join(F.broadcast(groups) if few else groups, list(on))


class Part:
    """Rows of series that are all handled alike: whole, or cut into segments."""

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int = 0
    ):
        self.df = df
        self.keys = tuple(keys)
        self.order = tuple(order)
        self.segments = segments
        self.segmented = segments > 0

    def over(self, df: DataFrame) -> Part:
        """The same arrangement around changed rows (columns added or rows dropped)."""
        return Part(df, self.keys, self.order, self.segments)

    # -- window building blocks -------------------------------------------

    @property
    def partition(self) -> list[str]:
        return [*self.keys, SEGMENT] if self.segmented else list(self.keys)

    @property
    def window(self) -> WindowSpec:
        extra = (SEQUENCE,) if self.segmented else ()
        return Window.partitionBy(*self.partition).orderBy(*self.order, *extra)

    def _keyed(self, value: Column) -> Column:
        """``value`` for rows that belong to a series, else null."""
        for key in self.keys:
            value = F.when(F.col(key).isNotNull(), value)
        return value

    def _segments(self, *aggregates: Column) -> DataFrame:
        """One row per segment of the big series."""
        return self.df.groupBy(*self.keys, SEGMENT).agg(*aggregates)

    def _across(self, start: int, end: int) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(SEGMENT).rowsBetween(start, end)

    def _attach(self, df: DataFrame, summary: DataFrame) -> DataFrame:
        """Join a per-segment summary to the rows: broadcast while there are few, else by (keys, segment)."""
        # a segment can hold the end of one series and the start of the next
        few = self.segments <= MAX_PIECES
        return df.join(F.broadcast(summary) if few else summary, [*self.keys, SEGMENT], "left")

    # -- operators ---------------------------------------------------------

    def fill(
        self, columns: Sequence[str], forward: bool = True, into: Callable[[str], str] = str
    ) -> Part:
        """Carry the last known value forward (or the next one backward).

        Rows without a series key come out null.
        """
        columns = [c for c in columns if c in self.df.columns]
        first, last = Window.unboundedPreceding, Window.unboundedFollowing
        frame = self.window.rowsBetween(first, 0) if forward else self.window.rowsBetween(0, last)
        pick = F.last if forward else F.first
        df = self.df
        near = {c: pick(F.col(c), ignorenulls=True).over(frame) for c in columns}
        if self.segmented:
            edge = F.max_by if forward else F.min_by
            summary = self._segments(
                *[
                    edge(F.col(c), F.when(F.col(c).isNotNull(), F.col(SEQUENCE))).alias(f"_in_{c}")
                    for c in columns
                ]
            )
            beyond = self._across(first, -1) if forward else self._across(1, last)
            summary = summary.withColumns(
                {f"_in_{c}": pick(F.col(f"_in_{c}"), ignorenulls=True).over(beyond) for c in columns}
            )
            df = self._attach(df.withColumns({f"_near_{c}": e for c, e in near.items()}), summary)
            near = {c: F.coalesce(F.col(f"_near_{c}"), F.col(f"_in_{c}")) for c in columns}
        out = df.withColumns({into(c): self._keyed(e) for c, e in near.items()})
        if self.segmented:
            out = out.drop(*[f"_{side}_{c}" for c in columns for side in ("near", "in")])
        return self.over(out)

    def number(self, position: str = "_position", size: str | None = None) -> Part:
        """Exact 1-based row number in the series, and the size of the series."""
        whole = Window.partitionBy(*self.partition)
        added = {position: F.row_number().over(self.window).cast("long")}
        if size:
            added[size] = F.count(F.lit(1)).over(whole)
        df = self.df.withColumns({name: self._keyed(e) for name, e in added.items()})
        if self.segmented:
            first, last = Window.unboundedPreceding, Window.unboundedFollowing
            summary = self._segments(F.count(F.lit(1)).alias("_count")).select(
                *self.keys,
                SEGMENT,
                F.sum("_count").over(self._across(first, -1)).alias("_before"),
                F.sum("_count").over(self._across(first, last)).alias("_all"),
            )
            df = self._attach(df, summary).withColumn(
                position, F.col(position) + F.coalesce("_before", F.lit(0))
            )
            if size:
                df = df.withColumn(size, F.coalesce("_all", size))
            df = df.drop("_before", "_all")
        return self.over(df)

    def running_sum(self, weight: str, into: str, total: str | None = None) -> Part:
        """Sum of ``weight`` up to and including each row, and over the series."""
        first, last = Window.unboundedPreceding, Window.unboundedFollowing
        added = {into: F.sum(weight).over(self.window.rowsBetween(first, 0))}
        if total:
            added[total] = F.sum(weight).over(Window.partitionBy(*self.partition))
        df = self.df.withColumns({name: self._keyed(e) for name, e in added.items()})
        if self.segmented:
            summary = self._segments(F.sum(weight).alias("_sum")).select(
                *self.keys,
                SEGMENT,
                F.sum("_sum").over(self._across(first, -1)).alias("_before"),
                F.sum("_sum").over(self._across(first, last)).alias("_all"),
            )
            df = self._attach(df, summary).withColumn(
                into, F.col(into) + F.coalesce("_before", F.lit(0))
            )
            if total:
                df = df.withColumn(total, F.coalesce("_all", total))
            df = df.drop("_before", "_all")
        return self.over(df)

    def history(
        self, depth: int, inputs: Sequence[str], build: Callable[[WindowSpec], dict[str, Column]]
    ) -> Part:
        """Columns that look back at most ``depth`` rows of ``inputs``.

        In big series each segment is preceded by the last ``depth`` rows of the
        segments before it, so that ``build`` sees the same rows as in one piece.
        """
        df = self.df
        if self.segmented:
            df = df.withColumn(HALO, F.lit(False)).unionByName(
                self._halo(depth, inputs), allowMissingColumns=True
            )
        df = df.withColumns({name: self._keyed(e) for name, e in build(self.window).items()})
        if self.segmented:
            df = df.filter(~F.col(HALO)).drop(HALO)
        return self.over(df)

    def _halo(self, depth: int, inputs: Sequence[str]) -> DataFrame:
        """The last ``depth`` rows before each segment, whichever segments they are in."""
        needed = list(dict.fromkeys([*self.order, SEQUENCE, *inputs]))
        latest = Window.partitionBy(*self.keys, SEGMENT).orderBy(F.desc(SEQUENCE))
        tails = (
            self.df.select(*self.keys, SEGMENT, *needed)
            .withColumn("_back", F.row_number().over(latest))
            .filter(F.col("_back") <= depth)
        )
        # of the tails of a series, in order, the ``depth`` rows before a segment's first one
        series = Window.partitionBy(*self.keys).orderBy(SEGMENT, SEQUENCE)
        before = F.collect_list(F.struct(*needed)).over(series.rowsBetween(-depth, -1))
        begins = ~F.col(SEGMENT).eqNullSafe(F.lag(SEGMENT).over(series))
        return (
            tails.select(*self.keys, SEGMENT, before.alias("_before"), begins.alias("_begins"))
            .filter("_begins")
            .select(*self.keys, SEGMENT, F.explode("_before").alias("_kept"))
            .select(*self.keys, SEGMENT, "_kept.*")
            .withColumn(HALO, F.lit(True))
        )


class Ordered:
    """A table arranged into ordered series.

    Small series go through plain windows, big ones by segment; ``loose`` holds
    rows without a series key when there are too many for one window. They take
    part in no series and get nulls, as such rows do inside a window.
    """

    def __init__(self, parts: Sequence[Part], columns: Sequence[str], loose: DataFrame | None = None):
        self.parts = list(parts)
        self.columns = tuple(columns)
        self.loose = loose

    @property
    def segmented(self) -> bool:
        return any(part.segmented for part in self.parts)

    def _each(self, fn: Callable[[Part], Part], loose: DataFrame | None = None) -> Ordered:
        kept = loose if loose is not None else self.loose
        return Ordered([fn(part) for part in self.parts], self.columns, kept)

    def map(self, fn: Callable[[DataFrame], DataFrame], loose: bool = True) -> Ordered:
        """Apply a row-wise change, by default to the loose rows too."""
        changed = fn(self.loose) if loose and self.loose is not None else None
        return self._each(lambda part: part.over(fn(part.df)), changed)

    def fill(
        self, columns: Sequence[str], forward: bool = True, into: Callable[[str], str] = str
    ) -> Ordered:
        loose = self.loose
        if loose is not None:
            types = {c: t for c, t in loose.dtypes if c in columns}
            loose = loose.withColumns({into(c): F.lit(None).cast(t) for c, t in types.items()})
        return self._each(lambda part: part.fill(columns, forward, into), loose)

    def number(self, position: str = "_position", size: str | None = None) -> Ordered:
        return self._each(lambda part: part.number(position, size), self._nulls(position, size))

    def running_sum(self, weight: str, into: str, total: str | None = None) -> Ordered:
        return self._each(lambda part: part.running_sum(weight, into, total), self._nulls(into, total))

    def _nulls(self, *names: str | None) -> DataFrame | None:
        """The loose rows with empty columns of these names."""
        if self.loose is None:
            return None
        return self.loose.withColumns({n: F.lit(None).cast("long") for n in names if n})

    def history(
        self, depth: int, inputs: Sequence[str], build: Callable[[WindowSpec], dict[str, Column]]
    ) -> Ordered:
        return self._each(lambda part: part.history(depth, inputs, build))

    def result(self) -> DataFrame:
        """All rows without helper columns, in the column order of the input."""
        helpers = [c for c in (SEGMENT, SEQUENCE, KIND, TIE, OTHER_TIE) if c not in self.columns]
        tables = [part.df.drop(*helpers) for part in self.parts]
        if self.loose is not None:
            tables.append(self.loose.drop(*helpers))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
        first = [c for c in self.columns if c in df.columns]
        return df.select(*[f"`{c}`" for c in [*first, *[c for c in df.columns if c not in first]]])


@dataclass(frozen=True)
class Sizes:
    """Rows in total, in the largest series and in all series above the limit.

    ``big`` holds the keys of those series: a written table, which grows with the
    rows divided by ``limit`` at most. ``n_big`` counts it.
    """

    total: int
    largest: int
    limit: int
    big: DataFrame | None = None
    n_big: int = 0
    big_rows: int = 0
    loose: bool = False


def measure(df: DataFrame, keys: Sequence[str] = (STATION,), max_rows: int = MAX_ROWS) -> Sizes:
    """Series sizes of ``df``, from one aggregate over the key columns.

    Dropping rows or adding columns later keeps the result good as an upper
    bound, so one measurement serves a whole chain of operators.
    """
    keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    above = F.col("_rows") > max_rows
    total, largest, n_big, big_rows, loose = counts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)),
        F.coalesce(F.max("_rows"), F.lit(0)),
        F.count_if(above & keyed),
        F.coalesce(F.sum(F.when(above & keyed, F.col("_rows"))), F.lit(0)),
        F.count_if(above & ~keyed) > 0,
    ).first()
    big = durable(counts.filter(above & keyed).select(*keys), "big") if keys and n_big else None
    return Sizes(total, largest, max_rows, big, n_big, big_rows, loose)


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType)


def with_tie(df: DataFrame) -> DataFrame:
    """``df`` with a column that orders rows equal in date, for a chain of operators to share.

    :func:`arrange` uses and keeps such a column. Without it each call orders such rows
    by a hash of their readings, so operators that add columns leave the order alone and
    only those that change readings in between can change it.
    """
    return df.withColumn(TIE, F.xxhash64(*_hashable(df, df.columns)))


def _hashable(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names if _orderable(df.schema[c].dataType)] or [F.lit(0)]


def arrange(
    df: DataFrame,
    keys: Sequence[str] = (STATION,),
    order: Sequence[str] = (DATE,),
    tiebreak: Sequence[str] | None = None,
    max_rows: int = MAX_ROWS,
    sizes: Sizes | None = None,
) -> Ordered:
    """Arrange ``df`` into series by ``keys``, ordered by ``order``.

    Rows equal in ``order`` are ordered by ``tiebreak``. By default that is the column
    of :func:`with_tie` if there is one, else a hash of the readings and then one of all
    other columns, so that results depend neither on the layout of the input nor on
    columns added on the way. Pass an empty tiebreak when (keys, order) is known to be
    unique.

    ``sizes``, measured here unless given, decide between windows per series and
    windows per segment; both give the same rows. The whole table taken as one series
    (no keys) always goes by segment.
    """
    keys, columns = tuple(keys), df.columns
    sizes = sizes or measure(df, keys, max_rows)
    if tiebreak is None and TIE in columns:
        tiebreak = (TIE,)
    elif tiebreak is None:
        own = [c for c in columns if c in READINGS]
        rest = [c for c in columns if c not in READINGS]
        df = df.withColumns({TIE: F.xxhash64(*_hashable(df, own)), OTHER_TIE: F.xxhash64(*_hashable(df, rest))})
        tiebreak = (TIE, OTHER_TIE)
    order = tuple(dict.fromkeys([*order, *tiebreak]))
    if not keys:
        pieces = max(2, math.ceil(sizes.total / sizes.limit))
        return Ordered([Part(_cut(df, keys, order, pieces), keys, order, pieces)], columns)
    if sizes.big is None and not sizes.loose:
        return Ordered([Part(df, keys, order)], columns)
    # one pass says what each row is; the parts are read from the written table
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    kind = F.when(no_key, "loose") if sizes.loose else F
    if sizes.big is not None:
        big = sizes.big.withColumn("_big", F.lit(True))
        df = df.join(F.broadcast(big) if sizes.n_big <= MAX_PIECES else big, list(keys), "left")
        kind = kind.when(F.col("_big"), "big")
    tagged = durable(df.withColumn(KIND, kind.otherwise("small")).drop("_big"), "kinds", by=[KIND])
    parts = [Part(tagged.filter(F.col(KIND) == "small"), keys, order)]
    if sizes.big is not None:
        pieces = max(2, math.ceil(sizes.big_rows / sizes.limit))
        cut = _cut(tagged.filter(F.col(KIND) == "big"), keys, order, pieces)
        # a series that ends inside a piece shares it with the next one
        parts.append(Part(cut, keys, order, pieces + sizes.n_big))
    return Ordered(parts, columns, tagged.filter(F.col(KIND) == "loose") if sizes.loose else None)


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int) -> DataFrame:
    """Range-sort into ``pieces`` and number segments and rows.

    The input partition is the last sort key: equal rows have no order of their
    own, and it keeps a large group of them from landing in one piece. Writing
    the result fixes the numbers, which the summaries and the rows both use.
    """
    return durable(
        df.withColumn("_source", F.spark_partition_id())
        .repartitionByRange(pieces, *keys, *order, "_source")
        .sortWithinPartitions(*keys, *order)
        .withColumns(
            {SEGMENT: F.spark_partition_id() + 1, SEQUENCE: F.monotonically_increasing_id()}
        )
        .drop("_source")
    )
