"""Ordered per-key scans that stay bounded when one key holds a large share of the rows.

A plain window puts a whole key into one task. ``Scan`` first looks for keys with more than ``max_rows`` rows
in a sample of the key column. While there is none it is a plain window: one shuffle, one sort. Keys above the
bound are cut into slices at quantiles of the whole order, ties included; the window then runs per (key, slice) and the
value crossing a slice edge comes from one summary row per slice. All columns of a chain share one summary pass.

The sample only decides where to cut. Every row is processed wherever the cuts fall, and any cut gives the
same result; a key missed by the sample would merely make one task longer. The number of slices has no limit.

Rows that agree in the whole order stay in one slice.

The sample also tells how many rows there are. Where the session's shuffle may give a task more than ``TASK_ROWS`` of
them, they are dealt to more tasks, so that a task's share does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from twinclock.session import materialise

MAX_ROWS = 4_000_000      # rows of one key a single task may sort
TASK_ROWS = 1_000_000     # rows of all keys that a task gets on average, at most
SAMPLES = 400             # expected sample rows of a key with MAX_ROWS rows
BROADCAST_POINTS = 2_000_000   # split points that are broadcast; beyond it the optimiser chooses the join
_SPLITS, _SLICE = "__splits", "__slice"


@dataclass(frozen=True)
class Hot:
    """Hot keys with their split points ``(keys..., __splits)``, the largest number of points of a key, and of all.

    The order columns of a scan that uses them need the types, not the names, of those they were found with."""
    splits: DataFrame
    most: int
    points: int

    def table(self, *columns: str) -> DataFrame:
        df = self.splits.select(*columns) if columns else self.splits
        return F.broadcast(df) if self.points <= BROADCAST_POINTS else df


def _place(order: list[str]) -> Column:
    return F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])


def find_hot(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None = None) -> Hot | None:
    """Keys with more than ``max_rows`` rows and where to cut them, or None.

    A key at the bound has SAMPLES sample rows on average and is taken from three quarters of that, so missing
    one is next to impossible. The points, two for every ``max_rows`` rows of a hot key, are written, not collected.
    A timeline never has more rows of an entity than its events, so the result for one serves the other.
    """
    return _find_hot(df, keys, order, max_rows)[0]


def _find_hot(df: DataFrame, keys: list[str], order: list[str], max_rows: int | None) -> tuple[Hot | None, int]:
    """The hot keys, or None, and the number of rows by the sample."""
    max_rows = max_rows or MAX_ROWS
    fraction = min(1.0, SAMPLES / max_rows)
    sample = df.select(*keys, _place(order).alias("p"))
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=42)
    limit = max_rows * fraction * (0.75 if fraction < 1.0 else 1.0)
    counts = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    rows = ceil((seen["rows"] or 0) / fraction)
    if (seen["most"] or 0) <= limit:
        return None, rows
    hot = materialise(counts.filter(F.col("n") > limit).select(*keys), "hot-keys")
    stride = max(1, ceil(max_rows * fraction / 2))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("p"))
    cuts = sample.join(hot, keys, "left_semi").withColumn("nth", nth).filter(F.col("nth") % stride == 0)
    splits = materialise(cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias(_SPLITS)), "hot-splits")
    size = splits.agg(F.max(F.size(_SPLITS)).alias("most"), F.sum(F.size(_SPLITS)).alias("points")).first()
    return Hot(splits, size["most"] or 0, size["points"] or 0), rows


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as ``rows`` rows take, if the session's shuffle may have fewer: it has its
    number of partitions at most, and may join small ones as long as all cores have work."""
    tasks, spark = ceil(rows / TASK_ROWS), df.sparkSession
    fewest = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys) if tasks > fewest else df


def _slice_of(order: list[str], most: int) -> Column:
    """Number of split points <= the row's place, by binary search over the sorted points."""
    value = _place(order)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda pos, step: pos + F.when(F.get(_SPLITS, pos + step - 1) <= value, step).otherwise(0))


@dataclass(frozen=True)
class _Step:
    out: str
    inside: Callable[[WindowSpec], Column]
    summary: Column
    across: Callable[[WindowSpec, str], Column]
    merge: Callable[[Column, Column, WindowSpec], Column]


def _to_end(value: Column, w: WindowSpec, start: int) -> Column:
    """Sum from the row, or the one after it, to the end. A frame that ends with the partition would be summed anew for every
    row; the whole and what comes before are each summed once."""
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, start - 1))
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(before, F.lit(0))


class Scan:
    """Adds window columns over rows of each key, ordered by ``order``; see the module text.

    Rows of hot keys are kept apart from the others until ``result``, so those pay nothing for the slices.
    """

    def __init__(self, df: DataFrame, key, order: list[str], max_rows: int | None = None, hot="find"):
        self.keys = [key] if isinstance(key, str) else list(key)
        self.order = order
        self._waiting: list[_Step] = []
        rows = 0
        if isinstance(hot, str):
            hot, rows = _find_hot(df, self.keys, order, max_rows)
        self.cold, self.hot = df, None
        if hot is not None:
            self.cold = df.join(hot.table(*self.keys), self.keys, "left_anti")
            self.hot = df.join(hot.table(), self.keys).withColumn(_SLICE, _slice_of(order, hot.most)).drop(_SPLITS)
        self.cold = spread(self.cold, self.keys, rows)

    def _window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *more).orderBy(*self.order)

    def _add(self, uses, step: _Step) -> Scan:
        """Add a column. On a hot key, ``summary`` is one value per slice, ``across`` scans these over the slices
        of the key, and ``merge`` combines the result with the value inside the slice."""
        self.cold = self.cold.withColumn(step.out, step.inside(self._window()))
        if self.hot is not None:
            if uses in {s.out for s in self._waiting}:
                self._settle()
            self._waiting.append(step)
        return self

    def _settle(self) -> None:
        """Compute the waiting columns of the hot keys: one summary pass and one join for all of them."""
        if not self._waiting:
            return
        steps, self._waiting = self._waiting, []
        # summary and rows both read it: written once per pass, so that no pass doubles the plan before it
        self.hot = materialise(self.hot, "hot-rows")
        per_slice = self.hot.groupBy(*self.keys, _SLICE).agg(*[s.summary.alias(f"__v{i}") for i, s in enumerate(steps)])
        slices = Window.partitionBy(*self.keys).orderBy(_SLICE)
        carried = per_slice.select(*self.keys, _SLICE, *[s.across(slices, f"__v{i}").alias(f"__c{i}") for i, s in enumerate(steps)])
        w = self._window(_SLICE)
        self.hot = (self.hot.join(carried, [*self.keys, _SLICE], "left")
                    .withColumns({s.out: s.merge(s.inside(w), F.col(f"__c{i}"), w) for i, s in enumerate(steps)})
                    .drop(*[f"__c{i}" for i in range(len(steps))]))

    def lead(self, col: str, out: str) -> Scan:
        return self._neighbour(F.lead, F.min_by, col, out)

    def lag(self, col: str, out: str) -> Scan:
        return self._neighbour(F.lag, F.max_by, col, out)

    def _neighbour(self, step, edge, col: str, out: str) -> Scan:
        return self._add(col, _Step(
            out, lambda w: step(col).over(w), edge(F.struct(col), F.struct(*self.order)), lambda s, v: step(v).over(s),
            lambda inside, carry, w: F.when(step(F.lit(1)).over(w).isNotNull(), inside).otherwise(carry[col])))

    def last_known(self, col: str, out: str) -> Scan:
        """Latest non-null value up to and including the row."""
        known = F.when(F.col(col).isNotNull(), F.struct(*self.order))
        return self._add(col, _Step(
            out, lambda w: F.last(col, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.max_by(col, known),
            lambda s, v: F.last(v, True).over(s.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inside, carry, w: F.coalesce(inside, carry)))

    def max_before(self, col: str, out: str) -> Scan:
        """Maximum over all earlier rows."""
        return self._add(col, _Step(
            out, lambda w: F.max(col).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.max(col),
            lambda s, v: F.max(v).over(s.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inside, carry, w: F.greatest(inside, carry)))

    def running_sum(self, col, out: str, backward: bool = False) -> Scan:
        """Sum up to and including the row, or from it to the end; ``col`` may be a literal, as in ``F.lit(1)`` for a
        row number."""
        value = F.col(col) if isinstance(col, str) else col
        return self._add(col if isinstance(col, str) else None, _Step(
            out, lambda w: _to_end(value, w, 0) if backward else F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value),
            lambda s, v: _to_end(v, s, 1) if backward else F.sum(v).over(s.rowsBetween(Window.unboundedPreceding, -1)),
            lambda inside, carry, w: inside + F.coalesce(carry, F.lit(0))))

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Scan:
        """Apply a row-wise change, such as a filter or a new column."""
        self._settle()
        self.cold = change(self.cold)
        if self.hot is not None:
            self.hot = change(self.hot)
        return self

    def result(self) -> DataFrame:
        self._settle()
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop(_SLICE))
