"""Windows over a key's whole series that don't need the whole series in one task.

A series of more than `rows` rows is cut into slices at quantiles of its time. What a window needs from outside a slice is either the result so far at
the end of the slices before it (sums, extremes, last known values: each slice's last row has its summary, the summaries are scanned, and the scan is
joined back), or a few rows beyond its borders (bounded frames: those rows are dealt to the neighbouring slices too, as a halo). So one device with all rows is many
tasks, and a table without long series has the plan of plain windows.

Each step reads a cut table several times, so it is settled first: else every step would compute all before it anew for each reading. The cuts are approximate quantiles, which
can differ from one computation to the next; they are settled too, so that all readings see the same slices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.staging import settled

ROWS, PARTS = 50_000, 256
HELPERS = ("_slice", "_long")


@dataclass(frozen=True)
class Fold:
    """What is known at a row from all rows up to it (backwards: from it on)."""

    inside: Callable[[WindowSpec], Column]  # over the rows of one slice up to this one; backwards: from its end down to this one
    across: Callable[[Column, WindowSpec], Column]  # of slices' results, over the slices before this one
    both: Callable[[Column, Column], Column]  # what came before, and inside
    backwards: bool = False


def either(a: Column, b: Column, together: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(together)


def total(x: Column) -> Fold:
    return Fold(lambda w: F.sum(x).over(w), lambda c, w: F.sum(c).over(w), lambda a, b: either(a, b, a + b))


def remaining(x: Column) -> Fold:
    """The sum from here on."""
    return Fold(lambda w: F.sum(x).over(w), lambda c, w: F.sum(c).over(w), lambda a, b: either(a, b, a + b), backwards=True)


def number() -> Fold:
    """1 for the first row, and so on."""
    return total(F.lit(1))


def highest(x: Column) -> Fold:
    return Fold(lambda w: F.max(x).over(w), lambda c, w: F.max(c).over(w), lambda a, b: F.greatest(a, b))


def first(x: Column) -> Fold:
    """The first value so far that isn't null."""
    return Fold(lambda w: F.first(x, ignorenulls=True).over(w), lambda c, w: F.first(c, ignorenulls=True).over(w), lambda a, b: F.coalesce(a, b))


def last(x: Column) -> Fold:
    """The last value so far that isn't null."""
    return Fold(lambda w: F.last(x, ignorenulls=True).over(w), lambda c, w: F.last(c, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a))


def upcoming(x: Column) -> Fold:
    """The first value from here on that isn't null."""
    return Fold(lambda w: F.last(x, ignorenulls=True).over(w), lambda c, w: F.first(c, ignorenulls=True).over(w), lambda a, b: F.coalesce(b, a), backwards=True)


class Series:
    """Rows in series: by key, in order. rows: longer series are cut, where the first column of order changes its value.

    Equal times stay in one slice. A null key is a series of its own; a null time comes first. Columns that begin with _slice, and _long, are this class's own.
    """

    def __init__(self, df: DataFrame, key: str, order: list[str], rows: int | None = None, cut: list[str] | None = None) -> None:
        self.df, self.key, self.order = df, key, order
        self.ready = False  # whether df can be read several times at little cost
        if cut is not None:
            self.columns = cut
            return
        self.columns = df.columns
        rows = rows or ROWS
        sizes = lambda d: d.groupBy(F.col(key).alias("_slice_key")).agg(F.count(F.lit(1)).alias("_slice_n")).where(F.col("_slice_n") > rows)
        if sizes(df).isEmpty():
            return
        df, self.ready = settled(df), True
        time = order[0]
        grid = [k / PARTS for k in range(1, PARTS)]
        long = df.select(F.col(key), F.col(time).alias("_slice_time")).join(F.broadcast(sizes(df)), F.col(key).eqNullSafe(F.col("_slice_key")))
        every = F.ceil(F.lit(PARTS * rows) / F.col("_slice_n"))
        cuts = long.groupBy("_slice_key").agg(F.percentile_approx("_slice_time", grid, 20 * PARTS).alias("_slice_all"), F.first("_slice_n").alias("_slice_n"))
        cuts = cuts.select("_slice_key", F.array_distinct(F.filter("_slice_all", lambda _, i: (i + 1) % every == 0)).alias("_slice_cuts"))
        cuts = settled(cuts)
        at = F.size(F.filter("_slice_cuts", lambda c: c < F.col(time)))
        cut_rows = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_slice_key")), "left")
        self.df = cut_rows.select(*df.columns, F.when(F.col("_slice_cuts").isNull(), 0).otherwise(F.coalesce(at, F.lit(0))).alias("_slice"), F.col("_slice_cuts").isNotNull().alias("_long"))

    @property
    def is_cut(self) -> bool:
        return "_slice" in self.df.columns

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(*HELPERS)

    def same(self, df: DataFrame, ready: bool = False) -> Series:
        """The series with other columns. ready: df is as easily read as this one's."""
        made = Series(df, self.key, self.order, cut=[c for c in df.columns if c not in HELPERS])
        made.ready = ready and self.ready
        return made

    def with_columns(self, **columns: Column) -> Series:
        return self.same(self.df.withColumns(columns), ready=True)

    def at_hand(self) -> Series:
        """This series, and if it is cut, computed: for what reads it several times."""
        if self.is_cut and not self.ready:
            self.df, self.ready = settled(self.df), True
        return self

    def beside(self, table: DataFrame) -> DataFrame:
        """A table of one row a key, to be joined to this series' rows. A join by key would bring a whole series into one task, so where series are cut the table is broadcast."""
        return F.broadcast(table) if self.is_cut else table

    def window(self, *also: str, backwards: bool = False) -> WindowSpec:
        return Window.partitionBy(self.key, *also).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in self.order))

    def others(self, new: dict) -> list[str]:
        """The columns that new ones don't replace."""
        return [c for c in self.df.columns if c not in new]

    def running(self, **folds: Fold) -> Series:
        """With a column for each fold."""
        self.at_hand()
        within = ["_slice"] if self.is_cut else []
        w = self.window(*within)
        # A frame up to the last row would be summed anew for each row; in reverse order it is a running one.
        so_far = [x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, self.window(*within, backwards=True))]
        inside = {n: f.inside(so_far[f.backwards]) for n, f in folds.items()}
        if not self.is_cut:
            return self.same(self.df.select(*self.others(folds), *(c.alias(n) for n, c in inside.items())))
        here = [c.alias(f"_slice_{n}") for n, c in inside.items()]
        ends = self.df.where("_long").select(F.col(self.key).alias("_slice_key"), F.col("_slice").alias("_slice_at"), *here, F.lag(F.lit(1)).over(w).isNull().alias("_slice_head"), F.lead(F.lit(1)).over(w).isNull().alias("_slice_tail"))
        summary = [F.first(F.when(F.col("_slice_head" if f.backwards else "_slice_tail"), F.col(f"_slice_{n}")), ignorenulls=True).alias(f"_slice_{n}") for n, f in folds.items()]
        slices = ends.where("_slice_head or _slice_tail").groupBy("_slice_key", "_slice_at").agg(*summary)
        order = Window.partitionBy("_slice_key").orderBy("_slice_at")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        carried = slices.select("_slice_key", "_slice_at", *(f.across(F.col(f"_slice_{n}"), after if f.backwards else before).alias(f"_slice_{n}_before") for n, f in folds.items()))
        both = self.df.select("*", *here).join(carried, F.col(self.key).eqNullSafe(F.col("_slice_key")) & (F.col("_slice") == F.col("_slice_at")), "left")
        return self.same(both.select(*self.others(folds), *(f.both(F.col(f"_slice_{n}_before"), F.col(f"_slice_{n}")).alias(n) for n, f in folds.items())))

    def framed(self, before: int, after: int = 0, /, **columns: Callable[[WindowSpec], Column]) -> Series:
        """With columns made from a window that is ordered but has no frame yet; they may look `before` rows back and `after` rows ahead."""
        if not self.is_cut:
            return self.same(self.df.select(*self.others(columns), *(f(self.window()).alias(n) for n, f in columns.items())))
        self.at_hand()
        long, k = self.df.where("_long"), F.col(self.key).alias("_slice_key")
        order = Window.partitionBy("_slice_key").orderBy("_slice_at")
        sizes = long.groupBy(k, F.col("_slice").alias("_slice_at")).agg(F.count(F.lit(1)).alias("_slice_size"))
        starts = sizes.withColumn("_slice_end", F.sum("_slice_size").over(order)).withColumn("_slice_start", F.col("_slice_end") - F.col("_slice_size"))
        later, earlier = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
        # A row is also of use to later slices that begin at most `before` rows after it, and to earlier ones that end at most `after` rows before it.
        near = starts.select("_slice_key", "_slice_at", "_slice_start", "_slice_end", F.collect_list(F.struct(F.col("_slice_at").alias("s"), (F.col("_slice_start") - before).alias("p"))).over(later).alias("_slice_on"), F.collect_list(F.struct(F.col("_slice_at").alias("s"), (F.col("_slice_end") + after).alias("p"))).over(earlier).alias("_slice_back"))
        near = near.select("_slice_key", "_slice_at", "_slice_start", F.filter("_slice_on", lambda x: x["p"] < F.col("_slice_end")).alias("_slice_on"), F.filter("_slice_back", lambda x: x["p"] > F.col("_slice_start")).alias("_slice_back"))
        placed = long.withColumn("_slice_row", F.row_number().over(self.window("_slice"))).join(near, F.col(self.key).eqNullSafe(F.col("_slice_key")) & (F.col("_slice") == F.col("_slice_at")))
        p = F.col("_slice_start") + F.col("_slice_row") - 1
        to = F.concat(F.array("_slice"), F.transform(F.filter("_slice_on", lambda x: x["p"] <= p), lambda x: x["s"]), F.transform(F.filter("_slice_back", lambda x: x["p"] > p), lambda x: x["s"]))
        dealt = placed.select(*self.df.columns, F.explode(to).alias("_slice_to"))
        every = self.df.where("not _long").withColumn("_slice_to", F.col("_slice")).unionByName(dealt)
        w = self.window("_slice_to")
        made = every.select(*self.others(columns), "_slice_to", *(f(w).alias(n) for n, f in columns.items())).where(F.col("_slice_to") == F.col("_slice"))
        return self.same(made.drop("_slice_to"))
