"""Ordered computations: carry-forward, running offsets, as-of and interval joins, merged spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(value: Column, by: str, order: list[str]) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_before(value: Column, by: str, order: list[str]) -> Column:
    """Sum of the earlier rows; 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def in_context(changed: Column, by: str, order: list[str], around: int = 3) -> Column:
    """Whether any row within ``around`` rows is changed."""
    return F.max(changed.cast("int")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(-around, around)) == 1


def merge_spans(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Union of intervals [start, end) per group; touching ones are merged. Gaps and islands over a running maximum."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = spans.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def as_of(points: DataFrame, marks: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """points with the value of the last mark that starts at or before them.

    One union and one window instead of a range join: marks sort before points of the same position.
    """
    cols = [c for c in points.columns if c not in (by, at)]
    a = marks.select(by, F.col(start).alias(at), F.lit(0).alias("__kind"), F.col(value).alias("__v"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols])
    b = points.select(by, at, F.lit(1).alias("__kind"), F.lit(None).cast(marks.schema[value].dataType).alias("__v"), *cols)
    w = Window.partitionBy(by).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__kind = 1").drop("__kind", "__v")


def explode_ranges(ranges: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """One row per integer of [first, last]: turns a range join into an equi-join."""
    return ranges.where(F.col(first) <= F.col(last)).withColumn(out, F.explode(F.sequence(first, last)))


def overlaps(a: DataFrame, b: DataFrame, by: str, cell: int = 1024) -> DataFrame:
    """Pairs of intervals (a_start, a_end) and (b_start, b_end) of one group that overlap: s < e' and s' < e.

    Both sides are put into cells of fixed width and joined on them; a pair is kept in the
    cell where the later of the two starts lies, so it appears once.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        lo, hi = F.floor(F.col(f"{p}_start") / cell), F.floor((F.greatest(F.col(f"{p}_end"), F.col(f"{p}_start") + 1) - 1) / cell)
        return df.withColumn("__cell", F.explode(F.sequence(lo, hi)))

    both = dealt(a, "a").join(dealt(b, "b"), [by, "__cell"])
    own = F.floor(F.greatest("a_start", "b_start") / cell) == F.col("__cell")
    return both.where(own & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end"))).drop("__cell")


def percentile_at(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """sorted[floor((n - 1) * share)] per group, an element of the data and not an interpolation."""
    w = Window.partitionBy(by).orderBy(value)
    ranked = df.select(by, value, (F.row_number().over(w) - 1).alias("__k"), F.count("*").over(Window.partitionBy(by)).alias("__n"))
    return ranked.where(F.col("__k") == F.floor((F.col("__n") - 1) * share)).select(by, value)


def classification_rows(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Rows of a fixed-width classification table: columns at 0, 6, 19, 36, 45 to 66.

    The public law is carried down, rows without a title are dropped.
    """
    cut = lambda a, b: F.nullif(F.trim(F.substring(text, a + 1, b - a)), F.lit(""))
    rows = lines.select(by, order, cut(0, 6).alias("usc_title"), cut(6, 19).alias("usc_section"), cut(19, 36).alias("description"), cut(36, 45).alias("law"), cut(45, 66).alias("pub_law_sec"))
    return rows.withColumn("public_law_number", carry_forward(F.col("law"), by, [order])).where("usc_title IS NOT NULL").drop("law")
