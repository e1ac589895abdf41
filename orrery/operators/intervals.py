"""Joins of timespans: every pair that overlaps meets once, and few others meet at all.

Cells are buckets of 2^k nanoseconds. A pair meets at the level of the longer span, in
the bucket in which the later of the two begins. A key with very many spans is as many
cells as its spans are long, and year-long spans meet what lies in their years,
not what is shorter than they are as such.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions import timespan as ts
from orrery.operators import levels

#: 2^62 nanoseconds are more than the clamped range.
TOP = 62


def own_level(span: Column, step: int = 1) -> Column:
    """The least k of the multiples of ``step``, but for rounding, so that the span is no longer than 2^k."""
    length = F.greatest(span["end"] - span["begin"], F.lit(1)).cast("double")
    return F.least((F.ceil(F.log2(length) / step) * step).cast("int"), F.lit(TOP))


def _shift(time: Column, level: Column) -> Column:
    return F.call_function("shiftright", time, level)


def _live(df: DataFrame, span: str, step: int) -> DataFrame:
    """Rows with a span that is neither null nor empty, and its level."""
    return df.where(F.col(span).isNotNull() & ~ts.is_empty(F.col(span))).withColumn("_own", own_level(F.col(span), step))


def meetings(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: str, right_span: str, step: int = 1) -> DataFrame:
    """The pairs that are compared."""
    buckets = lambda s: lambda k: F.sequence(_shift(F.col(s)["begin"], k), _shift(F.col(s)["end"] - 1, k))
    pairs = levels.meetings(_live(left, left_span, step), _live(right, right_span, step), keys, buckets(left_span), buckets(right_span))
    return pairs.drop("_left_cells", "_right_cells")


#: The rows of one span that are joined as one, on the left and on the right; the places that rows of one span go to, and the least tasks that join.
BLOCKS, PLACES, TASKS = (1024, 256), 8, 64


def _blocks(df: DataFrame, span: str, rows: str, size: int) -> DataFrame:
    """A row for each block of up to ``size`` rows with one span, neither null nor empty, which are a list."""
    others = [F.col(f"`{c}`") for c in df.columns if c != span]
    df = df.where(F.col(span).isNotNull() & ~ts.is_empty(F.col(span))).withColumnRenamed(span, "_span")
    df = df.withColumn("_place", F.pmod(F.xxhash64(*others), F.lit(PLACES)))
    at = F.row_number().over(Window.partitionBy("_span", "_place").orderBy(F.lit(0)))
    df = df.withColumn("_block", F.floor((at - 1) / size))
    blocks = df.groupBy("_span", "_place", "_block").agg(F.collect_list(F.struct(*others)).alias(rows))
    return blocks.drop("_block").withColumnRenamed("_span", span)


def _block_join(left: DataFrame, right: DataFrame, left_span: str, right_span: str, step: int) -> DataFrame:
    """The pairs of an overlap join without keys, in which all of a time meet: spans are compared by blocks of the rows that share them.

    Pairs come out block by block, so that a file of them holds the same short lists again and again, and stays small.
    """
    names = [*left.columns, *right.columns]
    sources = _live(left, left_span, step), _live(right, right_span, step)
    buckets = lambda s: lambda k: F.sequence(_shift(F.col(s)["begin"], k), _shift(F.col(s)["end"] - 1, k))
    a, b = _blocks(left, left_span, "_left_rows", BLOCKS[0]), _blocks(right, right_span, "_right_rows", BLOCKS[1])
    b = b.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PLACES - 1).cast("long"))))  # the pairs of a time are many tasks' work
    tasks = max(TASKS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = levels.meetings(_live(a, left_span, step), _live(b, right_span, step), ["_place"], buckets(left_span), buckets(right_span), sources=sources, tasks=tasks)
    x, y = F.col(left_span), F.col(right_span)
    once = F.col("_cell") == _shift(F.greatest(x["begin"], y["begin"]), F.col("_level"))
    pairs = pairs.where(ts.overlaps(x, y) & once).select(left_span, right_span, F.explode("_left_rows").alias("_l"), "_right_rows")
    pairs = pairs.select(left_span, right_span, "_l", F.explode("_right_rows").alias("_r"))
    return pairs.select(left_span, right_span, "_l.*", "_r.*").select(*(F.col(f"`{c}`") for c in names))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: str, right_span: str, step: int = 1) -> DataFrame:
    """Pairs with equal keys whose spans overlap. Empty and null spans overlap nothing; repeated rows give repeated pairs.

    With a ``step`` there are fewer levels, so that a short span goes to fewer of them, and meets up to 2^step times as many in each.
    Spans of one name are those of the left side in the result. Without keys rows of one span are joined as blocks.
    """
    same = left_span == right_span
    if not keys and len(left.columns) > 1 and len(right.columns) > 1:
        found = _block_join(left, right.withColumnRenamed(right_span, "_right") if same else right, left_span, "_right" if same else right_span, step)
        return found.drop("_right") if same else found
    right = right.withColumnRenamed(right_span, "_right") if same else right.withColumn("_right", F.col(right_span))
    pairs = meetings(left, right, keys, left_span, "_right", step)
    a, b = F.col(left_span), F.col("_right")
    once = F.col("_cell") == _shift(F.greatest(a["begin"], b["begin"]), F.col("_level"))
    return pairs.where(ts.overlaps(a, b) & once).drop("_level", "_cell", "_right")
