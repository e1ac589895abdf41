"""Equi-joins of things with an extent: each pair meets at one level, that of the larger of the two.

Space or time is cut into cells of each level, twice as long at each next one. A
thing's own level is the least whose cells are as long as it is, so that it
touches few there. It goes to the cells of its own level, and to those of the
higher levels that the other side has things of, which one aggregation of
that side tells; and nowhere where nothing can match. So dense places are cut as
finely as what lies there is small, and large things meet what they cover.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Cells = Callable[[Column], Column]


def _levels(df: DataFrame) -> Column:
    """The levels that the rows have, found when the join runs: as many as there are levels at most."""
    return df.agg(F.collect_set("_own").alias("levels")).scalar()


def _dealt(df: DataFrame, cells: Cells, left: bool, levels: Column, held: str) -> DataFrame:
    """A row for each cell. ``_left`` tells whether the left one of a pair is to be the larger; of equals it is."""
    rows = df.withColumn("_levels", F.struct(levels.alias("theirs")))
    own, theirs = F.col("_own"), F.col("_levels.theirs")
    above = F.filter(theirs, lambda k: k > own) if left else F.filter(theirs, lambda k: k >= own)
    below = F.exists(theirs, lambda k: k <= own) if left else F.exists(theirs, lambda k: k < own)
    at = lambda k, larger: F.struct(k.alias("level"), F.lit(larger).alias("left"))
    here = F.when(below, F.array(at(own, left))).otherwise(F.array().cast("array<struct<level: int, left: boolean>>"))
    rows = rows.withColumn("_placed", F.explode(F.concat(here, F.transform(above, lambda k: at(k, not left)))))
    rows = rows.withColumns({"_level": F.col("_placed.level"), "_left": F.col("_placed.left")}).drop("_placed", "_levels", "_own")
    rows = rows.withColumn(held, cells(F.col("_level")))
    return rows.withColumn("_cell", F.explode(held))


def meetings(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_cells: Cells, right_cells: Cells, on: Column | None = None, how: str = "inner",
    sources: tuple[DataFrame, DataFrame] | None = None, tasks: int | None = None,
) -> DataFrame:
    """The pairs that are compared, with ``_level``, ``_cell`` and all cells of the two there, ``_left_cells`` and ``_right_cells``.

    ``on`` is a condition that the join itself tests, ``how`` is inner or left_semi. Both sides have their own level in ``_own`` and, but for the keys, no name in common. The sides are sorted, never
    broadcast: what is estimated of them doesn't know how many cells a row goes to. ``sources`` are plainer tables that have the same
    levels as the sides, ``tasks`` how many partitions cells are dealt to, if not as many as are set.
    """
    ours, theirs = sources or (left, right)
    a = _dealt(left, left_cells, True, _levels(theirs), "_left_cells")
    b = _dealt(right, right_cells, False, _levels(ours), "_right_cells")
    shared = [*keys, "_level", "_left", "_cell"]
    if tasks:
        a, b = a.repartition(tasks, *shared), b.repartition(tasks, *shared)
    if on is None:
        return a.hint("merge").join(b, shared, how).drop("_left")
    if how == "inner":
        return a.hint("merge").join(b, shared).where(on).drop("_left")
    theirs = b.withColumnsRenamed({c: f"_their{c}" for c in shared})
    same = [F.col(f"`{c}`") == F.col(f"`_their{c}`") for c in shared]
    return a.hint("merge").join(theirs, [*same, on], how).drop("_left")
