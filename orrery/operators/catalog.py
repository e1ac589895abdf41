"""Catalogue operators on DataFrames: find-first, validity ranges, interval edits, overlap joins, writes.

Each is a declarative plan. Nothing is collected unless a docstring says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.functions import timespan as ts
from orrery.operators.intervals import overlap_join


class ConflictError(ValueError):
    """Rows that contradict what the catalogue holds."""


class AmbiguityError(LookupError):
    """More than one row where one is wanted."""


# ---------------------------------------------------------------- de-duplication


def rank_of(column: Column, order: Sequence[object]) -> Column:
    """The place of a value in an ordered list; null for values that are not in it."""
    if not order:
        return F.lit(None).cast("int")
    return (F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), column), F.lit(0)) - 1).cast("int")


def find_first(
    df: DataFrame, keys: Sequence[str], collection: str, order: Sequence[object], unique: bool = False, certain: str | None = None
) -> DataFrame:
    """One row for each key, that of the first collection in ``order`` that has it.

    A minimum of (rank, row) by key: it combines before the shuffle and sorts
    nothing, unlike a row number. With one collection, in which the caller knows
    keys to be ``unique``, it is a filter. ``certain`` names a column that rows of
    a key in its first collection must agree on; a computed row fails if they don't.
    """
    if not order:
        return df.limit(0)
    if unique and len(order) == 1:
        return df.where(F.col(collection) == F.lit(order[0]))
    q = lambda c: F.col(f"`{c}`")
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("_rank", rank_of(q(collection), order)).where("_rank IS NOT NULL")
    best = F.min(F.struct("_rank", *(q(c).alias(f"_{i}") for i, c in enumerate(rest)))).alias("_best")
    if not certain:
        found = ranked.groupBy(*map(q, keys)).agg(best) if keys else ranked.agg(best).where("_best IS NOT NULL")
    else:
        ends = F.min(F.struct("_rank", q(certain))).alias("_low"), F.max(F.struct(-F.col("_rank"), q(certain))).alias("_high")
        found = ranked.groupBy(*map(q, keys)).agg(best, *ends) if keys else ranked.agg(best, *ends).where("_best IS NOT NULL")
        same = F.col("_low").getField(certain).eqNullSafe(F.col("_high").getField(certain))
        failed = F.raise_error(F.lit("more than one match in a collection; a temporal join or a condition is needed"))
        found = found.withColumn("_best", F.when(same, F.col("_best")).otherwise(failed))
    out = found.select(*map(q, keys), *(F.col(f"_best._{i}").alias(c) for i, c in enumerate(rest)))
    return out.select(*map(q, df.columns))


def project(df: DataFrame, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Distinct ``keys``, with the least values of other columns, which the keys determine."""
    if not columns:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in columns))


def ambiguous(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of more than one row, and how many each has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_matches")).where("n_matches > 1")


def one_each(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, which fail when they are computed if a key has more than one."""
    others = [c for c in df.columns if c not in keys]
    n = F.count("*")
    checked = F.when(n == 1, F.first(F.struct(*others))).otherwise(
        F.raise_error(F.lit(f"more than one match for a value of {', '.join(keys)}"))
    )
    return df.groupBy(*keys).agg(checked.alias("_row")).select(*keys, "_row.*")


#: The places that the rows of one key go to in a join that fans out on both sides.
PLACES = 64


def fanned_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A join by keys that repeat on both sides, like nations, so that one key's pairs are many tasks' work.

    Rows of the left side are dealt by columns ``by`` to a place of their key, those of the right one go to all of them. The partitions
    are as many as said, since the sizes of the sides tell nothing about that of the result.
    """
    n = max(PLACES, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in by)), F.lit(PLACES)).cast("int")
    a = left.withColumn("_place", place).repartition(n, *keys, "_place")
    b = right.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))).repartition(n, *keys, "_place")
    return a.join(b, [*keys, "_place"]).drop("_place")


# ---------------------------------------------------------------- time


def validity_ranges(df: DataFrame, keys: Sequence[str], begin: str, tie: str) -> DataFrame:
    """Spans from each row's ``begin`` to the next of its key; the last is unbounded. One row for each begin."""
    first = df.groupBy(*keys, begin).agg(F.min(tie).alias(tie))
    following = F.lead(begin).over(Window.partitionBy(*keys).orderBy(begin))
    return first.withColumn("validity", ts.span(F.col(begin), F.coalesce(following, F.lit(ts.MAX_NSEC))))


#: The most ranges and rows that a key has in one place in a lookup.
FEW, BUSY = 64, 500_000


def _by_levels(spans: DataFrame, calibrations: DataFrame, keys: Sequence[str], validity: str, check: bool, step: int) -> DataFrame:
    """The ``_found`` of each row whose ``_lookup_at`` it overlaps, dealt out by time."""
    columns = [c for c in spans.columns if c != "_lookup_at"]
    others = [c for c in calibrations.columns if c not in keys]
    # an instant is shorter than any range, so it goes to every level of them, while few ranges of a key hold or neighbour it
    found = overlap_join(spans, calibrations, keys, "_lookup_at", validity, step).withColumn("_found", F.struct(*others))
    if not check:
        return found.select(*columns, "_found")
    one = F.when(F.count("*") == 1, F.first("_found")).otherwise(F.raise_error(F.lit("more than one calibration is valid")))
    return found.groupBy(*columns).agg(one.alias("_found"))


def _by_key(spans: DataFrame, live: DataFrame, keys: Sequence[str], validity: str, check: bool) -> DataFrame:
    """The same where keys have few ranges: these are a list, which a row meets once."""
    columns = [c for c in spans.columns if c != "_lookup_at"]
    held = live.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in live.columns if c not in keys))).alias("_held"))
    found = F.filter("_held", lambda h: ts.overlaps(h[validity], F.col("_lookup_at")))
    if check:
        failed = F.raise_error(F.lit("more than one calibration is valid"))
        found = F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) <= 1, f).otherwise(failed)), F.lit(0))
    return spans.join(held, list(keys)).select(*columns, F.explode(found).alias("_found"))


def calibration_lookup(
    rows: DataFrame, calibrations: DataFrame, keys: Sequence[str], at: str, validity: str = "validity", check: bool = True
) -> DataFrame:
    """Each row with the calibration of its key whose validity holds its time or overlaps its span.

    With ``check`` a computed row fails if two calibrations match. Rows without one
    drop out; rows that are there repeatedly come back as often, looked up once. A key
    of more than FEW ranges or BUSY rows is dealt out by time, others are looked up by key alone.
    """
    instant = dict(rows.dtypes)[at] == "bigint"
    span, step = (ts.span(F.col(at), F.col(at) + 1), 4) if instant else (F.col(at), 1)
    # all that the joins below would infer goes first: what is made of the rows is then made of the same ones, which are shuffled once
    keyed = lambda df: df.dropna(subset=list(keys)) if keys else df
    there = lambda df, s: keyed(df).where(s.isNotNull() & s["begin"].isNotNull() & s["end"].isNotNull() & ~ts.is_empty(s))
    live = there(calibrations, F.col(validity))
    once = there(rows, span).groupBy(*rows.columns).agg(F.count("*").alias("_times"))
    spans = once.withColumn("_lookup_at", span)
    if not keys:
        found = _by_levels(spans, live, keys, validity, check, step)
    else:
        crowded = live.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select(*keys)
        busy = once.groupBy(*keys).agg(F.sum("_times").alias("_n")).where(F.col("_n") > BUSY).select(*keys)
        # dealt once more, as a stage of its own: Spark sees how few keys these are, mostly none, before it joins with them
        many = crowded.unionByName(busy).distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        of = lambda df, how: df.join(many, list(keys), how)
        found = _by_key(of(spans, "left_anti"), of(live, "left_anti"), keys, validity, check)
        found = found.unionByName(_by_levels(of(spans, "left_semi"), of(live, "left_semi"), keys, validity, check, step))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    others = [F.col("_found")[c].alias(c) for c in calibrations.columns if c not in keys]
    return found.select(*rows.columns, "_times", *others).withColumn("_times", again).drop("_times")


def certify(existing: DataFrame, new: DataFrame, keys: Sequence[str], validity: str = "validity") -> DataFrame:
    """``existing`` with ``new``; ConflictError if spans of one key would overlap. Runs the check."""
    held = existing.select(*keys, F.col(validity).alias("_held"))
    clash = overlap_join(new.select(*keys, validity), held, keys, validity, "_held")
    ranges = new.select(*keys, validity, F.col(validity)["end"].alias("_end"))
    before = F.max("_end").over(
        Window.partitionBy(*keys).orderBy(F.col(validity)["begin"]).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = ranges.withColumn("_before", before).where(F.col("_before") > F.col(validity)["begin"])
    if not clash.select(*keys).unionByName(within.select(*keys)).isEmpty():
        raise ConflictError("validity ranges overlap for the same data ID")
    return existing.unionByName(new)


def decertify(
    rows: DataFrame, window: ts.Timespan, validity: str = "validity", only: Column | None = None
) -> DataFrame:
    """The rows without ``window``: those that it touches are cut to the 0 to 2 spans outside of it."""
    cut = ts.difference(F.col(validity), window.column())
    if only is not None:
        cut = F.when(only, cut).otherwise(F.array(F.col(validity)))
    return rows.withColumn(validity, F.explode(cut))


# ---------------------------------------------------------------- writes: new states of a table


def least_of_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of each key, the least by its other columns in their order; null keys are keys."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    least = F.min(F.struct(*(F.col(f"`{c}`") for c in others))).alias("_r")
    return rows.groupBy(*keys).agg(least).select(*keys, "_r.*").select(*(F.col(f"`{c}`") for c in rows.columns))


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join by keys of which nulls are equal, without the right side's keys."""
    held = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`")) for k in keys]
    return left.join(held, on, how).drop(*(f"_key_{k}" for k in keys))


def replace(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: ``rows`` in place of what has their keys, a key once: of rows of one key the least. Null keys are equal."""
    new = least_of_each(rows, keys)
    return _matched(table, new.select(*keys), keys, "left_anti").unionByName(new)


def ensure(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert what is absent; of new rows of one key the least. Null keys are equal."""
    new = least_of_each(rows.select(*table.columns), keys)
    return table.unionByName(_matched(new, table.select(*keys), keys, "left_anti"))


def sync(
    table: DataFrame, keys: Mapping[str, object], compared: Mapping[str, object], update: bool = False
) -> tuple[DataFrame, bool | dict[str, object]]:
    """The table with one row made sure of, and whether it was inserted, or which old values were updated.

    ConflictError if it is there with other values and ``update`` is false. Reads the row.
    """
    match = F.lit(True)
    for k, v in keys.items():
        match = match & F.col(k).eqNullSafe(F.lit(v))
    found = table.where(match).limit(2).collect()
    if not found:
        made = table.sparkSession.createDataFrame([{c: {**keys, **compared}.get(c) for c in table.columns}], table.schema)
        return table.unionByName(made), True
    old = {k: found[0][k] for k, v in compared.items() if found[0][k] != v}
    if not old:
        return table, False
    if not update:
        raise ConflictError(f"{dict(keys)} is there with {old}")
    return table.withColumns({k: F.when(match, F.lit(compared[k])).otherwise(F.col(k)).cast(table.schema[k].dataType) for k in old}), old


def delete(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def update(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with the other columns of ``rows`` set where keys match: as many rows as before, of updates of one key the least."""
    changed = [c for c in rows.columns if c not in keys]
    new = least_of_each(rows, keys).select(*keys, F.struct(*(F.col(f"`{c}`") for c in changed)).alias("_new"))
    joined = _matched(table, new, keys, "left")
    there = F.col("_new").isNotNull()
    value = lambda c: F.when(there, F.col("_new")[c]).otherwise(F.col(f"`{c}`")) if c in changed else F.col(f"`{c}`")
    return joined.select(*(value(c).alias(c) for c in table.columns))


def import_conflicts(datasets: DataFrame, tags: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` (dataset_id, dataset_type, run, keys) that contradict the catalogue, with the reason:

    ``definition``: the id is there with another type or run; ``data_id``: it is tagged in the run with
    another data ID; ``id``: the run holds the data ID and type under another id.
    """
    old = datasets.select("dataset_id", F.col("dataset_type").alias("_type"), F.col("run").alias("_run"))
    a = new.join(old, "dataset_id").where("dataset_type <> _type OR run <> _run").select("dataset_id", F.lit("definition").alias("reason"))
    held = tags.select("dataset_id", "dataset_type", F.col("collection").alias("run"), *keys)
    theirs = held.select("dataset_id", "dataset_type", "run", F.struct(*keys).alias("_id"))
    b = new.join(theirs, ["dataset_id", "dataset_type", "run"]).where(F.struct(*keys) != F.col("_id"))
    same = held.withColumnRenamed("dataset_id", "_other")
    c = new.join(same, ["dataset_type", "run", *keys]).where("dataset_id <> _other")
    reason = lambda df, r: df.select("dataset_id", F.lit(r).alias("reason"))
    return a.unionByName(reason(b, "data_id")).unionByName(reason(c, "id")).distinct()


def associate(tags: DataFrame, rows: DataFrame, collection: str, keys: Sequence[str]) -> DataFrame:
    """``rows`` tagged in the collection, in place of others of their type and data ID."""
    return replace(tags, rows.withColumn("collection", F.lit(collection)).select(*tags.columns), ["dataset_type", "collection", *keys])


def disassociate(tags: DataFrame, rows: DataFrame, collection: str) -> DataFrame:
    gone = rows.select("dataset_id").distinct().withColumn("collection", F.lit(collection))
    return delete(tags, gone, ["dataset_id", "collection"])


# ---------------------------------------------------------------- summaries


def summaries(tags: DataFrame, governors: Sequence[str]) -> DataFrame:
    """For each collection its dataset types and governor values, as arrays in order."""
    return tags.groupBy("collection").agg(
        F.array_sort(F.collect_set("dataset_type")).alias("dataset_types"),
        *(F.array_sort(F.collect_set(g)).alias(g) for g in governors),
    )


def refreshed(summary: DataFrame, tags: DataFrame, calibs: DataFrame) -> DataFrame:
    """Summary rows (collection, dataset_type) that tags or calibrations still bear out."""
    there = tags.select("collection", "dataset_type").unionByName(calibs.select("collection", "dataset_type")).distinct()
    return summary.join(there, ["collection", "dataset_type"], "left_semi")


def associations(tags: DataFrame, calibs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(dataset_id, collection, validity) of all tags, unbounded, and calibrations; dealt by id to ``partitions``, if said."""
    whole = ts.Timespan().column()
    both = tags.select("dataset_id", "collection", whole.alias("validity")).unionByName(calibs.select("dataset_id", "collection", "validity"))
    return (both if partitions is None else both.repartition(partitions, "dataset_id")).distinct()


# ---------------------------------------------------------------- sets of data IDs


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One pass: rows that only one side has."""
    both = a.select("*", F.lit(1).alias("_side")).unionByName(b.select("*", F.lit(2).alias("_side")))
    return both.groupBy(*a.columns).agg(F.bit_or("_side").alias("_side")).where("_side <> 3").drop("_side")


def issubset(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty()


def isdisjoint(a: DataFrame, b: DataFrame) -> bool:
    return intersection(a, b).isEmpty()


# ---------------------------------------------------------------- data IDs


def packed(bits: Mapping[str, int]) -> Column:
    """Keys packed into one integer, the first in the highest bits; ``bits`` is the width of each."""
    out = F.lit(0).cast("long")
    for name, width in bits.items():
        out = F.shiftleft(out, width).bitwiseOR(F.col(name).cast("long"))
    return out


def unpacked(column: Column, bits: Mapping[str, int]) -> dict[str, Column]:
    out, shift = {}, 0
    for name, width in reversed(list(bits.items())):
        out[name] = F.shiftright(column, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias(name)
        shift += width
    return dict(reversed(list(out.items())))


def templated(template: str) -> Column:
    """A path or text with ``{column}`` or ``{column:0Nd}`` fields; null if a field is."""
    import re

    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::0(\d+)d)?\}", template):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        c = F.col(m[1]).cast("string")
        pieces.append(F.lpad(c, int(m[2]), "0") if m[2] else c)
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


# What each bit of an existence mask says.
EXISTENCE = {"recorded": 1, "datastore": 2, "artifact": 4, "verified": 8}


def existence(refs: DataFrame, **known: DataFrame) -> DataFrame:
    """``refs`` (dataset_id) with a bit mask of which tables of ids, named as in EXISTENCE, hold each."""
    out = refs.withColumn("existence", F.lit(0))
    for name, ids in known.items():
        out = out.join(ids.select("dataset_id", F.lit(EXISTENCE[name]).alias("_bit")).distinct(), "dataset_id", "left")
        out = out.withColumn("existence", F.col("existence").bitwiseOR(F.coalesce("_bit", F.lit(0)))).drop("_bit")
    return out


def soft_limited(df: DataFrame, limit: int) -> tuple[DataFrame, int | None]:
    """A negative limit is soft: the frame gets one row more, so that the caller can see it was reached."""
    return (df.limit(limit), None) if limit >= 0 else (df.limit(-limit + 1), -limit)
