"""Writes and lookups of whole catalogues: inserting, importing, finding and removing datasets and records.

Each returns a new state of the catalogue; nothing is written until its frames
are. Checks that raise run a plan of their own, as their docstrings say.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, functions as F

from orrery.operators import catalog as ops, spatial
from orrery.operators.skyindex import DEPTH, SkyIndex
from orrery.plans.collections import Collections, Kind
from orrery.plans.query import Catalog, DatasetType, QueryError


def _with(catalog: Catalog, **changes: Any) -> Catalog:
    kept = Collections(dict(catalog.collections.kinds), {k: list(v) for k, v in catalog.collections.chains.items()}, dict(catalog.collections.docs))
    return replace(catalog, **({"elements": dict(catalog.elements), "types": dict(catalog.types), "collections": kept} | changes))


def _set(catalog: Catalog, name: str, frame: DataFrame) -> Catalog:
    out = _with(catalog)
    out.types[name] = replace(out.types[name], frame=frame)
    return out


def _keys(catalog: Catalog, name: str) -> list[str]:
    return list(catalog.universe.conform(catalog.types[name].dimensions).required)


def data_id_uuid(name: str, run: str, keys: Sequence[str], with_run: bool = True) -> Column:
    """A UUID that a dataset's type and data ID, and its run if wanted, always give."""
    text = F.concat_ws(",", F.lit(name), *([F.lit(run)] if with_run else []), *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in sorted(keys)))
    h = F.sha1(text)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table and the rows, by name; columns that they lack are null."""
    return table.unionByName(rows.select(*(c for c in table.columns if c in rows.columns)), allowMissingColumns=True)


def insert_datasets(catalog: Catalog, name: str, run: str, data_ids: DataFrame, ids: Column | None = None) -> Catalog:
    """New datasets of a type in a run, for these data IDs; ``ids`` makes their ids, by default from type, run and data ID.

    ConflictError if the run holds one of the data IDs, or if two are equal. Runs those checks.
    """
    if catalog.collections.kinds.get(run) != Kind.RUN:
        raise QueryError(f"{run} is not a run")
    keys, held = _keys(catalog, name), catalog.types[name].frame
    kind = held.schema["dataset_id"].dataType
    made = data_id_uuid(name, run, keys) if ids is None else ids
    if ids is None and kind.typeName() != "string":
        made = F.xxhash64(F.lit(name), F.lit(run), *keys)
    rows = data_ids.select(*keys).withColumns({"dataset_id": made.cast(kind), "run": F.lit(run), "collection": F.lit(run)})
    twice = ops.ambiguous(rows, keys).select(*keys)
    there = rows.select(*keys).join(held.where(F.col("collection") == run).select(*keys), keys, "left_semi")
    if not twice.unionByName(there).isEmpty():
        raise ops.ConflictError(f"{run} has a {name} for one of these data IDs, or two are equal")
    return _set(catalog, name, append(held, rows))


def put(catalog: Catalog, name: str, run: str, rows: DataFrame, data_ids: DataFrame, folder: str) -> Catalog:
    """Datasets written and registered at once: ``rows`` with the columns of their data IDs, which are ``data_ids``.

    The rows of each dataset go to its own folder of Parquet below ``folder/type/run``,
    named by its data ID, so one write is for all of them; rows of other data IDs are an error. Runs the checks of
    ``insert_datasets``, and writes only if they pass.
    """
    keys = _keys(catalog, name)
    made = insert_datasets(catalog, name, run, data_ids)
    if not rows.select(*keys).distinct().join(data_ids, keys, "left_anti").isEmpty():
        raise ops.ConflictError(f"there are rows of {name} with other data IDs")
    # beside the keys as columns, so that what is read again has them with their types
    placed = rows.withColumns({f"_{k}": F.col(k) for k in keys}).repartition(*keys)
    placed.write.mode("append").partitionBy(*(f"_{k}" for k in keys)).parquet(f"{folder}/{name}/{run}")
    return made


def get(catalog: Catalog, name: str, run: str, data_id: Mapping[str, Any], folder: str) -> DataFrame:
    """The rows of one dataset that ``put`` wrote: its own folder is read, and no other."""
    keys, spark = _keys(catalog, name), catalog.elements[next(iter(catalog.elements))].sparkSession
    df = spark.read.parquet(f"{folder}/{name}/{run}")
    for k in keys:
        df = df.where(F.col(f"_{k}") == F.lit(data_id[k]))
    return df.drop(*(f"_{k}" for k in keys))


def collection_table(catalog: Catalog, summaries: DataFrame | None = None, kinds: Sequence[Kind] | None = None) -> DataFrame:
    """(name, kind, doc, children, parents) of all collections, of some kinds; with their summaries, null for those that have none."""
    spark = catalog.elements[next(iter(catalog.elements))].sparkSession
    c, wanted = catalog.collections, set(kinds if kinds is not None else Kind)
    rows = [(n, k.name, c.docs.get(n), list(c.chains.get(n, ())), list(c.parents(n))) for n, k in c.kinds.items() if k in wanted]
    out = spark.createDataFrame(rows, "name string, kind string, doc string, children array<string>, parents array<string>")
    return out if summaries is None else out.join(summaries.withColumnRenamed("collection", "name"), "name", "left")


def import_datasets(catalog: Catalog, name: str, refs: DataFrame, assume_new: bool = False) -> Catalog:
    """Datasets with ids of their own (dataset_id, run, the type's dimensions); those that are there as they are stay.

    ConflictError, unless ``assume_new``, if one contradicts the catalogue. Runs that check.
    """
    keys, held = _keys(catalog, name), catalog.types[name].frame
    new = refs.select("dataset_id", "run", *keys)
    if not assume_new:
        mine = held.where(F.col("collection") == F.col("run")).withColumn("dataset_type", F.lit(name))
        others = [t.frame.select("dataset_id", F.lit(n).alias("dataset_type"), "run") for n, t in catalog.types.items() if n != name]
        datasets = mine.select("dataset_id", "dataset_type", "run")
        for o in others:
            datasets = datasets.unionByName(o)
        if not ops.import_conflicts(datasets, mine, new.withColumn("dataset_type", F.lit(name)), keys).isEmpty():
            raise ops.ConflictError(f"imported {name} contradict the catalogue")
        new = new.join(mine.select("dataset_id"), "dataset_id", "left_anti")
    out = _set(catalog, name, append(held, new.withColumn("collection", F.col("run"))))
    for r in new.select("run").distinct().collect():  # a row for each run
        out.collections.register(r["run"], Kind.RUN)
    return out


def insert_records(catalog: Catalog, element: str, records: DataFrame, replace_: bool = False, skip_existing: bool = False) -> Catalog:
    """Records of an element, appended; with ``replace_`` in place of those of their keys, with ``skip_existing`` where there are none.

    An element whose table has pixels gets them of the records' regions. A stored index of its regions is
    written at once: rows of what is new or has another region, none of what was there before.
    """
    table, keys = catalog.elements.get(element), list(catalog._keys(element)) if element in catalog.elements else []
    given = records
    if table is not None and "pixels" in table.columns and "region" in records.columns:
        records = spatial.indexed(records)
    if table is None:
        made = records
    elif replace_:
        made = ops.replace(table, append(table.limit(0), records), keys)
    elif skip_existing:
        made = ops.ensure(table, append(table.limit(0), records), keys)
    else:
        made = append(table, records)
    out = _with(catalog)
    out.elements[element] = made
    if (index := catalog.indexes.get(element)) is not None and "region" in given.columns:
        new = ops.least_of_each(given, keys)
        if skip_existing and table is not None:
            new = new.join(table.select(*keys), keys, "left_anti")
        index.put(new, table)
    return out


def delete_records(catalog: Catalog, element: str, ids: DataFrame) -> Catalog:
    """Without the records of these data IDs, in the table and in a stored index of regions."""
    keys = list(catalog._keys(element))
    out = _with(catalog)
    out.elements[element] = ops.delete(catalog.elements[element], ids.select(*keys), keys)
    if (index := catalog.indexes.get(element)) is not None:
        index.remove(ids.select(*keys))
    return out


def sync_record(
    catalog: Catalog, element: str, keys: Mapping[str, Any], compared: Mapping[str, Any], update: bool = False
) -> tuple[Catalog, bool | dict[str, Any]]:
    """The catalogue with one record made sure of, and its rows in a stored index; what ``catalog.sync`` tells. Reads the record."""
    table, outcome = ops.sync(catalog.elements[element], keys, compared, update)
    out = _with(catalog)
    out.elements[element] = table
    index = catalog.indexes.get(element)
    if index is not None and (outcome is True or isinstance(outcome, dict) and "region" in outcome):
        one = table
        for k, v in keys.items():
            one = one.where(F.col(k) == F.lit(v))
        index.put(one)
    return out, outcome


def with_index(catalog: Catalog, element: str, path: str, depth: int = DEPTH) -> Catalog:
    """The catalogue with a stored index of an element's regions, built at ``path``; constraints read it from then on."""
    out = _with(catalog)
    keys = list(catalog._keys(element))
    out.indexes = {**catalog.indexes, element: SkyIndex.build(catalog.elements[element], keys, path, depth)}
    return out


def records_from_layers(catalog: Catalog, element: str, ids: DataFrame, *layers: DataFrame) -> DataFrame:
    """The records of data IDs: from the first of ``layers`` that has each, and from the catalogue's table only what none has.

    Layers are frames of records, such as those given or held from before. Runs a check
    whether anything is left for the table, which is not read if nothing is.
    """
    keys, table = list(catalog._keys(element)), catalog.element(element)
    left, out = ids.select(*keys).distinct(), None
    for layer in layers:
        rows = layer.select(*(F.col(c) if c in layer.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns))
        found = ops.least_of_each(rows.join(left, keys, "left_semi"), keys)
        out = found if out is None else out.unionByName(found)
        left = left.join(layer.select(*keys), keys, "left_anti")
    if out is not None and left.isEmpty():
        return out
    rest = table.join(left, keys, "left_semi")
    return rest if out is None else out.unionByName(rest)


def stored(catalog: Catalog, name: str, table: str, buckets: int = 200) -> Catalog:
    """The catalogue with a type's datasets as a table: folders by collection, in each of them buckets by data ID, in order.

    A search reads the folders of its collections, and finds the first of each data ID,
    or joins a table of the same buckets, without a shuffle. Datasets of calibration
    collections go to a table of their own, so that others carry no validity ranges.
    """
    spark, keys, t = catalog.elements[next(iter(catalog.elements))].sparkSession, _keys(catalog, name), catalog.types[name]
    calibrations = [c for c, k in catalog.collections.kinds.items() if k == Kind.CALIBRATION]

    def write(rows: DataFrame, to: str) -> DataFrame:
        # dealt as buckets are: a task writes one bucket of each collection
        dealt = rows.repartition(buckets, *keys).write.partitionBy("collection").bucketBy(buckets, *keys).sortBy(*keys)
        dealt.format("parquet").saveAsTable(to)
        return spark.table(to)

    if not t.is_calibration or not calibrations or "timespan" not in t.frame.columns:
        return _set(catalog, name, write(t.frame, table))
    of_them = F.col("collection").isin(*calibrations)
    out = _set(catalog, name, write(t.frame.where(~of_them).drop("timespan"), table))
    apart = write(t.frame.where(of_them), f"{table}_calibrations")
    out.types[name] = replace(out.types[name], calibrations=apart)
    return out


def record(catalog: Catalog, element: str, data_id: Mapping[str, Any]):
    """The one record of a data ID, or None."""
    df = catalog.element(element)
    for k in catalog._keys(element) if not catalog.universe[element].union_of else [element]:
        df = df.where(F.col(k) == F.lit(data_id[k]))
    return df.first()


def refs_by_id(catalog: Catalog, ids: DataFrame, types: str | Sequence[str] = "*", partitions: int | None = None) -> DataFrame:
    """dataset_id, dataset_type, run and data_id (JSON) of the datasets with these ids (a column dataset_id).

    Both sides are dealt by id to ``partitions``, if said.
    """
    dealt = lambda df: df if partitions is None else df.repartition(partitions, "dataset_id")
    out = None
    for name in catalog.query_types(types):
        keys = _keys(catalog, name)
        wanted = dealt(ids.select("dataset_id")).distinct()
        held = catalog.types[name].frame.where(F.col("collection") == F.col("run"))
        found = dealt(held.select("dataset_id", "run", *keys)).join(wanted, "dataset_id", "left_semi")
        part = found.select(F.col("dataset_id").cast("string").alias("dataset_id"), F.lit(name).alias("dataset_type"), "run", F.to_json(F.struct(*keys)).alias("data_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise QueryError(f"no dataset type matches {types}")
    return out


def ids_of_run(catalog: Catalog, run: str) -> DataFrame:
    """dataset_id and dataset_type of all that a run holds."""
    parts = [t.frame.where((F.col("collection") == run) & (F.col("run") == run)).select(F.col("dataset_id").cast("string").alias("dataset_id"), F.lit(n).alias("dataset_type")) for n, t in sorted(catalog.types.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prune(catalog: Catalog, name: str, refs: DataFrame, tags: Sequence[str] = (), purge: bool = False) -> Catalog:
    """Without datasets (a column dataset_id): out of ``tags``, or with ``purge`` out of every collection and their run."""
    if not purge and not tags:
        raise QueryError("say which tags the datasets leave, or purge them")
    for tag in tags:
        if catalog.collections.kinds.get(tag) != Kind.TAGGED:
            raise QueryError(f"{tag} is not a tagged collection")
    held = catalog.types[name].frame
    gone = refs.select("dataset_id").distinct()
    if purge:
        return _set(catalog, name, held.join(gone, "dataset_id", "left_anti"))
    inside = F.col("collection").isin(*tags)
    return _set(catalog, name, held.where(~inside).unionByName(held.where(inside).join(gone, "dataset_id", "left_anti")))


def remove_runs(catalog: Catalog, runs: Sequence[str], unlink: bool = False) -> Catalog:
    """Without these runs and all their datasets, wherever they are tagged or certified.

    ConflictError if one is in a chain and ``unlink`` is false.
    """
    for run in runs:
        if catalog.collections.kinds.get(run) != Kind.RUN:
            raise QueryError(f"{run} is not a run")
    out = _with(catalog)
    for run in runs:
        out.collections.remove(run, unlink)
    for name, t in out.types.items():
        out.types[name] = replace(t, frame=t.frame.where(~F.col("run").isin(*runs)))
    if out.summaries is not None:
        out.summaries = {k: v for k, v in out.summaries.items() if k not in runs}
    return out


def remove_type(catalog: Catalog, name: str) -> Catalog:
    """Without a dataset type; ConflictError if it has datasets. Reads a row."""
    if not catalog.types[name].frame.isEmpty():
        raise ops.ConflictError(f"there are datasets of type {name}")
    out = _with(catalog)
    del out.types[name]
    return out


def certify(catalog: Catalog, name: str, collection: str, refs: DataFrame) -> Catalog:
    """Datasets (dataset_id, run, dimensions, timespan) valid in a calibration collection; ConflictError if ranges of a data ID overlap."""
    if catalog.collections.kinds.get(collection) != Kind.CALIBRATION:
        raise QueryError(f"{collection} is not a calibration collection")
    t = catalog.types[name]
    if not t.is_calibration:
        raise QueryError(f"{name} is not a calibration type")
    keys = _keys(catalog, name)
    held = t.frame.where(F.col("collection") == collection)
    new = append(t.frame.limit(0), refs.withColumn("collection", F.lit(collection)))
    ops.certify(held.select(*keys, "timespan"), new.select(*keys, "timespan"), keys, "timespan")
    return _set(catalog, name, append(t.frame, new))


# ---------------------------------------------------------------- summaries


def merged_summaries(summaries: DataFrame, collections: Collections, spark=None) -> DataFrame:
    """Summaries (collection, dataset_types, governor arrays) with those of chains, the union of what is below each."""
    governors = [c for c in summaries.columns if c not in ("collection", "dataset_types")]
    rows = [(n, m) for n, k in collections.kinds.items() for m in (collections.flatten([n]) if k == Kind.CHAINED else [n])]
    links = summaries.sparkSession.createDataFrame(rows, "name string, collection string")  # a row for each link
    # a collection without a summary stays, with nothing in it
    together = links.join(summaries, "collection", "left").groupBy("name").agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("dataset_types", *governors))
    )
    return together.withColumnRenamed("name", "collection")


def collections_by_type(summaries: DataFrame) -> DataFrame:
    """dataset_type and the collections that list it, in order."""
    each = summaries.select("collection", F.explode("dataset_types").alias("dataset_type"))
    return each.groupBy("dataset_type").agg(F.array_sort(F.collect_set("collection")).alias("collections"))


# ---------------------------------------------------------------- sets of records


def record_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of either, by key; those of ``a`` where both have one."""
    return a.unionByName(b.select(*a.columns).join(a.select(*keys), list(keys), "left_anti"))


def record_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def record_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def records_of(catalog: Catalog, ids: DataFrame) -> dict[str, DataFrame]:
    """For each element that data IDs have, its distinct records that they use."""
    full = catalog.expand(ids)
    group = catalog.universe.conform([c for c in ids.columns if c in catalog.universe])
    out = {}
    for name in group.elements:
        if name in catalog.elements and set(keys := catalog._keys(name)) <= set(full.columns):
            out[name] = record_intersection(catalog.elements[name], full, list(keys))
    return out


# ---------------------------------------------------------------- facade

SOFT_LIMIT = -20_000


def _conditioned(catalog: Catalog, where: str, bind: Mapping[str, Any] | None, data_id: Mapping[str, Any] | None, kwargs: Mapping[str, Any]):
    q = catalog.query()
    q = q.join_dimensions(*(k for k in {**(data_id or {}), **kwargs} if k in catalog.universe))
    return q.where(where, bind=bind, **{**(data_id or {}), **kwargs})


def _finished(result, order_by: Sequence[str] | None, limit: int | None, records: bool, explain: bool):
    if order_by:
        result = result.order_by(*order_by)
    result = result.limit(limit)
    if records:
        result = result.with_dimension_records()
    if explain and (why := result.explain_no_results()):
        raise QueryError("; ".join(why))
    return result


def query_data_ids(
    catalog: Catalog, dimensions: Sequence[str], *, data_id: Mapping[str, Any] | None = None, where: str = "", bind: Mapping[str, Any] | None = None,
    with_dimension_records: bool = False, order_by: Sequence[str] | None = None, limit: int | None = SOFT_LIMIT, explain: bool = True, **kwargs: Any,
):
    """Data IDs in one call. The default limit is soft: ``rows`` warns where it cuts. ``explain`` raises if there can be none."""
    q = _conditioned(catalog, where, bind, data_id, kwargs)
    return _finished(q.data_ids(dimensions), order_by, limit, with_dimension_records, explain)


def query_datasets(
    catalog: Catalog, name: str, collections: str | Sequence[str] | None = None, *, find_first: bool = True, data_id: Mapping[str, Any] | None = None, where: str = "",
    bind: Mapping[str, Any] | None = None, with_dimension_records: bool = False, order_by: Sequence[str] | None = None, limit: int | None = SOFT_LIMIT, explain: bool = True, **kwargs: Any,
):
    """Datasets in one call; without collections those of the catalogue's defaults."""
    searched = collections if collections is not None else catalog.defaults.get("collections")
    if searched is None:
        raise QueryError("no collections are given, and there are no defaults")
    q = _conditioned(catalog, where, bind, data_id, kwargs)
    return _finished(q.datasets(name, searched, find_first), order_by, limit, with_dimension_records, explain)


def query_dimension_records(
    catalog: Catalog, element: str, *, data_id: Mapping[str, Any] | None = None, where: str = "", bind: Mapping[str, Any] | None = None,
    order_by: Sequence[str] | None = None, limit: int | None = SOFT_LIMIT, explain: bool = True, **kwargs: Any,
):
    """Records in one call."""
    q = _conditioned(catalog, where, bind, data_id, kwargs)
    return _finished(q.dimension_records(element), order_by, limit, False, explain)


def parse_dataset_uri(uri: str) -> tuple[str, str]:
    """(repository label, dataset id) of ``<scheme>://label/uuid`` or ``ivo://...?repo=label&id=uuid``; ValueError else."""
    parts = urlsplit(uri)
    if parts.scheme == "ivo":
        query = parse_qs(parts.query)
        label, found = query.get("repo", [""])[0], query.get("id", [""])[0]
    else:
        label, _, found = (parts.netloc + parts.path).strip("/").rpartition("/")
    if not label or not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", found):
        raise ValueError(f"no dataset is named by {uri!r}")
    return label, found


def with_regions(observations: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observation rows with the region that ``regions`` (keys, region) has for them in place of theirs."""
    new = regions.groupBy(*keys).agg(F.first("region").alias("_region"))
    return observations.join(new, list(keys), "left").withColumn("region", F.coalesce("_region", "region")).drop("_region")


