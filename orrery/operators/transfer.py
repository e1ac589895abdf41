"""Moving parts of a catalogue: bundles of Parquet tables, transfers, opaque tables, data-ID rewriting."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.functions.glob import is_glob, matches
from orrery.operators.catalog import AmbiguityError, ConflictError, ensure
from orrery.plans.collections import Collections, Kind
from orrery.plans.query import Catalog, DatasetType, QueryError


def export(catalog: Catalog, folder: str, types: str | Sequence[str] = "*", elements: Sequence[str] | None = None) -> None:
    """Writes a bundle: a table for each element and dataset type, and one row of metadata."""
    spark = next(iter(catalog.elements.values())).sparkSession
    chosen = catalog.query_types(types)
    names = list(catalog.elements) if elements is None else list(elements)
    for n in names:
        catalog.elements[n].write.mode("overwrite").parquet(f"{folder}/elements/{n}")
    for n in chosen:
        catalog.types[n].frame.write.mode("overwrite").parquet(f"{folder}/datasets/{n}")
    about = {
        "elements": names,
        "types": [[t.name, t.dimensions, t.storage_class, t.is_calibration] for t in (catalog.types[n] for n in chosen)],
        "kinds": {n: int(k) for n, k in catalog.collections.kinds.items()},
        "chains": catalog.collections.chains,
        "docs": catalog.collections.docs,
    }
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")


def load(spark: SparkSession, folder: str, catalog: Catalog) -> Catalog:
    """The catalogue with what a bundle holds: records and datasets that are absent, collections, types."""
    about = json.loads(spark.read.parquet(f"{folder}/about").first()["about"])
    found = Collections({n: Kind(k) for n, k in about["kinds"].items()}, about["chains"], about["docs"])
    elements = {n: spark.read.parquet(f"{folder}/elements/{n}") for n in about["elements"]}
    types = {
        n: DatasetType(n, tuple(dims), spark.read.parquet(f"{folder}/datasets/{n}"), storage, calib)
        for n, dims, storage, calib in about["types"]
    }
    return transfer(Catalog(catalog.universe, elements, types, found), catalog)


def transfer(source: Catalog, target: Catalog, types: str | Sequence[str] = "*", dimensions: bool = True) -> Catalog:
    """A catalogue with what ``target`` holds and, besides, what only ``source`` does.

    ConflictError if a collection is of another kind, or a type is defined otherwise.
    """
    out = Catalog(
        target.universe,
        dict(target.elements),
        dict(target.types),
        Collections(dict(target.collections.kinds), {k: list(v) for k, v in target.collections.chains.items()}, dict(target.collections.docs)),
        target.summaries,
        dict(target.defaults),
    )
    for n, k in source.collections.kinds.items():
        if out.collections.register(n, k, source.collections.docs.get(n)) and k == Kind.CHAINED:
            out.collections.chains[n] = list(source.collections.chains[n])
    if dimensions:
        for n, rows in source.elements.items():
            keys = list(out._keys(n)) if n in out.elements else []
            out.elements[n] = ensure(out.elements[n], rows.select(*out.elements[n].columns), keys) if keys else rows
    for n in source.query_types(types):
        t = source.types[n]
        if out.register(t):
            continue
        held = out.types[n]
        merged = ensure(held.frame, t.frame.select(*held.frame.columns), ["dataset_id", "collection"])
        out.types[n] = DatasetType(n, t.dimensions, merged, t.storage_class, t.is_calibration)
    return out


def transfer_refs(
    source: Catalog,
    target: Catalog,
    refs: DataFrame,
    skip_missing: bool = True,
    register_types: bool = False,
    dimensions: bool = False,
    dry_run: bool = False,
) -> tuple[Catalog, DataFrame]:
    """Datasets of ``refs`` (dataset_type, dataset_id) from one catalogue in another, and the refs that are new there.

    Types that the target lacks are registered, or LookupError; refs that the source
    lacks are skipped, or LookupError. With ``dimensions`` the records of the data IDs come along, where they are
    absent. ``dry_run``: the target as it is, and the refs that would come. Reads the
    types' and the runs' names, of which there are few, and whether refs are missing if that matters.
    """
    wanted = refs.select("dataset_type", F.col("dataset_id")).distinct()
    names = [r["dataset_type"] for r in wanted.select("dataset_type").distinct().collect()]
    if strange := [n for n in names if n not in source.types]:
        raise LookupError(f"the source has no type {strange[0]}")
    if not register_types and (absent := [n for n in names if n not in target.types]):
        raise LookupError(f"the target has no type {absent[0]}")
    out, told = target, None
    for n in sorted(names):
        t, mine = source.types[n], wanted.where(F.col("dataset_type") == n).select("dataset_id")
        own = t.frame.where(F.col("collection") == F.col("run"))
        if not skip_missing and not mine.join(own, "dataset_id", "left_anti").isEmpty():
            raise LookupError(f"the source lacks datasets of type {n}")
        rows = own.join(mine, "dataset_id", "left_semi")
        if n in target.types:
            rows = rows.join(target.types[n].frame.select("dataset_id").distinct(), "dataset_id", "left_anti")
        part = rows.select(F.lit(n).alias("dataset_type"), "dataset_id", "run")
        told = part if told is None else told.unionByName(part)
        if dry_run:
            continue
        runs = [r["run"] for r in rows.select("run").distinct().collect()]
        kept = Collections({r: Kind.RUN for r in runs}, {}, {r: source.collections.docs[r] for r in runs if r in source.collections.docs})
        used = _used(source, n, rows) if dimensions else {}
        out = transfer(Catalog(source.universe, used, {n: replace(t, frame=rows)}, kept), out)
    if told is None:
        told = refs.sparkSession.createDataFrame([], "dataset_type string, dataset_id long, run string")
    return out, told


def _used(catalog: Catalog, name: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The records that the data IDs of datasets need, of every element of their dimensions that has a table."""
    group = catalog.universe.conform(catalog.types[name].dimensions)
    ids, out = catalog.expand(rows.select(*group.required).distinct()), {}
    for e in group.elements:
        keys = list(catalog._keys(e)) if e in catalog.elements else []
        if keys and set(keys) <= set(ids.columns):
            out[e] = catalog.elements[e].join(ids.select(*keys).distinct(), keys, "left_semi")
    return out


def populated(source: Catalog, target: Catalog, ids: DataFrame) -> Catalog:
    """The target with the records of these data IDs that it lacks, of every element that the source has a table of."""
    columns, out = set(source.expand(ids).columns), dict(target.elements)
    wide = source.expand(ids)
    for e, rows in source.elements.items():
        keys = list(source._keys(e))
        if keys and set(keys) <= columns:
            used = rows.join(wide.select(*keys).distinct(), keys, "left_semi")
            out[e] = ensure(out[e], used.select(*out[e].columns), keys) if e in out else used
    return replace(target, elements=out)


def standardized(catalog: Catalog, ids: DataFrame, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Data IDs in columns, as keys of their types: ``element.field`` columns are alternate keys and are looked up,

    defaults fill what is missing, values are cast, and the required dimensions come in their order. A row
    drops out if an alternate key or a cast finds nothing, and becomes several if
    an alternate key isn't one. QueryError if a dimension has no value.
    """
    u, out = catalog.universe, ids
    alternates: dict[str, list[str]] = {}
    for c in ids.columns:
        if "." in c:
            alternates.setdefault(c.split(".")[0], []).append(c)
        elif c not in u:
            raise QueryError(f"{c} is no dimension")
    group = u.conform(dimensions if dimensions is not None else [*(c for c in ids.columns if c in u), *alternates])
    kinds = {"int": "bigint", "string": "string"}
    for c in (c for c in ids.columns if c in u):
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` AS {kinds.get(u[c].key_type, 'string')})")).where(F.col(c).isNotNull())
    for g, v in catalog.defaults.items():
        if g in group.names and g not in out.columns:
            out = out.withColumn(g, F.lit(v))
    for e in u.sorted(alternates):
        rows = catalog.element(e)
        shared = [k for k in catalog._keys(e) if k in out.columns]
        renamed = {c.split(".", 1)[1]: f"_{i}" for i, c in enumerate(alternates[e])}
        if lost := [f for f in renamed if f not in rows.columns]:
            raise QueryError(f"{e} has no field {lost[0]}")
        held = rows.select(*catalog._keys(e), *(F.col(f).alias(n) for f, n in renamed.items()))
        out = out.withColumnsRenamed({f"{e}.{f}": n for f, n in renamed.items()}).join(held, [*shared, *renamed.values()])
        out = out.drop(*renamed.values())
    out = catalog.expand(out)
    if missing := [n for n in group.required if n not in out.columns]:
        raise QueryError(f"the data IDs have no {', '.join(missing)}")
    return out.select(*group.required)


def subset(catalog: Catalog, ids: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The distinct data IDs of some of the dimensions; what the others imply is looked up."""
    group = catalog.universe.conform(dimensions)
    return catalog.expand(ids).select(*group.required).distinct()


def fetch(table: DataFrame, **where: object) -> DataFrame:
    """Rows of an opaque table by equality, by membership in a list, or by a prefix with a ``*`` at its end."""
    for name, wanted in where.items():
        c = F.col(f"`{name}`")
        if isinstance(wanted, (list, tuple, set, frozenset)):
            table = table.where(c.isin(*wanted))
        elif isinstance(wanted, str) and wanted.endswith("*") and not is_glob(wanted[:-1]):
            table = table.where(c.startswith(wanted[:-1]))
        else:
            table = table.where(c.eqNullSafe(F.lit(wanted)))
    return table


def rewritten(catalog: Catalog, dimensions: Sequence[str], given: Mapping[str, object]) -> dict[str, object]:
    """A data ID of ``dimensions`` from values of which some are records' metadata, like a name for a number.

    They are looked up in the element that has most of them, one that is missing
    before others; LookupError without a record, AmbiguityError with several.
    """
    u = catalog.universe
    group = u.conform(dimensions)
    known = {k: v for k, v in given.items() if k in group.names}
    fields = {k.split(".")[-1]: (k.split(".")[0] if "." in k else None, v) for k, v in given.items() if k not in group.names}
    while fields:
        has = lambda n: [f for f, (owner, _) in fields.items() if f in u[n].metadata and owner in (None, n)]
        best = max((n for n in group.names if n in catalog.elements), key=lambda n: (n not in known, len(has(n))) if has(n) else (False, 0))
        own = has(best)
        if not own:
            raise LookupError(f"no dimension of {', '.join(group.names)} has {', '.join(fields)}")
        rows = catalog.element(best)
        condition: Column = F.lit(True)
        for f in own:
            condition = condition & (F.col(f) == F.lit(fields.pop(f)[1]))
        for k in rows.columns:
            if k in known:
                condition = condition & (F.col(k) == F.lit(known[k]))
        got = rows.where(condition).limit(2).collect()
        if len(got) != 1:
            raise (AmbiguityError if got else LookupError)(f"{'several records' if got else 'no record'} of {best} for {dict(given)}")
        known |= {k: got[0][k] for k in rows.columns if k in group.names}
    return known


def conflicts(a: Collections, b: Collections) -> list[str]:
    """Names that are collections of different kinds."""
    return [n for n, k in b.kinds.items() if a.kinds.get(n, k) != k]


def named(catalog: Catalog, patterns: Sequence[str]) -> list[str]:
    """Elements whose names match."""
    return [n for n in catalog.elements if any(matches(p, n) for p in patterns)]


__all__ = [
    "ConflictError", "conflicts", "export", "fetch", "load", "named", "populated", "rewritten", "standardized", "subset", "transfer",
    "transfer_refs",
]
