"""Smaller parts of a catalogue's upkeep: trash, provenance, acceptance rules, ingest of files, observation tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.operators import catalog as ops
from orrery.plans.query import Catalog, QueryError

# ---------------------------------------------------------------- trash


def trashed(locations: DataFrame, trash: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locations (dataset_id, path) without those of ``refs``, and the trash with them."""
    gone = refs.select("dataset_id").distinct()
    return locations.join(gone, "dataset_id", "left_anti"), trash.unionByName(locations.join(gone, "dataset_id", "left_semi")).distinct()


def removable(locations: DataFrame, trash: DataFrame) -> DataFrame:
    """Trash whose path no dataset that stays uses."""
    return trash.join(locations.select("path").distinct(), "path", "left_anti").select(*trash.columns)


# ---------------------------------------------------------------- acceptance

ALL = "all"


def accepted(names: Sequence[Column], accept: Iterable[str] = (), reject: Iterable[str] = ()) -> Column:
    """Whether rows are let in, by ``names`` that may stand for them (a type, its storage class, an instrument).

    A name that is accepted decides, then one that is rejected, then ``all``; a
    row that no rule names is let in if nothing is accepted by name.
    """
    accept, reject = set(accept), set(reject)
    if ALL in accept and ALL in reject:
        raise ValueError("all cannot be both accepted and rejected")

    def named(rules: set[str]) -> Column:
        found = F.lit(False)
        for n in names:
            found = found | F.coalesce(n.isin(*(rules - {ALL})), F.lit(False)) if rules - {ALL} else found
        return found

    rest = F.lit(ALL not in reject and (ALL in accept or not accept))
    return F.when(named(accept), F.lit(True)).when(named(reject), F.lit(False)).otherwise(rest)


# ---------------------------------------------------------------- provenance


def provenance(refs: DataFrame, inputs: DataFrame, prefix: str = "", sep: str = ".", keys: Sequence[str] = (), most: int | None = None, extras: bool = True) -> DataFrame:
    """dataset_id and a flat map of its provenance: id, run, datasettype and dataid of it, and of its inputs by number.

    ``refs``: dataset_id, dataset_type, run, ``keys``. ``inputs``: dataset_id, position, input_id, input_run,
    input_type, and a map ``extra``. With more than ``most`` inputs none is listed. An input's map may not name id,
    run or datasettype; computing one that does fails.
    """
    name = lambda *parts: F.lit(sep.join([*([prefix] if prefix else []), *parts]))
    up = prefix[:1].isupper()
    cased = lambda c: F.upper(c) if up else c
    own = [("id", "dataset_id"), ("run", "run"), ("datasettype", "dataset_type"), *((f"dataid {k}", k) for k in keys)]
    # the separator of words within a key is the same as that between its parts
    mine = F.map_from_entries(F.array(*(F.struct(cased(name(*a.split())).alias("k"), F.col(b).cast("string").alias("v")) for a, b in own)))
    start = F.concat(name("input"), F.lit(sep), F.col("position").cast("string"), F.lit(sep))
    entry = lambda a, b: F.struct(cased(F.concat(start, F.lit(a))).alias("k"), F.col(b).cast("string").alias("v"))
    fixed = F.array(entry("id", "input_id"), entry("run", "input_run"), entry("datasettype", "input_type"))
    reserved = F.exists(F.map_keys("extra"), lambda k: F.lower(k).isin("id", "run", "datasettype"))
    more = F.transform(F.map_entries("extra"), lambda e: F.struct(cased(F.concat(start, e["key"])).alias("k"), e["value"].cast("string").alias("v")))
    checked = F.when(F.coalesce(reserved, F.lit(False)), F.raise_error(F.lit("extra provenance has a reserved key"))).otherwise(F.coalesce(more, F.array().cast("array<struct<k: string, v: string>>")))
    listed = inputs.select("dataset_id", F.concat(fixed, checked if extras else F.array().cast("array<struct<k: string, v: string>>")).alias("e"))
    grouped = listed.groupBy("dataset_id").agg(F.flatten(F.collect_list("e")).alias("e"), F.count("*").alias("n"))
    theirs = F.map_from_entries(F.coalesce(F.when(F.col("n") <= most, F.col("e")) if most is not None else F.col("e"), F.array().cast("array<struct<k: string, v: string>>")))
    return refs.join(grouped, "dataset_id", "left").select("dataset_id", F.map_concat(mine, theirs).alias("provenance"))


def provenance_parts(flat: DataFrame, prefix: str = "", sep: str = ".") -> DataFrame:
    """dataset_id, input number (null for the dataset itself), key and value of each entry of flat maps."""
    head = [*([prefix.lower()] if prefix else [])]
    entries = flat.select("dataset_id", F.explode("provenance").alias("key", "value"))
    parts = F.split(F.lower("key"), f"\\{sep}")
    body = F.slice(parts, len(head) + 1, F.size(parts)) if head else parts
    numbered = (F.get(body, F.lit(0)) == "input") & F.coalesce(F.get(body, F.lit(1)).rlike(r"^\d+$"), F.lit(False))
    number = F.when(numbered, F.get(body, F.lit(1)).cast("int"))
    rest = F.array_join(F.when(numbered, F.slice(body, 3, F.size(body))).otherwise(body), sep)
    return entries.select("dataset_id", number.alias("input"), rest.alias("key"), "value")


# ---------------------------------------------------------------- ingest of files


def ingested(spark: SparkSession, folder: str, pattern: str, keys: Mapping[str, str], checksum: bool = False) -> DataFrame:
    """Files below a folder as datasets: path, size, checksum and the data ID that a regular expression's groups give.

    ``keys`` are the groups' names and types, in order; files that don't match are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.where(F.col("path").rlike(pattern))
    digest = F.sha2("content", 256) if checksum else F.lit(None).cast("string")
    ids = [F.regexp_extract("path", pattern, i + 1).cast(t).alias(k) for i, (k, t) in enumerate(keys.items())]
    return found.select("path", F.col("length").alias("size"), digest.alias("checksum"), *ids)


# ---------------------------------------------------------------- chains, refs and coordinates


def chain_ends(chain: DataFrame) -> DataFrame:
    """parent, first and last position of each chain, where new children go before and behind."""
    return chain.groupBy("parent").agg(F.min("position").alias("first"), F.max("position").alias("last"))


def by_type(refs: DataFrame) -> dict[str, DataFrame]:
    """Refs (dataset_type, ...) of each type. Reads the types' names: as many as the catalogue has types, which the driver knows anyway."""
    names = sorted(r["dataset_type"] for r in refs.select("dataset_type").distinct().collect())
    return {n: refs.where(F.col("dataset_type") == n) for n in names}


def coordinate_union(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    """Both data IDs' values; ConflictError if they contradict."""
    if clash := [k for k in a if k in b and a[k] != b[k]]:
        raise ops.ConflictError(f"{clash[0]} is both {a[clash[0]]!r} and {b[clash[0]]!r}")
    return {**a, **b}


def expanded(catalog: Catalog, data_id: Mapping[str, Any], dimensions: Sequence[str] | None = None, defaults: bool = True) -> dict[str, Any]:
    """One data ID with what its values imply, read from the records; LookupError if one is missing."""
    u = catalog.universe
    group = u.conform(dimensions if dimensions is not None else list(data_id))
    known = {**({k: v for k, v in catalog.defaults.items() if k in group.names} if defaults else {}), **{k: v for k, v in data_id.items() if k in group.names}}
    for name in u.sorted(group.names, reverse=True):
        e = u[name]
        if name not in known or not any(i not in known for i in e.implied):
            continue
        rows = catalog.element(name)
        for k in catalog._keys(name):
            if k in known:
                rows = rows.where(F.col(k) == F.lit(known[k]))
        row = rows.first()
        if row is None:
            raise LookupError(f"there is no {name} {known[name]!r}")
        known.update({i: row[i] for i in e.implied if i not in known})
    if missing := [n for n in group.names if n not in known]:
        raise LookupError(f"the data ID has no {', '.join(missing)}")
    return {n: known[n] for n in group.names}


# ---------------------------------------------------------------- observation tables


def observations(table: DataFrame, columns: Sequence[str] | None = None, **equal: Any) -> DataFrame:
    """Rows of an observation table by equality."""
    for k, v in equal.items():
        if k not in table.columns:
            raise QueryError(f"there is no column {k}")
        table = table.where(F.col(k).eqNullSafe(F.lit(v)))
    return table.select(*columns) if columns else table


def migrated(rows: DataFrame, columns: Mapping[str, str | None], added: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of another universe: columns renamed, or left out where the new name is None, and constants added."""
    kept = [F.col(f"`{c}`").alias(columns.get(c) or c) for c in rows.columns if columns.get(c, c) is not None]
    return rows.select(*kept, *(F.lit(v).alias(k) for k, v in (added or {}).items()))
