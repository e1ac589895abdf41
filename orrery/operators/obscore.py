"""Observation tables: one flat row for each dataset, after the ObsCore model, made of the records of its data ID.

What a row holds follows from a configuration: which types take part, in which
collections, with which templates; the schema follows from that too. A table is kept up with
its datasets by adding and removing rows; nothing is made twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.functions import pixels as px, times, timespan as ts
from orrery.functions.glob import matches
from orrery.operators import catalog as ops
from orrery.plans.query import Catalog, QueryError

# The columns of the model that are always there, and their types.
COLUMNS = {
    "dataproduct_type": "string", "dataproduct_subtype": "string", "calib_level": "int", "target_name": "string", "obs_id": "string",
    "obs_collection": "string", "obs_publisher_did": "string", "access_url": "string", "access_format": "string", "s_ra": "double",
    "s_dec": "double", "s_fov": "double", "s_region": "string", "t_min": "double", "t_max": "double", "t_exptime": "double",
    "em_min": "double", "em_max": "double", "facility_name": "string", "instrument_name": "string",
}
_MJD_1970 = 40587


@dataclass(frozen=True)
class TypeConfig:
    """What rows of one dataset type have; templates hold ``{column}`` of the data ID and its records."""

    dataproduct_type: str
    calib_level: int = 1
    dataproduct_subtype: str | None = None
    obs_id: str | None = None
    access_url: str | None = None
    target_name: str | None = None
    access_format: str | None = None


@dataclass(frozen=True)
class Config:
    obs_collection: str
    types: Mapping[str, TypeConfig]
    #: Patterns of collections whose datasets take part; all if there are none.
    collections: Sequence[str] = ()
    facility_name: str | None = None
    #: Expressions over the data ID and its records, as SQL: more columns, or other values of the model's.
    extra: Mapping[str, str] = field(default_factory=dict)
    #: The range of wavelengths in metres of each value of a column.
    spectral: tuple[str, Mapping[str, tuple[float, float]]] | None = None
    instrument: str | None = None


def schema(config: Config, kinds: Mapping[str, T.DataType] | None = None) -> T.StructType:
    """The table's schema: dataset_id, dataset_type, the model's columns, and those that are configured besides, with their types."""
    fields = [T.StructField("dataset_id", T.LongType()), T.StructField("dataset_type", T.StringType())]
    made = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}
    fields += [T.StructField(n, made[t]) for n, t in COLUMNS.items()]
    return T.StructType([*fields, *(T.StructField(n, (kinds or {}).get(n, T.StringType())) for n in config.extra if n not in COLUMNS)])


def _text(template: str | None) -> Column:
    return ops.templated(template) if template is not None else F.lit(None).cast("string")


def _mjd(tai: Column, missing: int) -> Column:
    """Days of UTC, as an MJD; null for a span that is unbounded there."""
    return F.when(tai != missing, times.utc_of(tai) / F.lit(86_400_000_000_000.0) + _MJD_1970)


def _sky(region: str | None) -> dict[str, Column]:
    none = {"s_ra": F.lit(None), "s_dec": F.lit(None), "s_fov": F.lit(None), "s_region": F.lit(None)}
    if region is None:
        return none
    r, c = F.col(f"`{region}`"), F.col("_circle")
    fixed = lambda x: x.cast("decimal(12, 6)").cast("string")
    number = lambda k: fixed(F.get(r["values"], F.lit(k)))
    listed = F.array_join(F.transform(r["values"], fixed), " ")
    corner = lambda i, j: F.concat(number(i), F.lit(" "), number(j))
    box = F.concat_ws(" ", F.lit("POLYGON ICRS"), corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3))
    named = F.when(r["kind"] == "box", box).otherwise(F.concat(F.upper(F.when(r["kind"] == "point", "position").otherwise(r["kind"])), F.lit(" ICRS "), listed))
    degrees = lambda x: F.degrees(x)
    return {
        "s_ra": F.pmod(degrees(F.atan2(c["v"]["y"], c["v"]["x"])), F.lit(360.0)),
        "s_dec": degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c["v"]["z"])))),
        "s_fov": 2 * degrees(c["r"]),
        "s_region": F.when(r.isNotNull(), named),
    }


def records(catalog: Catalog, config: Config, name: str, refs: DataFrame | None = None) -> DataFrame:
    """The rows of a type's datasets, or of those of ``refs`` (dataset_id), that are in the configured collections."""
    if name not in config.types:
        raise QueryError(f"{name} takes no part in the observation table")
    t, made, u = catalog.types[name], config.types[name], catalog.universe
    group = u.conform(t.dimensions)
    rows = t.frame.where(F.col("collection") == F.col("run"))
    if config.collections:
        runs = [n for n in catalog.collections.kinds if any(matches(p, n) for p in config.collections)]
        rows = rows.where(F.col("collection").isin(catalog.collections.query(runs, flatten=True)) if runs else F.lit(False))
    if refs is not None:
        rows = rows.join(refs.select("dataset_id").distinct(), "dataset_id", "left_semi")
    wide = catalog.expand(rows.select("dataset_id", "run", *group.required), records=True)
    spatial, temporal = next(iter(group.spatial.values()), None), next(iter(group.temporal.values()), None)
    region = f"{spatial}__region" if spatial and f"{spatial}__region" in wide.columns else None
    if region:
        wide = wide.withColumn("_circle", px.bounding_circle(f"`{region}`"))
    span = F.col(f"`{temporal}__timespan`") if temporal else None
    values: dict[str, Column] = {
        "dataproduct_type": F.lit(made.dataproduct_type),
        "dataproduct_subtype": F.lit(made.dataproduct_subtype),
        "calib_level": F.lit(made.calib_level),
        "target_name": _text(made.target_name),
        "obs_id": _text(made.obs_id),
        "obs_collection": F.lit(config.obs_collection),
        "obs_publisher_did": F.concat(F.lit(f"ivo://{config.obs_collection}/"), F.col("dataset_id").cast("string")),
        "access_url": _text(made.access_url),
        "access_format": F.lit(made.access_format),
        **_sky(region),
        "t_min": _mjd(span["begin"], ts.MIN_NSEC) if span is not None else F.lit(None),
        "t_max": _mjd(span["end"], ts.MAX_NSEC) if span is not None else F.lit(None),
        "t_exptime": (span["end"] - span["begin"]) / F.lit(1e9) if span is not None else F.lit(None),
        "em_min": F.lit(None),
        "em_max": F.lit(None),
        "facility_name": F.lit(config.facility_name),
        "instrument_name": F.col(config.instrument) if config.instrument in wide.columns else F.lit(None),
    }
    if config.spectral and config.spectral[0] in wide.columns:
        column, bands = config.spectral
        for k, end in enumerate(("em_min", "em_max")):
            limits = F.create_map(*(F.lit(x) for band, pair in bands.items() for x in (band, float(pair[k]))))
            values[end] = F.try_element_at(limits, F.col(column))
    values |= {n: F.expr(e) for n, e in config.extra.items()}
    kept = [c.cast(COLUMNS[n]).alias(n) if n in COLUMNS else c.alias(n) for n, c in values.items()]
    return wide.select("dataset_id", F.lit(name).alias("dataset_type"), *kept)


def table(catalog: Catalog, config: Config) -> DataFrame:
    """The rows of all configured types that there are."""
    out = None
    for name in sorted(config.types):
        if name in catalog.types:
            part = records(catalog, config, name)
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise QueryError("no configured type is there")
    return out


def added(held: DataFrame, catalog: Catalog, config: Config, name: str, refs: DataFrame) -> DataFrame:
    """The table with the rows of new datasets; those that it has already stay as they are."""
    new = records(catalog, config, name, refs.join(held.select("dataset_id"), "dataset_id", "left_anti"))
    return held.unionByName(new)


def removed(held: DataFrame, refs: DataFrame) -> DataFrame:
    """The table without the rows of these datasets."""
    return held.join(refs.select("dataset_id").distinct(), "dataset_id", "left_anti")
