"""Spatial joins and constraints: cells narrow the pairs, an exact test decides.

A join cuts the sky into zones of latitude, and each zone into cells about as wide
as it is high, so that there are few about a pole. A region goes to the cells that its
bounds touch: at the level where they are as large as it is, and at the levels of
larger regions of the other side (``levels``); a pair is tested once, in the least cell
that both touch there. A crowded place has small regions, and so small cells.
Sky pixels, and indexes of them, are in ``functions.pixels`` and ``skyindex``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orrery.functions import pixels as px
from orrery.functions.region import Region, as_region
from orrery.operators import levels

STEP = 1.0
_COLUMNS = 1 << 12


def pixels(region: Region, step: float = STEP) -> list[int]:
    """The cells that the region's bounds touch."""
    found = set()
    for lon0, lon1, lat0, lat1 in region.bounds():
        eps = 1e-9
        for y in range(math.floor((lat0 - eps + 90) / step), math.floor((lat1 + eps + 90) / step) + 1):
            for x in range(math.floor((lon0 - eps) / step), math.floor((lon1 + eps) / step) + 1):
                found.add(y * _COLUMNS + x % math.ceil(360 / step))
    return sorted(found)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _polygon_pixels(column: pa.Array) -> pa.Array:
    if column.null_count == len(column):
        return pa.nulls(len(column), type=pa.list_(pa.int64()))
    regions = (as_region(r) for r in column.to_pylist())
    return pa.array([pixels(r) if r else [] for r in regions], type=pa.list_(pa.int64()))


@F.arrow_udf(T.BooleanType())
def _polygons_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    if a.null_count == len(a):
        return pa.nulls(len(a), type=pa.bool_())
    pairs = zip(map(as_region, a.to_pylist()), map(as_region, b.to_pylist()), strict=True)
    return pa.array([None if x is None or y is None else x.overlaps(y) for x, y in pairs], type=pa.bool_())


def _value(region: Column, k: int) -> Column:
    return F.get(region["values"], F.lit(k))


def _kind(region: Column, *kinds: str) -> Column:
    return region["kind"].isin(*kinds)


def _width(region: Column) -> Column:
    """Of a box, in degrees of longitude."""
    span = _value(region, 2) - _value(region, 0)
    return F.when(span >= 360, F.lit(360.0)).otherwise(F.pmod(span, F.lit(360.0)))


def _pixels(region: Column) -> Column:
    """The cells that a region's bounds touch; expressions, but for polygons."""
    eps = 1e-9
    lon, lat = _value(region, 0), _value(region, 1)
    r = F.when(_kind(region, "circle"), _value(region, 2)).otherwise(F.lit(0.0))
    box = _kind(region, "box")
    low = F.when(box, lat).otherwise(F.greatest(F.lit(-90.0), lat - r))
    high = F.when(box, _value(region, 3)).otherwise(F.least(F.lit(90.0), lat + r))
    round_ = (low <= -90) | (high >= 90) | (r >= 90)  # a circle about a pole has every longitude
    half = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(r)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12)))))
    first = F.when(box, lon).when(round_, F.lit(0.0)).otherwise(lon - half)
    width = F.when(box, _width(region)).when(round_, F.lit(360.0)).otherwise(2 * half)
    columns = math.ceil(360 / STEP)
    x0 = F.floor((first - eps) / STEP)
    x1 = F.least(F.floor((first + width + eps) / STEP), x0 + (columns - 1))
    rows = F.sequence(F.floor((low - eps + 90) / STEP), F.floor((high + eps + 90) / STEP))
    cells = F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(x0, x1), lambda x: (y * _COLUMNS + F.pmod(x, F.lit(columns))).cast("long"))))
    simple = F.when(region["kind"].isNull() | region.isNull(), F.array().cast("array<bigint>")).when(~_kind(region, "polygon"), F.array_distinct(cells))
    return F.coalesce(simple, _polygon_pixels(F.when(_kind(region, "polygon"), region)))


def _to_box(region: Column, lon: Column, lat: Column) -> Column:
    """The angle in degrees from a point to a box: along its meridian beside the box, else to the nearer side."""
    low, high = _value(region, 1), _value(region, 3)
    over = F.greatest(F.lit(0.0), low - lat, lat - high)

    def side(x: Column) -> Column:
        away = F.radians(lon - x)
        corner = F.least(angle(lon, lat, x, low), angle(lon, lat, x, high))
        foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(away)))
        direct = F.degrees(F.asin(F.least(F.lit(1.0), F.abs(F.cos(F.radians(lat)) * F.sin(away)))))
        return F.when((F.cos(away) > 0) & foot.between(low, high), direct).otherwise(corner)

    beside = F.pmod(lon - _value(region, 0), F.lit(360.0)) <= _width(region)
    return F.when(beside, over).otherwise(F.least(side(_value(region, 0)), side(_value(region, 2))))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _cross(a: Column, b: Column) -> Column:
    x = lambda i, j: (a[i] * b[j] - a[j] * b[i]).alias(next(c for c in "xyz" if c not in (i, j)))
    return F.struct(x("y", "z"), x("z", "x"), x("x", "y"))


def _unit(lon: Column, lat: Column) -> Column:
    a, b = F.radians(lon), F.radians(lat)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.sin(a) * F.cos(b)).alias("y"), F.sin(b).alias("z"))


def _to_polygon(region: Column, lon: Column, lat: Column) -> Column:
    """The angle in degrees from a point to a convex polygon, whose corners go counterclockwise; 0 inside."""
    places = F.sequence(F.lit(0), F.size(region["values"]) - 2, F.lit(2))
    points = F.transform(places, lambda i: _unit(F.get(region["values"], i), F.get(region["values"], i + 1)))
    apart = lambda a, b: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b))))

    def from_edge(a: Column, b: Column, v: Column) -> Column:
        def measured(n: Column) -> Column:
            beside = (_dot(_cross(n, a), v) >= 0) & (_dot(_cross(b, n), v) >= 0)
            sine = F.abs(_dot(n, v)) / F.sqrt(_dot(n, n))
            return F.when(beside, F.asin(F.least(F.lit(1.0), sine))).otherwise(F.least(apart(a, v), apart(b, v)))

        return _bound(_cross(a, b), measured)

    def measured(p: Column) -> Column:
        edges = F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def of(e: Column) -> Column:
            def at(v: Column) -> Column:
                inside = F.forall(e, lambda x: _dot(_cross(x["a"], x["b"]), v) >= -1e-15)
                return F.when(inside, F.lit(0.0)).otherwise(F.array_min(F.transform(e, lambda x: from_edge(x["a"], x["b"], v))))

            return _bound(_unit(lon, lat), at)

        return _bound(edges, of)

    return F.degrees(_bound(points, measured))


def _cornered(a: Column, b: Column) -> Column:
    """Whether a pair is a polygon and a polygon or box, which Python tests."""
    return (_kind(a, "polygon") & _kind(b, "polygon", "box")) | (_kind(a, "box") & _kind(b, "polygon"))


def _plain(a: Column, b: Column) -> Column:
    """Whether the regions of a pair overlap, by expressions alone; null for what Python tests."""
    r = lambda x: F.when(_kind(x, "circle"), _value(x, 2)).otherwise(F.lit(0.0))
    round_ = lambda x: _kind(x, "circle", "point")
    apart = angle(_value(a, 0), _value(a, 1), _value(b, 0), _value(b, 1))
    turn = F.lit(360.0)
    lons = (F.pmod(_value(b, 0) - _value(a, 0), turn) <= _width(a)) | (F.pmod(_value(a, 0) - _value(b, 0), turn) <= _width(b))
    lats = (_value(a, 1) <= _value(b, 3)) & (_value(b, 1) <= _value(a, 3))
    return (
        F.when(round_(a) & round_(b), apart <= r(a) + r(b) + 1e-9)
        .when(_kind(a, "box") & _kind(b, "box"), lats & lons)
        .when(_kind(a, "box") & round_(b), _to_box(a, _value(b, 0), _value(b, 1)) <= r(b) + 1e-10)
        .when(round_(a) & _kind(b, "box"), _to_box(b, _value(a, 0), _value(a, 1)) <= r(a) + 1e-10)
        .when(_kind(a, "polygon") & round_(b), _to_polygon(a, _value(b, 0), _value(b, 1)) <= r(b) + 1e-10)
        .when(round_(a) & _kind(b, "polygon"), _to_polygon(b, _value(a, 0), _value(a, 1)) <= r(a) + 1e-10)
    )


def overlaps(a: Column, b: Column) -> Column:
    """Whether two regions overlap; null if either is. Expressions, but for polygons with polygons or boxes."""
    polygon = _cornered(a, b)
    return F.coalesce(_plain(a, b), _polygons_overlap(F.when(polygon, a), F.when(polygon, b)))


def indexed(df: DataFrame, region: str = "region") -> DataFrame:
    """``df`` with an array of cells, the index that joins can be given."""
    return df.withColumn("pixels", _pixels(F.col(region)))


def constrained(
    df: DataFrame, region: str, literal: Region, lon: str | None = None, lat: str | None = None, refined: bool = True
) -> DataFrame:
    """Rows whose region overlaps a literal one; not ``refined``, rows that may.

    Give ``lon`` and ``lat`` if the regions are points of these columns: the bounds
    then filter in the scan, and circles are decided without Python.
    """
    if lon and lat:
        x, y = F.pmod(F.col(lon), F.lit(360.0)), F.col(lat)
        inside = F.lit(False)
        for lon0, lon1, lat0, lat1 in literal.bounds():
            inside = inside | (x.between(lon0 - 1e-9, lon1 + 1e-9) & y.between(lat0 - 1e-9, lat1 + 1e-9))
        df = df.where(inside)
        if literal.kind == "circle":
            a, b, r = literal.values
            return df.where(angle(F.col(lon), F.col(lat), F.lit(a), F.lit(b)) <= r)
    boxes = literal.bounds()

    def touches(e: Column) -> Column:
        found = F.lit(False)
        for lon0, lon1, lat0, lat1 in boxes:
            lats = (e["low"] <= lat1 + 1e-9) & (e["high"] >= lat0 - 1e-9)
            within = F.pmod(F.lit(lon0) - e["first"], F.lit(360.0)) <= e["width"] + 1e-9
            about = F.pmod(e["first"] - lon0, F.lit(360.0)) <= lon1 - lon0 + 1e-9
            found = found | (lats & (within | about | (F.lit(lon1 - lon0) >= 360)))
        return found

    near = df.where(_bound(_extent(region), touches))
    return near.where(F.coalesce(overlaps(F.col(region), literal.column()), F.lit(True))) if refined else near


def angle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The angle between points in degrees, by the haversine formula."""
    a, b, c, d = (F.radians(x) for x in (lon0, lat0, lon1, lat1))
    h = F.pow(F.sin((d - b) / 2), 2) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


#: Cells of level k are 180 degrees / 2^(FINEST - k) high.
FINEST = 24


def _extent(name: str) -> Column:
    """(first, width, low, high): the longitudes and latitudes of a region's bounds; a polygon's are those of a circle about it."""

    def of(lon: Column, lat: Column, r: Column) -> Column:
        low, high = F.greatest(F.lit(-90.0), lat - r), F.least(F.lit(90.0), lat + r)
        about = (low <= -90) | (high >= 90) | (r >= 90)  # a circle about a pole has every longitude
        ratio = F.sin(F.radians(r)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
        half = F.degrees(F.asin(F.least(F.lit(1.0), ratio)))
        first, width = F.when(about, F.lit(0.0)).otherwise(lon - half), F.when(about, F.lit(360.0)).otherwise(2 * half)
        return F.struct(first.alias("first"), width.alias("width"), low.alias("low"), high.alias("high"))

    region = F.col(f"`{name}`")

    def about(c: Column) -> Column:
        v = c["v"]
        return of(F.degrees(F.atan2(v["y"], v["x"])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v["z"])))), F.degrees(c["r"]))

    box = F.struct(_value(region, 0).alias("first"), _width(region).alias("width"), _value(region, 1).alias("low"), _value(region, 3).alias("high"))
    radius = F.when(_kind(region, "circle"), _value(region, 2)).otherwise(F.lit(0.0))
    polygon = _bound(px.bounding_circle(f"`{name}`"), about)
    return F.when(_kind(region, "box"), box).when(_kind(region, "polygon"), polygon).otherwise(of(_value(region, 0), _value(region, 1), radius))


def _own_level(extent: Column) -> Column:
    """The least level whose cells are as high as the extent, and as wide as it is where it is widest."""
    nearest = F.when(extent["low"] > 0, extent["low"]).when(extent["high"] < 0, -extent["high"]).otherwise(F.lit(0.0))
    size = F.greatest(extent["high"] - extent["low"], extent["width"] * F.cos(F.radians(nearest)), F.lit(1e-6))
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), FINEST - F.floor(F.log2(F.lit(180.0) / size)))).cast("int")


def _cells(extent: Column, level: Column) -> Column:
    """The cells of a level that an extent touches."""
    eps = 1e-9
    step = F.lit(180.0) / F.pow(F.lit(2.0), F.lit(FINEST) - level)

    def of_zone(y: Column) -> Column:
        edge = F.greatest(F.abs(y * step - 90), F.abs((y + 1) * step - 90))
        n = F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), edge))) / step)).cast("long")

        def columns(n: Column) -> Column:
            first = F.floor((extent["first"] - eps) * n / 360)
            last = F.least(F.floor((extent["first"] + extent["width"] + eps) * n / 360), first + n - 1)
            return F.transform(F.sequence(first, last), lambda x: (y * (1 << 26) + F.pmod(x, n)).cast("long"))

        return _bound(n, columns)

    top = F.pow(F.lit(2.0), F.lit(FINEST) - level) - 1
    zones = F.sequence(
        F.greatest(F.lit(0), F.floor((extent["low"] - eps + 90) / step)).cast("long"),
        F.least(top, F.floor((extent["high"] + eps + 90) / step)).cast("long"),
    )
    return F.array_distinct(F.flatten(F.transform(zones, of_zone)))


def _levelled(df: DataFrame, region: str, extent: str) -> DataFrame:
    r = F.col(f"`{region}`")
    live = df.where(r.isNotNull() & r["kind"].isNotNull()).withColumn(extent, _extent(region))
    return live.withColumn("_own", _own_level(F.col(extent)))


def _near(x: Column, y: Column) -> Column:
    """Whether two extents may touch: by latitude, and by longitude but for those about a pole."""
    lats = (x["low"] <= y["high"] + 1e-8) & (y["low"] <= x["high"] + 1e-8)
    about = lambda a, b: F.pmod(b["first"] - a["first"] + 1e-6, F.lit(360.0)) <= a["width"] + 2e-6
    polar = (F.greatest(x["high"], y["high"]) > 89) | (F.least(x["low"], y["low"]) < -89)
    return lats & (about(x, y) | about(y, x) | polar)


def _met(left: DataFrame, right: DataFrame, left_region: str, right_region: str, keys: list[str], test: Column, how: str = "inner") -> DataFrame:
    """The pairs that share a cell and pass ``test``, each once; or the left rows of such, once for each cell that has one."""
    cells = lambda extent: lambda k: _cells(F.col(extent), k)
    a, b = _levelled(left, left_region, "_left_extent"), _levelled(right, right_region, "_right_extent")
    x, y = F.col("_left_extent"), F.col("_right_extent")
    near, least = _near(x, y), F.col("_cell") == F.array_min(F.array_intersect("_left_cells", "_right_cells"))
    # the cheap test comes first, apart from the others: most pairs of a cell fail it
    on = near if how == "inner" else F.when(near, test)
    pairs = levels.meetings(a, b, keys, cells("_left_extent"), cells("_right_extent"), on, how)
    if how == "inner":
        pairs = pairs.where(F.when(test, least))
    return pairs.drop("_level", "_cell", "_left_cells", "_right_cells", "_left_extent", "_right_extent")


def meetings(left: DataFrame, right: DataFrame, left_region: str, right_region: str, keys: list[str]) -> DataFrame:
    """The pairs that share a cell and whose bounds touch, each once."""
    return _met(left, right, left_region, right_region, keys, F.lit(True))


def join(
    left: DataFrame, right: DataFrame, left_region: str, right_region: str, exact: Column | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Pairs with equal ``keys`` whose regions overlap; the columns of both, whose other names must differ.

    ``exact`` replaces the test, where columns can tell. A null region overlaps nothing.
    Polygons that meet polygons or boxes are joined apart, so that no other pair passes through Python.
    """
    a, b = F.col(f"`{left_region}`"), F.col(f"`{right_region}`")
    if exact is not None:
        return meetings(left, right, left_region, right_region, keys or []).where(exact)
    plain = ~_cornered(a, b) & F.coalesce(_plain(a, b), F.lit(True))
    out = _met(left, right, left_region, right_region, keys or [], plain)
    for ours, theirs in (("polygon",), ("polygon", "box")), (("box",), ("polygon",)):
        pairs = meetings(left.where(_kind(a, *ours)), right.where(_kind(b, *theirs)), left_region, right_region, keys or [])
        out = out.unionByName(pairs.where(F.coalesce(_polygons_overlap(a, b), F.lit(True))))
    return out


def matched(left: DataFrame, right: DataFrame, left_region: str, right_region: str, where: Column, keys: list[str] | None = None) -> DataFrame:
    """The left rows that overlap a right one with equal ``keys`` so that ``where``, a condition on both, holds; repeated, for a projection.

    A row of a cell is done with at its first match: crowded places cost no pairs.
    """
    a, b = F.col(f"`{left_region}`"), F.col(f"`{right_region}`")
    plain = F.when(where, ~_cornered(a, b) & F.coalesce(_plain(a, b), F.lit(True)))
    out = _met(left, right, left_region, right_region, keys or [], plain, "left_semi")
    for ours, theirs in (("polygon",), ("polygon", "box")), (("box",), ("polygon",)):
        pairs = meetings(left.where(_kind(a, *ours)), right.where(_kind(b, *theirs)), left_region, right_region, keys or [])
        pairs = pairs.where(where).where(F.coalesce(_polygons_overlap(a, b), F.lit(True)))
        out = out.unionByName(pairs.select(*(F.col(f"`{c}`") for c in left.columns)))
    return out


def pixel_union(df: DataFrame, keys: list[str], region: str = "region") -> DataFrame:
    """(keys, pixel): the cells that the regions of each group touch, a row for each, combined before the shuffle."""
    return df.select(*keys, F.explode(_pixels(F.col(region))).alias("pixel")).distinct()
