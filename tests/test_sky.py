"""Sky pixels, their index, and the planner's joins by them."""

import glob
import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from orrery.functions import pixels as px
from orrery.functions.region import REGION, Region
from orrery.operators import datasets, spatial
from orrery.operators.skyindex import SkyIndex, overlap_rows, pixels_of, region_union
from orrery.plans.query import Catalog, DatasetType, QueryError
from orrery.plans.collections import Collections, Kind
from orrery.plans.universe import Element, Universe


def vector(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return (math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def middle(a, b):
    s = [x + y for x, y in zip(a, b)]
    n = math.sqrt(dot(s, s))
    return tuple(x / n for x in s)


def mesh(depth):
    """All pixels of a depth, by cutting."""
    level = {8 + k: tuple(tuple(map(float, px.CORNERS[i])) for i in f) for k, f in enumerate(px.FIRST)}
    for _ in range(depth):
        level = {
            i * 4 + k: kid
            for i, (a, b, c) in level.items()
            for u, v, w in [(middle(b, c), middle(a, c), middle(a, b))]
            for k, kid in enumerate(((a, w, v), (b, u, w), (c, v, u), (u, v, w)))
        }
    return level


def holds(corners, v):
    return all(dot(cross(p, q), v) >= -1e-14 for p, q in zip(corners, corners[1:] + corners[:1]))


def frame(spark, regions, name="r"):
    rows = [(i, x and {"kind": x.kind, "values": list(x.values)}) for i, x in enumerate(regions)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("i", T.LongType()), T.StructField(name, REGION)]))


def test_pixels_of_points(spark):
    r = random.Random(1)
    points = [(math.degrees(r.uniform(0, 7)), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(200)]
    points += [(0.0, 90.0), (0.0, -90.0), (0.0, 0.0), (90.0, 0.0), (45.0, 0.0), (-720.5, 12.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for depth in (0, 1, 4):
        level = mesh(depth)
        got = df.select(px.of_point("lon", "lat", depth).alias("p")).collect()
        for (lon, lat), x in zip(points, got, strict=True):
            assert x["p"] in {i for i, c in level.items() if holds(c, vector(lon, lat))}
    deep = df.select(px.of_point("lon", "lat", 20).alias("p"), px.of_point("lon", "lat", 6).alias("q"))
    assert deep.where(px.parent(F.col("p"), 14) != F.col("q")).count() == 0 and deep.where(px.depth_of(F.col("p")) != 20).count() == 0
    assert spark.range(1).select(px.of_point("CAST(NULL AS double)", "1D", 3).alias("p")).first()["p"] is None
    with pytest.raises(ValueError):
        px.of_point("1D", "1D", 25)


def test_corners_of_pixels(spark):
    level = mesh(3)
    got = spark.createDataFrame([(i,) for i in level], "p long").select("p", px.corners("p").alias("c")).collect()
    for x in got:
        for k, v in enumerate(level[x["p"]]):
            assert dot(vector(*x["c"][2 * k : 2 * k + 2]), v) > 1 - 1e-12


def test_envelopes_hold_what_overlaps(spark):
    r, regions = random.Random(2), []
    for _ in range(40):
        lon, lat = r.uniform(0, 360), r.uniform(-80, 80)
        regions += [Region.circle(lon, lat, r.uniform(0, 9)), Region.point(lon, lat), Region.box(lon, lat, r.uniform(0.1, 30), r.uniform(0.1, 15))]
        regions.append(Region.polygon([(lon + r.uniform(-5, 5), lat + r.uniform(-5, 5)) for _ in range(4)]))
    regions += [Region.circle(3, 90, 2), Region.box(10, 0, 200, 10), Region("box", (0.0, -90.0, 360.0, 90.0)), None]
    got = {x["i"]: x["e"] for x in frame(spark, regions).select("i", px.envelope("r", 3).alias("e")).collect()}
    assert got[len(regions) - 1] is None
    pixels = {i: Region.polygon([(math.degrees(math.atan2(y, x)), math.degrees(math.asin(z))) for x, y, z in c]) for i, c in mesh(3).items()}
    for i, x in enumerate(regions[:-1]):
        if x.kind in ("circle", "point", "polygon"):
            assert {p for p, c in pixels.items() if x.overlaps(c)} <= set(got[i])
        assert len(got[i]) == len(set(got[i])) and (len(got[i]) <= 24 or x.kind != "point")
    assert set(got[len(regions) - 2]) == set(mesh(3))
    assert px.ranges([9, 1, 2, 3, 7, 8]) == [(1, 3), (7, 9)]


def sources(spark, n=3000, seed=3, radius=0.05):
    r = random.Random(seed)
    rows = [(i, {"kind": "circle", "values": [r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1))), radius]}) for i in range(n)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("source", T.LongType()), T.StructField("region", REGION)]))


def files_read(df):
    """How many files the scans of a plan read."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        if name == "FileSourceScanExec":
            total += p.metrics().apply("numFiles").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_an_index_reads_few_files_and_keeps_no_stale_rows(spark, tmp_path):
    records = sources(spark)
    path = f"file://{tmp_path}/index"
    index = SkyIndex.build(records, ["source"], path, depth=5)
    circle = Region.circle(200, 40, 6)
    truth = lambda rows: {x["source"] for x in rows.where(spatial.overlaps(F.col("region"), circle.column())).collect()}
    near = {x["source"] for x in index.near(circle).collect()}
    assert truth(records) <= near and len(near) < 3000 / 20
    every = len(glob.glob(f"{tmp_path}/index/coarse=*/*.parquet"))
    assert 0 < files_read(index.near(circle)) < every / 10
    rows = lambda: sorted((x["source"], x["pixel"]) for x in index.frame().collect())
    fresh = lambda df: sorted((x["source"], x["pixel"]) for x in overlap_rows(df, ["source"], 5).collect())
    assert rows() == fresh(records)
    # replaced: some moved, some as they were, one new, one without a region
    moved = F.when(F.col("source") % 2 == 0, F.struct(F.lit("circle").alias("kind"), F.array(F.lit(200.0), F.lit(40.0), F.lit(0.1)).alias("values"))).otherwise(F.col("region"))
    some = records.where("source < 40").withColumn("region", moved)
    new = some.unionByName(some.limit(1).withColumns({"source": F.lit(9999).cast("long")})).withColumn("region", F.when(F.col("source") != 3, F.col("region")))
    now = records.where("source >= 40").unionByName(new)
    index.put(new, records)
    assert rows() == fresh(now)
    index.put(new, now)  # nothing changed
    assert rows() == fresh(now)
    index.remove(now.where("source % 3 = 0").select("source"))
    assert rows() == fresh(now.where("source % 3 <> 0"))
    index.remove(now.select("source"))
    assert rows() == [] and index.near(circle).count() == 0


def test_what_regions_cover_together(spark):
    df = sources(spark, 300, radius=3.0).withColumn("g", F.col("source") % 5)
    got = region_union(df, ["g"], 4).collect()
    cells = {}
    for x in got:
        cells.setdefault(x["g"], []).extend(range(x["first"], x["last"] + 1))
    want = {}
    for x in overlap_rows(df, ["g"], 4).collect():
        want.setdefault(x["g"], set()).add(x["pixel"])
    assert {g: sorted(v) for g, v in want.items()} == {g: sorted(v) for g, v in cells.items()} and len(got) < sum(map(len, want.values()))


PIXELLED = Universe(
    [Element("source", "s", spatial="source"), Universe.sky_pixels(3), Universe.sky_pixels(1)],
    {"spatial": {"source": ("source",), "htm3": ("htm3",), "htm1": ("htm1",)}},
)


def test_the_planner_joins_pixels(spark, tmp_path):
    records, names = sources(spark, 200, radius=4.0), Collections()
    names.register("run", Kind.RUN)
    c = Catalog(PIXELLED, {"source": records}, collections=names)
    found = c.query().data_ids(["source", "htm3"]).frame()
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    level = {i: [(math.degrees(math.atan2(y, x)), math.degrees(math.asin(z))) for x, y, z in v] for i, v in mesh(3).items()}
    as_pixels = frame(spark, [Region("polygon", tuple(t for p in level[i] for t in p)) for i in sorted(level)], "p")
    want = records.crossJoin(as_pixels).where(spatial.overlaps(F.col("region"), F.col("p"))).collect()
    ids = sorted(level)
    assert {(x["source"], x["htm3"]) for x in found.collect()} == {(x["source"], ids[x["i"]]) for x in want}
    # datasets by pixel, found for sources
    maps = spark.createDataFrame([(i, i + 1000, "run", "run") for i in ids[::2]], "htm3 long, dataset_id long, run string, collection string")
    c.register(DatasetType("map", ("htm3",), maps))
    both = c.query().join_dimensions("source").general(["source", "htm3"], dataset_fields={"map": ["dataset_id"]}, collections={"map": ["run"]}, find_first=False)
    assert {(x["source"], x["htm3"]) for x in both.frame().collect()} == {(x["source"], ids[x["i"]]) for x in want if x["i"] % 2 == 0}
    two = c.query().join_dataset_search("map", "run").data_ids(["htm3", "htm1"]).frame().collect()
    assert {(x["htm3"], x["htm1"]) for x in two} == {(i, i // 16) for i in ids[::2]}
    inside = c.query().join_dataset_search("map", "run").where("htm3.region OVERLAPS CIRCLE(30, 20, 5)").data_ids(["htm3"]).frame()
    near = {i for k, i in enumerate(ids) if k % 2 == 0 and Region("polygon", tuple(t for p in level[i] for t in p)).overlaps(Region.circle(30, 20, 5))}
    assert {x["htm3"] for x in inside.collect()} == near
    with pytest.raises(QueryError):
        c.query().data_ids(["htm3"]).frame()
    # a stored index, which the constraint reads
    plain = c.query().where("source.region OVERLAPS CIRCLE(10, 5, 30)").data_ids(["source"])
    kept = datasets.with_index(c, "source", f"file://{tmp_path}/by-pixel", 4)
    indexed = kept.query().where("source.region OVERLAPS CIRCLE(10, 5, 30)").data_ids(["source"])
    assert "coarse#" in indexed.frame()._jdf.queryExecution().toString()
    assert sorted(plain.frame().collect()) == sorted(indexed.frame().collect()) != []
    made, told = datasets.sync_record(kept, "source", {"source": 5000}, {"region": {"kind": "circle", "values": [10.0, 5.0, 1.0]}})
    assert told is True and {x["source"] for x in made.query().where("source.region OVERLAPS CIRCLE(10, 5, 0.5)").data_ids(["source"]).rows()} >= {5000}
    gone = datasets.delete_records(made, "source", made.elements["source"].where("source = 5000").select("source"))
    assert gone.indexes["source"].frame().where("source = 5000").count() == 0
    assert pixels_of(spark, Region("box", (0.0, -90.0, 360.0, 90.0)), 2) == [(128, 255)]
