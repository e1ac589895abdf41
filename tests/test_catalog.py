"""Collections, the planner and catalogue writes."""

import pytest
from pyspark.sql import functions as F

from orrery import queries
from orrery.functions import timespan as ts
from orrery.functions.region import Region
from orrery.operators import catalog as ops, spatial
from orrery.plans.collections import Collections, Kind
from orrery.plans.expressions import ExpressionError
from orrery.plans.query import Catalog, DatasetType, QueryError, find_dataset
from orrery.plans.universe import Element, Universe
from orrery.sources import columnar

SKY = Universe(
    [
        Element("instrument", "name", "string", governor=True),
        Element("detector", "id", required=("instrument",), metadata={"purpose": "string"}),
        Element("visit", "id", required=("instrument",), spatial="observed", temporal="observed", metadata={"exposure_time": "float"}),
        Element("skymap", "name", "string", governor=True),
        Element("tract", "id", required=("skymap",), spatial="sky"),
    ],
    {"spatial": {"observed": ("visit",), "sky": ("tract",)}, "temporal": {"observed": ("visit",)}},
)


@pytest.fixture
def sky(spark):
    box = lambda x, y: {"kind": "box", "values": [float(x), float(y), float(x + 2), float(y + 2)]}
    region, span = "struct<kind: string, values: array<double>>", "struct<begin: bigint, end: bigint>"
    frame = spark.createDataFrame
    elements = {
        "instrument": frame([("cam",)], "instrument string"),
        "detector": frame([("cam", d, "SCIENCE" if d < 4 else "WAVEFRONT") for d in range(1, 5)], "instrument string, detector long, purpose string"),
        "visit": frame(
            [("cam", v, box(10 * v, 0), (100 * v, 100 * v + 50), 30.0 * v) for v in (1, 2)],
            f"instrument string, visit long, region {region}, timespan {span}, exposure_time double",
        ),
        "skymap": frame([("map",)], "skymap string"),
        "tract": frame([("map", t, box(9 + 5 * t, 1)) for t in range(4)], f"skymap string, tract long, region {region}"),
    }
    names = Collections()
    for n in ("one", "two"):
        names.register(n, Kind.RUN)
    names.register("cal", Kind.CALIBRATION)
    names.register("both", Kind.CHAINED)
    names.redefine("both", ["two", "one"])
    c = Catalog(SKY, elements, collections=names)
    flat = frame([("cam", 1, 11, "one"), ("cam", 2, 12, "one"), ("cam", 2, 22, "two"), ("cam", 3, 23, "two")], "instrument string, detector long, dataset_id long, collection string")
    c.register(DatasetType("bias", ("detector",), flat.withColumn("run", F.col("collection"))))
    calib = frame([("cam", 1, 7, "cal", (0, 50)), ("cam", 1, 8, "cal", (50, 90)), ("cam", 2, 9, "cal", (0, 60)), ("cam", 2, 10, "cal", (40, 90))], f"instrument string, detector long, dataset_id long, collection string, timespan {span}")
    c.register(DatasetType("flat", ("detector",), calib.withColumn("run", F.lit("cal")), is_calibration=True))
    return c


def test_closure_and_order():
    g = SKY.conform(["tract", "detector"])
    assert g.names == ("instrument", "detector", "skymap", "tract") and g.governors == ("instrument", "skymap")
    assert SKY.sorted(["visit", "instrument"], reverse=True) == ["visit", "instrument"]
    with pytest.raises(ValueError):
        SKY.conform(["nothing"])


def test_find_first_in_chain(sky):
    got = {r["detector"]: r["dataset_id"] for r in sky.query().datasets("bias", "both").frame().collect()}
    assert got == {1: 11, 2: 22, 3: 23}
    assert sky.query().datasets("bias", "both", find_first=False).count() == 4
    assert sky.query().where("detector.purpose = 'SCIENCE' AND detector > 1", instrument="cam").datasets("bias", "both").order_by("-detector").limit(1).frame().collect()[0]["dataset_id"] == 23
    with pytest.raises(QueryError):
        sky.query().datasets("bias", "b*")
    assert not sky.query().datasets("bias", []).any(execute=False)


def test_spatial_join_is_inferred(sky):
    got = {(r["visit"], r["tract"]) for r in sky.query().data_ids(["visit", "tract"]).frame().collect()}
    assert got == {(1, 0), (2, 2)}
    q = sky.query().join_dimensions("tract").where("tract.region OVERLAPS POINT(15, 2)")
    assert [r["tract"] for r in q.data_ids(["tract"]).frame().collect()] == [1]


def test_time_in_where_and_records(sky):
    q = sky.query().join_dimensions("visit")
    assert q.where(q.x("visit.timespan").overlaps(ts.Timespan(149, 200))).data_ids(["visit"]).count() == 1
    assert q.where("visit.timespan.begin >= visit.timespan.begin AND exposure_time > 30.0").dimension_records("visit").count() == 1
    with pytest.raises(ExpressionError):
        q.where("visit.timespan < visit.timespan")


def test_calibration_lookup_and_ambiguity(sky):
    assert find_dataset(sky, "flat", {"detector": 1}, ["cal"], ts.Timespan.instant(55))["dataset_id"] == 8
    assert find_dataset(sky, "flat", {"detector": 1}, ["cal"]) is None
    with pytest.raises(ops.AmbiguityError):
        find_dataset(sky, "flat", {"detector": 2}, ["cal"], ts.Timespan.instant(50))


def test_uploads_materialize_and_soft_limit(sky):
    q = sky.query().join_data_coordinates([{"instrument": "cam", "detector": d} for d in (2, 9)])
    # uploaded data IDs count as valid: their own table is joined only if something of it is wanted
    assert q.data_ids(["detector"]).count() == 2
    assert q.where("detector.purpose = 'SCIENCE'").data_ids(["detector"]).count() == 1
    kept = sky.query().where("detector < 3").materialize(["detector"])
    assert kept.datasets("bias", "both").count() == 2
    with pytest.warns(UserWarning):
        assert len(sky.query().data_ids(["detector"]).limit(-3).rows()) == 3
    with pytest.raises(QueryError):
        sky.query().join_data_coordinates([])


def test_collections():
    c = Collections()
    for n in ("run/a", "run/b"):
        c.register(n, Kind.RUN)
    c.register("x", Kind.CHAINED)
    c.register("y", Kind.CHAINED)
    c.redefine("y", ["run/b", "x"])
    c.extend("x", ["run/a"])
    c.prepend("x", ["run/b"])
    assert c.flatten(["y"]) == ["run/b", "run/a"]
    assert c.query("run/*") == ["run/a", "run/b"] and c.query(["*", "x"], flatten=True, include_chains=True)[0] == "run/a"
    with pytest.raises(ops.ConflictError):
        c.redefine("x", ["y"])
    with pytest.raises(LookupError):
        c.query("gone")
    with pytest.raises(ops.ConflictError):
        c.remove("run/a")
    c.remove("run/a", unlink=True)
    assert c.chains["x"] == ["run/b"]


def test_certify_and_decertify(spark):
    rows = lambda *r: spark.createDataFrame([(k, d, s) for k, d, s in r], "k long, d long, validity struct<begin: bigint, end: bigint>")
    held = rows((1, 1, (0, 10)), (2, 2, (0, 10)))
    assert ops.certify(held, rows((1, 3, (10, 20))), ["k"]).count() == 3
    with pytest.raises(ops.ConflictError):
        ops.certify(held, rows((1, 3, (9, 20))), ["k"])
    with pytest.raises(ops.ConflictError):
        ops.certify(held, rows((3, 3, (0, 20)), (3, 4, (19, 30))), ["k"])
    left = ops.decertify(held, ts.Timespan(4, 6), only=F.col("k") == 1).collect()
    assert sorted((r.k, r.validity.begin, r.validity.end) for r in left) == [(1, 0, 4), (1, 6, 10), (2, 0, 10)]


def test_sync(spark):
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    assert ops.sync(t, {"k": 2}, {"v": "b"})[1] is True
    assert ops.sync(t, {"k": 1}, {"v": "a"})[1] is False
    with pytest.raises(ops.ConflictError):
        ops.sync(t, {"k": 1}, {"v": "b"})
    new, old = ops.sync(t, {"k": 1}, {"v": "b"}, update=True)
    assert old == {"v": "a"} and new.collect()[0]["v"] == "b"


def test_regions():
    circle, box = Region.circle(359, 0, 3), Region.box(1, 0, 1, 1)
    assert circle.overlaps(box) and not circle.overlaps(Region.box(10, 0, 1, 1))
    square = Region.polygon([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])
    assert len(square.vertices) == 4 and square.contains(2, 2) and not square.contains(5, 2)
    assert square.overlaps(Region.circle(5, 2, 1.5)) and Region.from_pos("RANGE 1 2 1 2").overlaps(square)
    assert set(spatial.pixels(circle)) & set(spatial.pixels(box))


def test_columns_and_row_groups(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "ab long, b string, ac double")
    assert columnar.select(df, ["a*", "b"]).columns == ["ab", "ac", "b"]
    with pytest.raises(LookupError):
        columnar.select(df, ["z*"])
    assert columnar.row_width(df.schema) == 26 and columnar.row_group_rows(df.schema, 260) == 10


def test_planned_queries_match_sql(spark):
    import duckdb

    con, base = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    for name in ("find_first_shipments", "records_customer_constrained", "where_not_or_cnf", "expand_data_ids", "obscore_flat", "general_part_fields", "where_arith_mod"):
        df, sql = queries.QUERIES[name](spark, base), con.sql(queries.ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(sql.columns)
        want = sql.select(",".join(f'"{c}"' for c in columns)).fetchall()
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want), name


def test_whole_writes_match_sql_and_grow_with_the_tables(spark):
    import duckdb

    con, base = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("supplier", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    made = {name: sorted(map(tuple, queries.QUERIES[name](spark, base).collect())) for name in ("import_conflicts_whole", "ensure_absent_whole")}
    for name, got in made.items():
        assert got == sorted(con.sql(queries.ORACLES[name]).fetchall()), name
    # the part is in the id; conflicts of parts from 200 on are found, and so are rows kept of suppliers from 20 on
    assert any(i // 100_000 % 1_000_000 > 200 for i, _ in made["import_conflicts_whole"])
    assert any(k >= 20 and name != "new" for k, name in made["ensure_absent_whole"])


def test_crossing_slivers_overlap():
    strip = lambda x0, y0, x1, y1: Region.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
    box = lambda x0, y0, x1, y1: Region("box", (float(x0), float(y0), float(x1), float(y1)))
    flat, tall = strip(0, -0.05, 10, 0.05), strip(3.0, -5.3, 3.1, 4.7)
    cases = [
        (flat, tall, strip(13.0, -5.3, 13.1, 4.7)),
        (flat, box(3.0, -5.3, 3.1, 4.7), box(10.1, -5.3, 10.2, 4.7)),
        (tall, box(0, 0.01, 10, 0.02), box(3.2, 0.01, 10, 0.02)),
        (flat, Region.circle(3.3, 0.06, 0.011), Region.circle(3.3, 0.07, 0.011)),
        (box(0, 40, 10, 40.1), Region.circle(3.3, 40.11, 0.011), Region.circle(3.3, 40.12, 0.011)),
        (box(3.0, 20, 3.1, 40), Region.circle(3.11, 31.3, 0.009), Region.circle(3.13, 31.3, 0.009)),
    ]
    for a, near, far in cases:
        assert a.overlaps(near) and near.overlaps(a), (a, near)
        assert not a.overlaps(far) and not far.overlaps(a), (a, far)
