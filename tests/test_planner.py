"""What the planner makes of calibrations, overlaps and repeated rows; catalogue writes."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orrery import queries
from orrery.functions import timespan as ts
from orrery.functions.region import REGION, Region
from orrery.operators import catalog as ops, datasets, spatial
from orrery.plans.collections import Collections, Kind
from orrery.plans.query import QueryError, extents
from tests.test_catalog import sky  # noqa: F401

BASE = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_find_first_gives_a_key_once(sky):  # noqa: F811
    assert sky.query().join_dimensions("visit").datasets("bias", "one").count() == 2
    assert sky.query().join_dimensions("visit").datasets("bias", "both").count() == 3
    # alone, it is a filter
    assert "Aggregate" not in plan_of(sky.query().datasets("bias", "one").frame())


def test_several_calibrations_of_a_key_fail(sky):  # noqa: F811
    for collections in ("cal", ["cal", "one"]):
        with pytest.raises(PySparkException, match="more than one match"):
            sky.query().datasets("flat", collections).frame().collect()
    one = sky.query().where("flat.timespan OVERLAPS T'1970-01-01/tai'")
    got = {r["detector"]: r["dataset_id"] for r in one.datasets("flat", "cal").frame().collect()}
    assert got == {1: 7, 2: 9}


def test_calibrations_join_by_validity(spark, sky):  # noqa: F811
    span = "struct<begin: bigint, end: bigint>"
    rows = [("cam", v, (10 * v, 10 * v + 10), 1.0) for v in range(1, 9)]
    sky.elements["visit"] = spark.createDataFrame(rows, f"instrument string, visit long, timespan {span}, exposure_time double")
    q = sky.query().join_dimensions("visit")
    every = q.general(["visit", "detector"], dataset_fields={"flat": ["dataset_id"]}, collections={"flat": ["cal"]}, find_first=False)
    want = {(v, d, i) for v in range(1, 9) for d, i, a, b in ((1, 7, 0, 50), (1, 8, 50, 90), (2, 9, 0, 60), (2, 10, 40, 90)) if 10 * v < b and 10 * v + 10 > a}
    assert {(r["visit"], r["detector"], r["dataset_id"]) for r in every.frame().collect()} == want
    first = q.where("visit < 4").general(["visit", "detector"], dataset_fields={"flat": ["dataset_id"]}, collections={"flat": ["cal"]}, find_first=True)
    assert {(r["visit"], r["detector"], r["dataset_id"]) for r in first.frame().collect()} == {(v, d, {1: 7, 2: 9}[d]) for v in (1, 2, 3) for d in (1, 2)}
    twice = q.where("visit = 4").general(["visit", "detector"], dataset_fields={"flat": ["dataset_id"]}, collections={"flat": ["cal"]}, find_first=True)
    with pytest.raises(PySparkException, match="more than one match"):
        twice.frame().collect()


def test_overlaps_are_joins(spark, sky):  # noqa: F811
    written = sky.query().join_dimensions("visit", "tract").where("visit.region OVERLAPS tract.region").data_ids(["visit", "tract"]).frame()
    assert {(r["visit"], r["tract"]) for r in written.collect()} == {(1, 0), (2, 2)}
    temporal = queries.temporal_join_planned(spark, BASE)
    for df in (written, temporal, queries.spatial_join_written(spark, BASE), queries.validity_join_planned(spark, BASE)):
        df.collect()
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)


def test_spans_of_all_lengths_meet_once(spark):
    r = random.Random(1)
    spans = []
    for k in range(160):
        begin = r.choice([0, r.randrange(ts.MAX_NSEC), r.randrange(10**13)])
        end = r.choice([ts.MAX_NSEC, min(ts.MAX_NSEC, begin + r.randrange(1, 1 << r.randrange(1, 61))), begin, begin + 1])
        spans.append((k, r.randrange(3), (begin, max(begin, end))))
    spans.append((200, 1, None))
    a = spark.createDataFrame(spans, "a long, k long, s struct<begin: bigint, end: bigint>")
    b = a.select(F.col("a").alias("b"), "k", F.col("s").alias("t"))
    meets = lambda x, y: x[2] and y[2] and x[2][0] < x[2][1] and y[2][0] < y[2][1] and x[2][1] > y[2][0] and y[2][1] > x[2][0]
    for keys in ([], ["k"]):
        got = [(p["a"], p["b"]) for p in ops.overlap_join(a, b if keys else b.drop("k"), keys, "s", "t").collect()]
        want = {(x[0], y[0]) for x in spans for y in spans if meets(x, y) and (not keys or x[1] == y[1])}
        assert len(got) == len(set(got)) and set(got) == want


def test_spatial_expressions_agree_with_regions(spark):
    r, regions = random.Random(2), []
    for _ in range(70):
        lon, lat = r.uniform(0, 360), r.choice([r.uniform(-90, 90), r.uniform(-5, 5)])
        regions += [Region.point(lon, lat), Region.circle(lon, lat, r.uniform(0, 20)), Region("box", (lon, max(-90.0, lat - 5), (lon + r.uniform(0, 40)) % 360, min(90.0, lat + r.uniform(0, 9))))]
    regions += [Region.polygon([(0, 0), (9, 1), (8, 9)]), Region.box(180, 0, 360, 10), Region.circle(10, 89, 3), Region.point(359.9999, 0)]
    made = [(i, {"kind": x.kind, "values": list(x.values)}) for i, x in enumerate(regions)]
    from pyspark.sql import types as T

    df = spark.createDataFrame(made, T.StructType([T.StructField("i", T.LongType()), T.StructField("r", REGION)]))
    pairs = df.crossJoin(df.select(F.col("i").alias("j"), F.col("r").alias("q"))).where("i <= j").select("i", "j", spatial.overlaps(F.col("r"), F.col("q")).alias("o"))
    unlike = [(regions[x["i"]], regions[x["j"]]) for x in pairs.collect() if x["o"] != regions[x["i"]].overlaps(regions[x["j"]])]
    assert all(abs(_gap(a, b)) < 1e-6 for a, b in unlike), unlike
    cells = {x["i"]: set(x["p"]) for x in df.select("i", spatial._pixels(F.col("r")).alias("p")).collect()}
    for i, a in enumerate(regions):
        for j in range(i):
            if a.overlaps(regions[j]):
                assert cells[i] & cells[j], (a, regions[j])


def _gap(a, b):
    """How far two regions that are tested differently are from touching; the sampled and exact tests may differ on a border."""
    if {a.kind, b.kind} <= {"point", "circle"}:
        from orrery.functions.region import separation

        radius = lambda x: x.values[2] if x.kind == "circle" else 0.0
        return separation(*a.values[:2], *b.values[:2]) - radius(a) - radius(b)
    return math.inf


def test_counts_without_tests_are_upper_bounds(sky):  # noqa: F811
    found = sky.query().join_dimensions("visit", "tract").where("visit.region OVERLAPS tract.region").data_ids(["visit", "tract"])
    assert found.count() == 2 <= found.count(exact=False)


def test_wildcards_come_before_what_is_in_their_chains():
    c = Collections()
    c.register("t/c", Kind.CHAINED)
    for n in ("t/a", "t/b", "u"):
        c.register(n, Kind.RUN)
    c.redefine("t/c", ["u", "t/b", "t/a"])
    assert c.query("t/*", flatten=True) == ["t/a", "t/b", "u"]
    assert c.query("t/*") == ["t/c", "t/a", "t/b"] and c.query("t/[ab]") == ["t/a", "t/b"]


def test_zone_of_the_session_plays_no_part(spark):
    days = spark.createDataFrame([(20240310,), (19991231,)], "day int")
    stamps = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00.5' t")
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r["day"]: (r["s"]["begin"], r["s"]["end"]) for r in days.select("day", ts.day_obs_span(F.col("day")).alias("s")).collect()}
            when = stamps.select(ts.from_timestamp(F.col("t")).alias("n")).first()["n"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == {d: ts.Timespan.day_obs(d).bounds for d in (20240310, 19991231)} and when == 1_710_037_800_500_000_000


def test_results_in_other_shapes(sky):  # noqa: F811
    found = sky.query().datasets("bias", "both")
    pages = list(found.pages(2))
    assert [p.num_rows for p in pages] == [2, 1] and found.to_arrow().num_rows == 3
    assert sorted(r["detector"] for r in found.data_ids().frame().collect()) == [1, 2, 3]
    general = sky.query().general(["detector"], dataset_fields={"bias": ["dataset_id", "run"]}, collections={"bias": ["both"]}, find_first=True)
    got = {ids["detector"]: refs[0]["dataset_id"] for ids, refs, _ in general.tuples("bias")}
    assert got == {1: 11, 2: 22, 3: 23}
    ids = sky.query().where("detector < 3").data_ids(["detector"])
    assert ids.find_datasets("bias", "both").count() == 2
    assert {r["dataset_id"] for r in ids.related_datasets("bias", "both").collect()} == {11, 22}


def test_uploads_of_tables(spark, sky):  # noqa: F811
    import pyarrow as pa

    table = pa.table({"instrument": ["cam", "cam"], "detector": [2, 9]})
    for made in (table, table.to_pandas()):
        q = sky.query().join_data_coordinates(made)
        assert q.where("detector.purpose = 'SCIENCE'").data_ids(["detector"]).count() == 1
    assert sky.query().join_data_coordinates(table).data_ids([]).count() == 1


def test_extents_of_data_ids(sky):  # noqa: F811
    ids = sky.query().join_dimensions("visit", "tract").data_ids(["visit", "tract"]).frame()
    got = {r["visit"]: r for r in extents(sky, ids).collect()}
    assert got[1]["timespan"].begin == 100 and len(got[1]["regions"]) == 2
    assert extents(sky, sky.elements["detector"].select("instrument", "detector")).first()["timespan"] is None


def test_datasets_come_and_go(spark, sky):  # noqa: F811
    c, ids = sky, sky.elements["detector"].where("detector > 2").select("instrument", "detector")
    c.collections.register("new", Kind.RUN)
    made = datasets.insert_datasets(c, "bias", "new", ids)
    assert made.query().datasets("bias", ["new", "one"]).count() == 4 and c.query().datasets("bias", "new").count() == 0
    with pytest.raises(ops.ConflictError):
        datasets.insert_datasets(made, "bias", "new", ids)
    with pytest.raises(QueryError):
        datasets.insert_datasets(made, "bias", "cal", ids)
    there = c.types["bias"].frame.select("dataset_id", "run", "instrument", "detector")
    assert datasets.import_datasets(c, "bias", there).types["bias"].frame.count() == 4
    with pytest.raises(ops.ConflictError):
        datasets.import_datasets(c, "bias", there.withColumn("detector", F.col("detector") + 1))
    more = spark.createDataFrame([(99, "far", "cam", 4)], "dataset_id long, run string, instrument string, detector long")
    far = datasets.import_datasets(c, "bias", more)
    assert far.collections.kinds["far"] == Kind.RUN and far.query().datasets("bias", "far").count() == 1
    gone = spark.createDataFrame([(11,), (22,)], "dataset_id long")
    assert {r["dataset_id"] for r in datasets.prune(c, "bias", gone, purge=True).types["bias"].frame.collect()} == {12, 23}
    with pytest.raises(ops.ConflictError):
        datasets.remove_runs(c, ["one"])
    left = datasets.remove_runs(c, ["one"], unlink=True)
    assert left.collections.chains["both"] == ["two"] and left.types["bias"].frame.count() == 2 and c.types["bias"].frame.count() == 4
    found = datasets.refs_by_id(c, spark.createDataFrame([(7,), (12,), (500,)], "dataset_id long")).collect()
    assert {(r["dataset_id"], r["dataset_type"]) for r in found} >= {("12", "bias")} and len(found) <= 2
    assert {r["dataset_id"] for r in datasets.ids_of_run(c, "two").collect()} == {"22", "23"}
    assert datasets.record(c, "detector", {"instrument": "cam", "detector": 4})["purpose"] == "WAVEFRONT"
    with pytest.raises(ops.ConflictError):
        datasets.remove_type(c, "bias")


def test_records_and_summaries(spark, sky):  # noqa: F811
    new = spark.createDataFrame([("cam", 4, "GUIDE"), ("cam", 5, "GUIDE")], "instrument string, detector long, purpose string")
    purposes = lambda c: sorted((r["detector"], r["purpose"]) for r in c.elements["detector"].where("detector > 3").collect())
    assert purposes(datasets.insert_records(sky, "detector", new, replace_=True)) == [(4, "GUIDE"), (5, "GUIDE")]
    assert purposes(datasets.insert_records(sky, "detector", new, skip_existing=True)) == [(4, "WAVEFRONT"), (5, "GUIDE")]
    sky.elements["tract"] = spatial.indexed(sky.elements["tract"])
    more = sky.elements["tract"].where("tract = 0").drop("pixels").withColumn("tract", F.lit(9).cast("long"))
    grown = datasets.insert_records(sky, "tract", more).elements["tract"]
    assert grown.where("tract = 9").first()["pixels"] == grown.where("tract = 0").first()["pixels"]
    rows = sky.elements["detector"]
    low, high = rows.where("detector < 3"), rows.where("detector > 1").withColumn("purpose", F.lit("x"))
    assert sorted((r[1], r[2]) for r in datasets.record_union(low, high, ["instrument", "detector"]).collect()) == [(1, "SCIENCE"), (2, "SCIENCE"), (3, "x"), (4, "x")]
    assert datasets.record_intersection(low, high, ["detector"]).count() == 1 and datasets.record_difference(low, high, ["detector"]).count() == 1
    used = datasets.records_of(sky, low.select("instrument", "detector"))
    assert used["detector"].count() == 2 and used["instrument"].count() == 1
    table = spark.createDataFrame([("one", ["bias"], ["cam"]), ("two", ["bias", "flat"], ["cam", "x"])], "collection string, dataset_types array<string>, instrument array<string>")
    merged = {r["collection"]: r for r in datasets.merged_summaries(table, sky.collections).collect()}
    assert merged["both"]["dataset_types"] == ["bias", "flat"] and merged["both"]["instrument"] == ["cam", "x"]
    assert {r["dataset_type"]: r["collections"] for r in datasets.collections_by_type(table).collect()} == {"bias": ["one", "two"], "flat": ["two"]}


def test_facade(sky):  # noqa: F811
    assert datasets.query_data_ids(sky, ["detector"], where="detector.purpose = 'SCIENCE'", order_by=["-detector"], limit=2, instrument="cam").frame().collect()[0]["detector"] == 3
    assert datasets.query_datasets(sky, "bias", "both", data_id={"instrument": "cam", "detector": 2}).rows()[0]["dataset_id"] == 22
    assert datasets.query_dimension_records(sky, "visit", where="exposure_time > 30.0").count() == 1
    with pytest.raises(QueryError):
        datasets.query_datasets(sky, "bias", [])
    with pytest.raises(QueryError):
        datasets.query_datasets(sky, "bias")
    with pytest.warns(UserWarning):
        assert len(datasets.query_data_ids(sky, ["detector"], limit=-2).rows()) == 2
    made = datasets.parse_dataset_uri("repo://main/01234567-0123-5123-8123-0123456789ab")
    assert made == ("main", "01234567-0123-5123-8123-0123456789ab") == datasets.parse_dataset_uri("ivo://org/x?repo=main&id=01234567-0123-5123-8123-0123456789ab")
    with pytest.raises(ValueError):
        datasets.parse_dataset_uri("repo://main/x")


def test_ids_from_data_ids_are_uuids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    got = [r["u"] for r in df.select(datasets.data_id_uuid("t", "run", ["k", "s"]).alias("u")).collect()]
    import uuid

    assert len(set(got)) == 2 and all(uuid.UUID(u).version == 5 and uuid.UUID(u).variant == uuid.RFC_4122 for u in got)
