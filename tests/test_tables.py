"""Observation tables, transfers of some datasets, datasets with their rows, data IDs made standard, tables of collections."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import times
from orrery.operators import catalog as ops, datasets, obscore, transfer
from orrery.plans import expressions as ex
from orrery.plans.collections import Collections, Kind
from orrery.plans.query import Catalog, DatasetType, QueryError
from tests.test_catalog import sky  # noqa: F401

VISITS = "instrument string, visit long, dataset_id long, run string, collection string"


def with_images(spark, c):
    rows = [("cam", 1, 101, "one", "one"), ("cam", 2, 102, "two", "two"), ("cam", 2, 102, "two", "tag"), ("cam", 2, 103, "one", "one")]
    c.register(DatasetType("image", ("visit",), spark.createDataFrame(rows, VISITS)))
    return c


def test_observation_tables(spark, sky):  # noqa: F811
    c = with_images(spark, sky)
    made = obscore.TypeConfig("image", 2, "cutout", "v{visit:04d}", "file:///{run}/{visit}", "field", "fits")
    config = obscore.Config(
        "here", {"image": made}, ("o*",), "site", {"exposure": "visit__exposure_time"}, ("instrument", {"cam": (4e-7, 5e-7)}), "instrument"
    )
    rows = obscore.table(c, config)
    assert [f.name for f in obscore.schema(config)] == rows.columns
    assert {f.name: f.dataType for f in rows.schema} == {f.name: f.dataType for f in obscore.schema(config, {"exposure": rows.schema["exposure"].dataType})}
    got = {r["dataset_id"]: r for r in rows.collect()}
    assert set(got) == {101, 103}
    r = got[101]
    assert (r["obs_id"], r["access_url"], r["em_max"], r["facility_name"], r["instrument_name"]) == ("v0001", "file:///one/1", 5e-7, "site", "cam")
    assert r["s_region"] == "POLYGON ICRS 10.000000 0.000000 12.000000 0.000000 12.000000 2.000000 10.000000 2.000000"
    assert abs(r["s_ra"] - 11) < 1e-9 and abs(r["s_dec"] - 1) < 1e-9 and 2.8 < r["s_fov"] < 2.9 and r["exposure"] == 30.0
    assert abs(r["t_min"] - (100 - times.tai_offset(0)) / 86_400e9 - 40587) < 1e-9 and r["t_exptime"] == 50e-9
    # kept up with its datasets: nothing twice
    part = rows.where("dataset_id = 101")
    refs = spark.createDataFrame([(101,), (103,)], "dataset_id long")
    more = obscore.added(part, c, config, "image", refs)
    assert sorted(x["dataset_id"] for x in more.collect()) == [101, 103]
    assert obscore.removed(more, refs.limit(1)).count() == 1
    everywhere = obscore.table(c, obscore.Config("here", {"image": made}))
    assert everywhere.count() == 3 and everywhere.first()["facility_name"] is None
    with pytest.raises(QueryError):
        obscore.records(c, config, "bias")


def test_transfers_of_refs(spark, sky):  # noqa: F811
    c = with_images(spark, sky)
    empty = Catalog(c.universe, {n: rows.limit(0) for n, rows in c.elements.items()}, {"bias": DatasetType("bias", ("detector",), c.types["bias"].frame.limit(0))}, Collections())
    refs = spark.createDataFrame([("bias", 11), ("bias", 22), ("bias", 999)], "dataset_type string, dataset_id long")
    same, told = transfer.transfer_refs(c, empty, refs, dry_run=True)
    assert same is empty and sorted((r["dataset_id"], r["run"]) for r in told.collect()) == [(11, "one"), (22, "two")]
    made, told = transfer.transfer_refs(c, empty, refs, dimensions=True)
    assert sorted(r["dataset_id"] for r in made.types["bias"].frame.collect()) == [11, 22] and set(made.collections.kinds) == {"one", "two"}
    assert sorted(r["detector"] for r in made.elements["detector"].collect()) == [1, 2] and made.elements["instrument"].count() == 1
    assert made.elements["visit"].count() == 0 and transfer.transfer_refs(c, made, refs)[1].count() == 0
    with pytest.raises(LookupError, match="lacks datasets"):
        transfer.transfer_refs(c, empty, refs, skip_missing=False)
    more = spark.createDataFrame([("image", 101)], refs.schema)
    with pytest.raises(LookupError, match="target has no type"):
        transfer.transfer_refs(c, empty, more)
    assert transfer.transfer_refs(c, empty, more, register_types=True)[0].types["image"].frame.count() == 1
    with pytest.raises(LookupError, match="source has no type"):
        transfer.transfer_refs(c, empty, spark.createDataFrame([("x", 1)], refs.schema))
    filled = transfer.populated(c, empty, c.elements["visit"].where("visit = 2").select("instrument", "visit"))
    assert filled.elements["visit"].count() == 1 and filled.elements["instrument"].count() == 1 and filled.elements["detector"].count() == 0


def test_rows_of_datasets(spark, sky, tmp_path):  # noqa: F811
    sky.collections.register("new", Kind.RUN)
    ids = sky.elements["detector"].where("detector < 3").select("instrument", "detector")
    rows = spark.createDataFrame([("cam", d, x) for d in (1, 2) for x in (0.5, 1.5)], "instrument string, detector long, value double")
    made = datasets.put(sky, "bias", "new", rows, ids, f"file://{tmp_path}")
    assert made.query().datasets("bias", "new").count() == 2
    one = datasets.get(made, "bias", "new", {"instrument": "cam", "detector": 2}, f"file://{tmp_path}")
    assert one.columns == rows.columns and sorted(map(tuple, one.collect())) == [("cam", 2, 0.5), ("cam", 2, 1.5)]
    with pytest.raises(ops.ConflictError):
        datasets.put(made, "bias", "new", rows, ids, f"file://{tmp_path}")
    with pytest.raises(ops.ConflictError):
        datasets.put(sky, "bias", "new", rows, ids.limit(1), f"file://{tmp_path}")
    assert one.count() == 2


def test_data_ids_made_standard(spark, sky):  # noqa: F811
    ids = spark.createDataFrame([("cam", "1"), ("cam", "x"), ("cam", None)], "instrument string, detector string")
    assert [tuple(r) for r in transfer.standardized(sky, ids).collect()] == [("cam", 1)]
    sky.defaults = {"instrument": "cam"}
    named = spark.createDataFrame([("WAVEFRONT",), ("NONE",)], "`detector.purpose` string")
    assert [tuple(r) for r in transfer.standardized(sky, named).collect()] == [("cam", 4)]
    assert transfer.standardized(sky, named.limit(0), ["detector"]).columns == ["instrument", "detector"]
    for bad in ("`nothing` string", "`detector.nothing` string"):
        with pytest.raises(QueryError):
            transfer.standardized(sky, spark.createDataFrame([("a",)], bad))
    with pytest.raises(QueryError, match="have no"):
        transfer.standardized(sky, ids, ["visit"])
    both = sky.elements["detector"].select("instrument", "detector")
    assert [tuple(r) for r in transfer.subset(sky, both, ["instrument"]).collect()] == [("cam",)]


def test_tables_of_collections(spark, sky):  # noqa: F811
    summaries = spark.createDataFrame([("one", ["bias"])], "collection string, dataset_types array<string>")
    got = {r["name"]: r for r in datasets.collection_table(sky, summaries).collect()}
    assert set(got) == {"one", "two", "cal", "both"} and got["two"]["dataset_types"] is None and got["one"]["parents"] == ["both"]
    assert {r["name"] for r in datasets.collection_table(sky, kinds=[Kind.CHAINED, Kind.CALIBRATION]).collect()} == {"both", "cal"}
    with pytest.raises(ValueError, match="order"):
        sky.collections.query(["one", "t*"], ordered=True)
    missing = []
    assert sky.query_types(["b*", "flat", "none", "x*"], missing) == ["bias", "flat"] and missing == ["none"]


def test_predicates_of_many(sky):  # noqa: F811
    q = sky.query().join_dimensions("detector")
    ones = [ex.compare("=", q.x("detector"), ex.as_value(k)) for k in (1, 2, 3)]
    count = lambda p: q.where(p).data_ids(["detector"]).count()
    science = ex.compare("=", q.x("detector.purpose"), ex.as_value("SCIENCE"))
    assert count(ex.all_of(ones[0], science)) == 1
    assert (count(ex.any_of(*ones)), count(ex.all_of(ex.any_of(*ones[1:]), ex.not_(science))), count(ex.not_(ex.any_of(*ones))), count(ex.all_of()), count(ex.any_of())) == (3, 0, 1, 4, 0)
