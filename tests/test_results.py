"""Results that can be asked for again, reasons for empty ones, several types at once, stored layouts, layers of records, times of columns."""

import datetime
import glob

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orrery.functions import timespan as ts, times
from orrery.operators import catalog as ops, datasets
from orrery.plans.collections import Kind, flattened, ordered
from orrery.plans.query import Catalog, DatasetType, Snapshot, all_datasets, find_dataset
from orrery.plans.universe import Element, Universe
from tests.test_catalog import sky  # noqa: F401
from tests.test_planner import plan_of
from tests.test_sky import files_read


def test_pages_in_any_order(spark, tmp_path):
    u = Universe([Element("thing", "t", metadata={"size": "int"})])
    rows = spark.range(10_000).select(F.col("id").alias("thing"), (F.col("id") % 7).alias("size"))
    c = Catalog(u, {"thing": rows.repartition(5)})
    found = c.query().general(["thing"], dimension_fields={"thing": ["size"]}).order_by("-thing.size")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = found.snapshot(f"file://{tmp_path}/pages", 300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((6 - s, t) for t, s in ((i, i % 7) for i in range(10_000))))
    assert len(pages) == 34
    for n in (33, 0, 17, 17):
        got = [(6 - r["thing__size"] if "thing__size" in pages.schema.names else 6 - r["size"], r["thing"]) for r in pages.page(n).collect()]
        assert got == want[300 * n : 300 * n + 300]
    every = len(glob.glob(f"{tmp_path}/pages/_range=*/*.parquet"))
    assert files_read(pages.page(17)) <= 2 < every
    for n in (-1, 34):
        with pytest.raises(IndexError):
            pages.page(n)
    assert sum(t.num_rows for t in pages) == 10_000
    none = Snapshot.write(rows.where("thing < 0").orderBy("thing"), f"file://{tmp_path}/none", 10)
    assert len(none) == 0 and list(none) == []


def test_reasons_come_from_the_query_that_ran(spark, sky):  # noqa: F811
    rows, why = sky.query().datasets("bias", "both").rows_or_reasons()
    assert len(rows) == 3 and why == []
    rows, why = sky.query().where("detector.purpose = 'NONE'").datasets("bias", "both").rows_or_reasons()
    assert rows == [] and why == ["the condition left nothing"]
    sky.elements["detector"] = sky.elements["detector"].where("detector > 100")
    rows, why = sky.query().where("detector.purpose = 'SCIENCE'").datasets("bias", "both").rows_or_reasons()
    assert rows == [] and len(why) == 1 and "detector" in why[0] and "left nothing" in why[0]
    _, why = sky.query().where("instrument = 'cam' AND detector = 1").datasets("bias", []).rows_or_reasons()
    assert "no collection searched holds bias" in why[0]


def test_governor_values_prune_collections(sky):  # noqa: F811
    sky.governor_values = {"two": {"instrument": {"other"}}, "one": {"instrument": {"cam"}}}
    q = sky.query().where("instrument = 'cam'")
    found = q.datasets("bias", "both").frame()
    assert sorted(r["dataset_id"] for r in found.collect()) == [11, 12]
    _, why = q.datasets("bias", "two").rows_or_reasons()
    assert "governor" in why[0]
    assert sky.query().datasets("bias", "both").count() == 3


def test_types_go_in_groups(spark, sky):  # noqa: F811
    for n in ("dark", "sky"):
        rows = sky.types["bias"].frame.withColumn("dataset_id", F.col("dataset_id") + (100 if n == "dark" else 200))
        sky.register(DatasetType(n, ("detector",), rows))
    sky.register(DatasetType("raw", ("visit", "detector"), spark.createDataFrame([("cam", 1, 1, 900, "one", "one")], "instrument string, visit long, detector long, dataset_id long, run string, collection string")))
    names = ["raw", "bias", "dark", "sky", "flat"]
    found = all_datasets(sky, names, ["both"], "detector.purpose = 'SCIENCE'")
    got = {(r["dataset_type"], r["dataset_id"]) for r in found.collect()}
    first = {11, 22, 23}
    assert got == {("bias", i) for i in first} | {("dark", 100 + i) for i in first} | {("sky", 200 + i) for i in first} | {("raw", 900)}
    joins = lambda n: all_datasets(sky, n, ["both"], "detector.purpose = 'SCIENCE'")._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(["bias", "dark", "sky", "flat"]) == joins(["bias"]) < joins(names)  # one join tree for each group
    assert all_datasets(sky, names, [], "").count() == 0 and all_datasets(sky, names, ["both"], limit=2).count() == 2
    own = all_datasets(sky, ["bias"], ["both"], "bias.dataset_id = 11 AND detector < 3")
    assert {r["dataset_id"] for r in own.collect()} == {11}


def test_a_stored_type_is_searched_without_a_shuffle(spark, sky):  # noqa: F811
    c = datasets.stored(sky, "bias", "stored_bias", buckets=4)
    found = c.query().datasets("bias", "both").frame()
    want = sorted(map(tuple, sky.query().datasets("bias", "both").frame().collect()))
    assert sorted(map(tuple, found.collect())) == want
    assert "Exchange" not in plan_of(found)
    one = c.query().datasets("bias", "one").frame()
    assert "PartitionFilters: [isnotnull(collection" in one._jdf.queryExecution().toString() and one.count() == 2
    c = datasets.stored(sky, "flat", "stored_flat", buckets=4)
    assert c.types["flat"].frame.count() == 0 and c.types["flat"].calibrations.count() == 4
    whole = c.query().where("flat.timespan OVERLAPS T'1970-01-01/tai'").datasets("flat", "cal").frame()
    assert {r["detector"]: r["dataset_id"] for r in whole.collect()} == {1: 7, 2: 9}
    assert find_dataset(c, "flat", {"detector": 1}, ["cal"], ts.Timespan(60, 70))["dataset_id"] == 8
    assert find_dataset(c, "flat", {"detector": 1}, ["cal"]) is None
    for n in ("stored_bias", "stored_flat", "stored_flat_calibrations"):
        spark.sql(f"DROP TABLE {n}")


def test_records_of_several_layers(spark, sky):  # noqa: F811
    table = sky.elements["detector"]
    ids = table.select("instrument", "detector").unionByName(table.select("instrument", "detector").limit(1))
    given = spark.createDataFrame([("cam", 1, "given"), ("cam", 1, "also"), ("cam", 9, "unasked")], "instrument string, detector long, purpose string")
    held = spark.createDataFrame([("cam", 1), ("cam", 2)], "instrument string, detector long")
    got = {r["detector"]: r["purpose"] for r in datasets.records_from_layers(sky, "detector", ids, given, held).collect()}
    assert got == {1: "also", 2: None, 3: "SCIENCE", 4: "WAVEFRONT"}
    counter = spark.sparkContext.accumulator(0)
    sky.elements["detector"] = table.where(F.udf(lambda d: counter.add(1) or True, "boolean")("detector"))
    few = datasets.records_from_layers(sky, "detector", ids.where("detector = 2"), held)
    assert few.count() == 1 and counter.value == 0  # the table is not read


def test_leap_seconds_of_columns(spark):
    rows = []
    for year, month, _ in times.LEAP_SECONDS:
        base = int(datetime.datetime(year, month, 1, tzinfo=datetime.UTC).timestamp()) * 10**9
        rows += [(base + d * 500_000_000,) for d in (-5, -2, -1, 0, 1, 4)]
    df = spark.createDataFrame([*rows, (0,), (None,)], "utc long").withColumn("tai", times.tai_of(F.col("utc")))
    for r in df.withColumn("back", times.utc_of(F.col("tai"))).collect():
        if r["utc"] is None:
            assert r["tai"] is None and r["back"] is None
            continue
        assert r["tai"] == r["utc"] + times.tai_offset(r["utc"]) and r["back"] == r["utc"]
        text = (datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=r["utc"] // 1000)).isoformat()
        assert times.parse_time(text) == r["tai"]


def test_ingest_dates_against_literals(spark, sky):  # noqa: F811
    rows = [("cam", 1, 1, "one", datetime.datetime(2016, 12, 31, 23, 59, 59)), ("cam", 2, 2, "one", datetime.datetime(2017, 1, 1)), ("cam", 3, 3, "one", None)]
    frame = spark.createDataFrame(rows, "instrument string, detector long, dataset_id long, collection string, ingest_date timestamp_ntz")
    sky.register(DatasetType("late", ("detector",), frame.withColumn("run", F.lit("one"))))
    ids = lambda text: {r["dataset_id"] for r in sky.query().join_dataset_search("late", "one").where(text).datasets("late", "one").rows()}
    assert ids("late.ingest_date >= T'2017-01-01'") == {2} and ids("late.ingest_date < T'2017-01-01T00:00:37/tai'") == {1}
    assert ids("late.ingest_date = T'2017-01-01T00:00:37/tai'") == {2}


def test_chains_from_a_table(spark):
    links = [("top", "a", 0), ("top", "b", 1), ("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "z", 1)]
    chain = spark.createDataFrame(links, "parent string, child string, position int")
    got = {r["child"]: r["rank"] for r in flattened(spark, chain, "top").collect()}
    assert got == {"a": 0, "y": 1, "x": 2, "b": 3, "z": 4}
    with pytest.raises(PySparkException, match="below itself"):
        flattened(spark, chain.unionByName(spark.createDataFrame([("z", "b", 0)], chain.schema)), "top").collect()
    assert flattened(spark, chain, "z").count() == 0
    many = ordered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7), "v")
    assert all(r["v"] == r["rank"] for r in many.collect())


def test_empty_collections_have_summaries(spark, sky):  # noqa: F811
    sky.collections.register("empty", Kind.RUN)
    table = spark.createDataFrame([("one", ["bias"], ["cam"])], "collection string, dataset_types array<string>, instrument array<string>")
    merged = {r["collection"]: r["dataset_types"] for r in datasets.merged_summaries(table, sky.collections).collect()}
    assert merged["empty"] == [] and merged["both"] == ["bias"] and merged["one"] == ["bias"]
    assert ops.least_of_each(table, ["collection"]).count() == 1
