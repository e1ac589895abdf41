"""Upkeep of catalogues, and other shapes of columns."""

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orrery import queries
from orrery.operators import bookkeeping as keep
from orrery.operators.catalog import ConflictError
from orrery.sources import columnar
from tests.test_catalog import SKY

BASE = "/root/testdata/sf0.001"


def test_trash(spark):
    held = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "dataset_id long, path string")
    left, trash = keep.trashed(held, held.limit(0), spark.createDataFrame([(1,), (3,)], "dataset_id long"))
    assert {r[0] for r in left.collect()} == {2, 4} and {r["path"] for r in trash.collect()} == {"a", "b"}
    assert {r["path"] for r in keep.removable(left, trash).collect()} == {"b"}


def test_acceptance(spark):
    df = spark.createDataFrame([("raw", "Image"), ("cat", "Table"), ("log", "Text"), ("raw2", None)], "t string, s string")
    let = lambda **rules: {r["t"] for r in df.where(keep.accepted([F.col("t"), F.col("s")], **rules)).collect()}
    assert let() == {"raw", "cat", "log", "raw2"}
    assert let(accept=["raw", "Table"]) == {"raw", "cat"}
    assert let(reject=["Text", "raw"]) == {"cat", "raw2"}
    assert let(accept=["raw"], reject=["all"]) == {"raw"} and let(accept=["all"], reject=["Image"]) == {"cat", "log", "raw2"}
    assert let(accept=["raw"], reject=["Image"]) == {"raw"}
    with pytest.raises(ValueError):
        let(accept=["all"], reject=["all"])


def test_provenance(spark):
    refs = spark.createDataFrame([("d1", "out", "run1", 7), ("d2", "out", "run1", 8)], "dataset_id string, dataset_type string, run string, visit long")
    schema = "dataset_id string, position int, input_id string, input_run string, input_type string, extra map<string, string>"
    inputs = spark.createDataFrame([("d1", 0, "i0", "r0", "raw", {"x": "1"}), ("d1", 1, "i1", "r0", "raw", None)], schema)
    flat = keep.provenance(refs, inputs, "obs", ".", ["visit"])
    got = {r["dataset_id"]: r["provenance"] for r in flat.collect()}
    assert got["d2"] == {"obs.id": "d2", "obs.run": "run1", "obs.datasettype": "out", "obs.dataid.visit": "8"}
    assert got["d1"]["obs.input.0.x"] == "1" and got["d1"]["obs.input.1.id"] == "i1" and len(got["d1"]) == 11
    upper = keep.provenance(refs, inputs, "P", ".", ["visit"], most=1)
    assert {k for r in upper.collect() for k in r["provenance"]} == {"P.ID", "P.RUN", "P.DATASETTYPE", "P.DATAID.VISIT"}
    parts = {(r["dataset_id"], r["input"], r["key"]): r["value"] for r in keep.provenance_parts(flat, "obs").collect()}
    assert parts["d1", 0, "x"] == "1" and parts["d1", None, "dataid.visit"] == "7" and parts["d1", 1, "run"] == "r0"
    bad = spark.createDataFrame([("d1", 0, "i", "r", "t", {"Run": "1"})], schema)
    with pytest.raises(PySparkException, match="reserved"):
        keep.provenance(refs, bad).collect()


def test_ingest_of_files(spark, tmp_path):
    for v in (1, 22):
        (tmp_path / f"raw_{v}_cam.fits").write_bytes(b"x" * v)
    (tmp_path / "other.txt").write_text("no")
    got = {r["visit"]: r for r in keep.ingested(spark, str(tmp_path), r"raw_(\d+)_(\w+)\.fits$", {"visit": "long", "instrument": "string"}, True).collect()}
    assert set(got) == {1, 22} and got[22]["size"] == 22 and got[1]["instrument"] == "cam" and len(got[1]["checksum"]) == 64
    assert columnar.checksums(spark, str(tmp_path)).count() == 3


def test_chains_refs_and_coordinates(spark):
    chain = spark.createDataFrame([("p", "a", 3), ("p", "b", -1), ("q", "a", 0)], "parent string, child string, position int")
    assert {r[0]: (r[1], r[2]) for r in keep.chain_ends(chain).collect()} == {"p": (-1, 3), "q": (0, 0)}
    refs = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "dataset_type string, dataset_id long")
    assert {n: df.count() for n, df in keep.by_type(refs).items()} == {"x": 2, "y": 1}
    assert keep.coordinate_union({"a": 1}, {"b": 2, "a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ConflictError):
        keep.coordinate_union({"a": 1}, {"a": 2})
    c = queries.catalog(spark, BASE)
    got = keep.expanded(c, {"order": c.elements["order"].first()["order"]})
    assert set(got) == {"region", "nation", "customer", "order"}
    with pytest.raises(LookupError):
        keep.expanded(c, {"order": -1})


def test_observation_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert keep.observations(t, ["k"], v=None).collect()[0]["k"] == 2 and keep.observations(t, v="a").count() == 1
    assert keep.migrated(t, {"v": "w", "k": None}, {"z": 1}).columns == ["w", "z"]


def test_pandas_and_two_levels(spark):
    frame = pd.DataFrame({"a": [1, 2], "s": ["x", None]}, index=pd.Index([5, 6], name="k"))
    df = columnar.from_pandas(spark, frame)
    assert df.columns == ["k", "a", "s"] and columnar.to_pandas(df, "k").loc[6, "a"] == 2
    wide = pd.DataFrame({("g", "x"): [1, 2], ("g", "y"): [3, 4], ("r", "x"): [5, 6]})
    nested = columnar.from_pandas(spark, wide)
    assert nested.columns == ["g", "r"] and columnar.to_pandas(nested, multi=True).equals(wide)
    assert columnar.two_level(nested, [("g", "y")]).schema.simpleString() == "struct<g:struct<y:bigint>>"
    assert columnar.two_level(nested, {1: "x"}).schema.simpleString() == "struct<g:struct<x:bigint>,r:struct<x:bigint>>"
    with pytest.raises(LookupError):
        columnar.two_level(nested, {0: ["z"]})
    assert "".join(columnar.json_lines(df.orderBy("k"), 1)).splitlines()[0] == '{"k":5,"a":1,"s":"x"}'


def test_record_schemas(spark, tmp_path):
    schema = columnar.record_schema(SKY, "visit")
    assert [f.name for f in schema] == ["instrument", "visit", "exposure_time", "region", "timespan"] and not schema["visit"].nullable
    arrow = columnar.record_arrow_schema(SKY, "visit")
    assert arrow.metadata[b"element"] == b"visit" and arrow.names == schema.names
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert columnar.read_csv(spark, str(tmp_path / "t.csv"), "a long, b string").first()["b"] == "x"
