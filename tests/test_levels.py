"""Joins of spans and regions by levels: every pair once, and few compared; lookups and writes with repeated keys."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from orrery.functions import timespan as ts
from orrery.functions.region import REGION, Region
from orrery.operators import catalog as ops, intervals, spatial

SPAN = "struct<begin: bigint, end: bigint>"
DAY = ts.DAY


def spans(spark, rows, key="k", span="s", id_="a"):
    return spark.createDataFrame(rows, f"{id_} long, {key} long, {span} {SPAN}")


def compared(a, b, keys):
    return intervals.meetings(a, b, keys, "s", "t").count()


def test_days_meet_days_of_their_own(spark):
    r = random.Random(7)
    day = lambda: (lambda d: (d, d + DAY))(DAY * r.randrange(2400))
    a, b = spans(spark, [(i, 0, day()) for i in range(6000)]), spans(spark, [(i, 0, day()) for i in range(1500)], span="t", id_="b")
    found = ops.overlap_join(a, b.drop("k"), [], "s", "t").count()
    want = a.join(b.drop("k"), F.col("s.begin") == F.col("t.begin")).count()
    assert found == want
    assert compared(a, b.drop("k"), []) <= 6 * found + 7500 < 6000 * 1500 / 100


def test_years_meet_days_within_them(spark):
    r = random.Random(8)
    a = spans(spark, [(i, 0, (DAY * d, DAY * d + 1)) for i, d in enumerate(r.choices(range(20_000), k=4000))])
    rows = [(i, 0, (365 * DAY * i, 365 * DAY * (i + 1))) for i in range(50)] + [(90, 0, (0, ts.MAX_NSEC)), (91, 0, (5, 5)), (92, 0, None)]
    b = spans(spark, rows, span="t", id_="b").drop("k")
    found = ops.overlap_join(a, b, [], "s", "t").count()
    assert found >= 4000 and compared(a, b, []) <= 4 * found + 4053


def test_one_key_with_very_many_ranges(spark):
    n = 100_000
    a = spark.range(2 * n).select("id", F.lit(1).cast("long").alias("k"), ts.span(F.col("id") * 500, F.col("id") * 500 + 1).alias("s"))
    b = spark.range(n).select(F.col("id").alias("b"), F.lit(1).cast("long").alias("k"), ts.span(F.col("id") * 1000, F.col("id") * 1000 + 1000).alias("t"))
    found = ops.overlap_join(a, b, ["k"], "s", "t")
    assert found.where(F.col("id") / 2 >= F.col("b")).where("id / 2 < b + 1").count() == found.count() == 2 * n
    assert compared(a, b, ["k"]) <= 6 * n


def test_lookup_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (1, 15), (2, 5), (None, 5)], "k long, t long")
    held = spark.createDataFrame([(1, 7, (0, 10)), (1, 8, (10, 20)), (2, 9, (6, 9))], f"k long, c long, validity {SPAN}")
    got = sorted((r["k"], r["t"], r["c"]) for r in ops.calibration_lookup(rows, held, ["k"], "t").collect())
    assert got == [(1, 5, 7), (1, 5, 7), (1, 15, 8)]
    twice = held.unionByName(held.where("c = 7").withColumn("c", F.lit(70).cast("long")))
    with pytest.raises(PySparkException, match="more than one calibration"):
        ops.calibration_lookup(rows, twice, ["k"], "t").collect()
    assert ops.calibration_lookup(rows, twice, ["k"], "t", check=False).count() == 5
    with pytest.raises(ops.ConflictError):
        ops.certify(held, held.limit(1), ["k"])
    assert ops.certify(held, held.where("k = 2").withColumn("validity", ts.span(F.lit(0), F.lit(6))), ["k"]).count() == 4


def test_writes_keep_a_key_once(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    rows = spark.createDataFrame([(1, "y"), (1, "x"), (None, "m"), (None, "z"), (3, None), (3, "c")], "k long, v string")
    got = lambda df: sorted(((r["k"] or 0, r["v"] or "") for r in df.collect()))
    assert got(ops.replace(table, rows, ["k"])) == [(0, "m"), (1, "x"), (2, "b"), (3, "")]
    assert got(ops.ensure(table, rows, ["k"])) == [(0, "n"), (1, "a"), (2, "b"), (3, "")]
    assert got(ops.update(table, rows, ["k"])) == [(0, "m"), (1, "x"), (2, "b")]
    keys = table.select("k")
    assert ops.replace(keys, rows.select("k"), ["k"]).count() == 4 and ops.ensure(keys, rows.select("k"), ["k"]).count() == 4


def test_regions_meet_once_at_the_level_of_the_larger(spark):
    r, made = random.Random(9), []
    for _ in range(150):
        lon, lat = r.uniform(0, 360), r.choice([r.uniform(-90, 90), r.uniform(84, 90), r.uniform(-3, 3)])
        size = 10 ** r.uniform(-4, 1.2)
        made.append(Region.circle(lon, lat, size))
        made.append(Region("box", (lon, max(-90.0, lat - size), (lon + 3 * size) % 360, min(90.0, lat + size))))
        made.append(Region.point(lon, lat))
    made += [Region.polygon([(0, 0), (9, 1), (8, 9)]), Region("box", (0.0, -90.0, 360.0, 90.0)), Region.circle(0, 90, 4), Region.circle(5, -89, 2)]
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("r", REGION)])
    a = spark.createDataFrame([(i, {"kind": x.kind, "values": list(x.values)}) for i, x in enumerate(made)] + [(999, None)], schema)
    b = a.select(F.col("i").alias("j"), F.col("r").alias("q"))
    got = [(x["i"], x["j"]) for x in spatial.join(a, b, "r", "q").collect()]
    pairs = a.crossJoin(b).where(spatial.overlaps(F.col("r"), F.col("q"))).select("i", "j").collect()
    assert len(got) == len(set(got)) and set(got) == {(x["i"], x["j"]) for x in pairs}
    assert spatial.meetings(a, b, "r", "q", []).count() <= 8 * len(got)


def test_a_crowded_place_is_cut_finely(spark):
    r = random.Random(10)
    rows = [(i, {"kind": "circle", "values": [10 + r.uniform(-0.5, 0.5), 5 + r.uniform(-0.5, 0.5), 1e-4]}) for i in range(4000)]
    a = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.LongType()), T.StructField("r", REGION)]))
    b = a.select(F.col("i").alias("j"), F.col("r").alias("q"))
    assert spatial.meetings(a, b, "r", "q", []).count() < 20_000  # of 16 million in a cell of one degree


def test_points_and_circles_against_polygons(spark):
    r, rows = random.Random(11), []
    for i in range(300):
        lon, lat = r.uniform(0, 360), r.uniform(-70, 70)
        polygon = Region.polygon([(lon + r.uniform(-8, 8), lat + r.uniform(-8, 8)) for _ in range(r.randint(3, 6))])
        other = r.choice([Region.point, lambda x, y: Region.circle(x, y, r.uniform(0.1, 5))])(lon + r.uniform(-12, 12), lat + r.uniform(-12, 12))
        rows.append((i, polygon, other))
    as_row = lambda x: {"kind": x.kind, "values": list(x.values)}
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("p", REGION), T.StructField("o", REGION)])
    df = spark.createDataFrame([(i, as_row(p), as_row(o)) for i, p, o in rows], schema)
    made = df.select("i", spatial.overlaps(F.col("p"), F.col("o")).alias("x"), spatial.overlaps(F.col("o"), F.col("p")).alias("y"))
    assert "_polygons_overlap" in made._jdf.queryExecution().toString()  # for other pairs
    unlike = [x["i"] for x in made.collect() if not x["x"] == x["y"] == rows[x["i"]][1].overlaps(rows[x["i"]][2])]
    assert unlike == []


def test_rows_of_one_span_are_joined_as_blocks(spark, monkeypatch, tmp_path):
    r = random.Random(12)
    times = [(DAY * d, DAY * (d + n)) for d in range(9) for n in (1, 4)] + [(5, 5), None]
    rows = lambda n: [(i % (n - 4), 0, r.choice(times)) for i in range(n)]  # some ids twice
    left, right = rows(90), rows(60)
    a, b = spans(spark, left), spans(spark, right, span="t", id_="b").withColumnRenamed("k", "j")
    live = lambda s: s and s[0] < s[1]
    want = sorted((x[0], y[0]) for x in left for y in right if live(x[2]) and live(y[2]) and x[2][0] < y[2][1] and y[2][0] < x[2][1])
    for sizes, places in (((1024, 256), 8), ((3, 2), 2), ((1, 1), 1)):
        monkeypatch.setattr(intervals, "BLOCKS", sizes)
        monkeypatch.setattr(intervals, "PLACES", places)
        for other in ("t", "s"):
            found = ops.overlap_join(a, b.withColumnRenamed("t", other), [], "s", other)
            assert found.columns == ["a", "k", "s", "b", "j"] + ["t"] * (other == "t")
            assert sorted((x["a"], x["b"]) for x in found.collect()) == want
    monkeypatch.undo()
    day = ts.span(F.lit(0), F.lit(DAY))
    pairs = ops.overlap_join(spark.range(700).select("id", day.alias("s")), spark.range(3001).select(F.col("id").alias("b"), day.alias("t")), [], "s", "t")
    pairs.select("id", "b").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 700 * 3001
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 700 * 3001
