"""Steps whose cost must not outgrow their input: joins, chains and results of large tables, on small ones."""

import re

from pyspark.sql import functions as F

from orrery import queries, queries_results
from orrery.functions import region as rg, timespan as ts
from orrery.operators import catalog as ops, intervals, spatial
from orrery.plans.collections import flattened
from tests.test_planner import BASE, plan_of


def test_rows_dealt_to_cells_are_never_broadcast(spark):
    row = F.struct(F.col("id").alias("begin"), (F.col("id") + 10).alias("end"))
    a, b = spark.range(50).select("id", row.alias("s")), spark.range(50).select(F.col("id").alias("b"), row.alias("t"))
    pairs = intervals.meetings(a, b, [], "s", "t")
    assert pairs.count() and "BroadcastExchange" not in plan_of(pairs)


def test_chains_longer_than_a_recursive_query_may_be(spark):
    chain = spark.createDataFrame([("top", f"c{k}", k) for k in range(40)] + [(f"c{k}", "d", k) for k in range(40)], "parent string, child string, position int")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "30")
    try:
        got = {r["child"]: r["rank"] for r in flattened(spark, chain, "top").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == {"c0": 0, "d": 1} | {f"c{k}": k + 1 for k in range(1, 40)}


def test_pairs_of_unique_rows_are_not_made_distinct(spark):
    pairs = queries.temporal_join_planned(spark, BASE)
    assert pairs.count() and "keys=[order" not in plan_of(pairs)
    assert "Aggregate" in plan_of(queries.dataset_existence(spark, BASE))  # a part has several suppliers' datasets


def test_a_table_that_only_has_to_exist_repeats_nothing(spark):
    found = queries.find_first_fan_out(spark, BASE)
    want = found.select("part", "supplier").distinct().count()
    assert found.count() == want and "min(struct" not in plan_of(found)  # no first of repeated rows is looked for


def test_pairs_of_few_keys_are_many_tasks_work(spark):
    pairs = queries.natural_join_customer_supplier(spark, BASE.replace("sf0.001", "sf0.01"))
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 8


def test_datasets_are_dealt_to_more_tasks_as_there_are_more(spark, monkeypatch):
    few = queries.shipments(spark, BASE).rdd.getNumPartitions()
    monkeypatch.setattr(queries, "EACH", 100)
    many = queries.shipments(spark, BASE)
    assert few == 4 and many.rdd.getNumPartitions() == 60 and many.count() == queries.shipments(spark, BASE).count()


def test_pairs_of_boxes_never_pass_through_python(spark):
    for name in ("spatial_join_written", "spatial_join_boxes", "projected_overlap_any"):
        assert "ArrowEvalPython" not in plan_of(queries.QUERIES[name](spark, BASE))


def test_regions_of_all_kinds_are_joined_and_matched(spark):
    made = [rg.Region.point(10, 10), rg.Region.circle(11, 10, 2), rg.Region.box(10, 10, 3, 2), rg.Region.box(40, 89.9, 20, 0.2), rg.Region.circle(200, 89.5, 1),
            rg.Region.polygon([(9, 9), (12, 9), (12, 12)]), rg.Region.polygon([(11, 8), (14, 8), (12, 11)]), rg.Region.box(359.9, 0, 1, 1), rg.Region.point(0.2, 0.1)]
    a = spark.createDataFrame([(i, (r.kind, list(r.values))) for i, r in enumerate(made)], "a long, ra struct<kind: string, values: array<double>>")
    b = a.select(F.col("a").alias("b"), F.col("ra").alias("rb"))
    want = {(i, j) for i, x in enumerate(made) for j, y in enumerate(made) if x.overlaps(y)}
    got = [tuple(r) for r in spatial.join(a, b, "ra", "rb").select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    less = {tuple(r)[0] for r in spatial.matched(a, b, "ra", "rb", F.col("a") < F.col("b")).select("a").collect()}
    assert less == {i for i, j in want if i < j}


def test_instants_go_to_few_levels_of_ranges(spark):
    day = ts.DAY
    days = [0, 1, 3, 7, 20, 60, 200, 700, 3000, 9000]  # ranges of all lengths, the last of which is unbounded
    begins = spark.createDataFrame([(1, d * day, d) for d in days], "k int, begin long, tie long")
    ranges = ops.validity_ranges(begins, ["k"], "begin", "tie").select("k", "tie", "validity")
    at = [0, 1, 2, 6, 7, 59, 60, 699, 8999, 9000, 20000]
    rows = spark.createDataFrame([(1, d * day) for d in at], "k int, t long")
    got = {r["t"] // day: r["tie"] for r in ops.calibration_lookup(rows, ranges, ["k"], "t").collect()}
    assert got == {d: max(x for x in days if x <= d) for d in at}
    levels = lambda step: ranges.select(intervals.own_level(F.col("validity"), step)).distinct().count()
    assert levels(4) <= 5 < levels(1)


def test_results_of_large_tables_are_dealt_to_more_tasks_as_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(queries, "EACH", 100)
    for name in ("associations_query", "refs_by_id", "where_ingest_date", "find_first_stored"):
        assert queries_results.QUERIES[name](spark, BASE).rdd.getNumPartitions() >= 60, name


def test_times_of_a_condition_are_computed_once(spark):
    assert plan_of(queries_results.QUERIES["where_ingest_date"](spark, BASE)).count("secondwithfraction") <= 4


def _looked_up(spark, monkeypatch, name):
    """The rows of a query whose element tables are too large to broadcast, those without any change, and the tasks of its joins by part."""
    want = sorted(map(tuple, queries_results.QUERIES[name](spark, BASE).collect()))
    monkeypatch.setattr(queries, "EACH", 100)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries_results.QUERIES[name](spark, BASE)
        return sorted(map(tuple, found.collect())), want, {int(n) for n in re.findall(r"hashpartitioning\(part#\d+L?, (\d+)\)", plan_of(found))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_records_of_many_datasets_are_looked_up_by_many_tasks(spark, monkeypatch):
    got, want, tasks = _looked_up(spark, monkeypatch, "datasets_with_records")
    assert got == want and tasks == {60}


def test_a_condition_on_a_large_table_is_tested_by_many_tasks(spark, monkeypatch):
    got, want, tasks = _looked_up(spark, monkeypatch, "find_first_where_limit")
    assert got == want and tasks == {60}


def test_ids_beyond_64_bits_are_held(spark, tmp_path):
    far = 50_000_000
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{BASE}/{name}.parquet").withColumn(key, F.col(key) + far).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.calib_lookup_shipments(spark, str(tmp_path)).collect()
    want = queries.calib_lookup_shipments(spark, BASE).collect()
    moved = sorted((r["dataset_id"] + far * 800_000_000_000, r["o_custkey"], r["t"], r["o_orderkey"] + far) for r in want)
    assert sorted((int(r["dataset_id"]), r["o_custkey"], r["t"], r["o_orderkey"]) for r in got) == moved
    assert max(moved)[0] > 2**63 and dict(queries.calib_lookup_shipments(spark, BASE).dtypes)["dataset_id"] == "bigint"
    assert queries.shipments(spark, str(tmp_path)).agg(F.max("dataset_id")).first()[0] > 2**63


def test_rows_of_few_ranges_are_looked_up_by_key_alone(spark, monkeypatch):
    ranges = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("begin"), "id").unionByName(
        spark.range(200).select(F.lit(7).cast("long").alias("k"), (F.col("id") * 10).alias("begin"), "id")
    )
    ranges = ops.validity_ranges(ranges.where("k <> 1 OR id < 30"), ["k"], "begin", "id").select("k", "id", "validity")
    rows = spark.range(2000).select(F.when(F.col("id") % 4 < 3, F.col("id") % 4).otherwise(7).alias("k"), (F.col("id") * 2).alias("t"))
    rows = rows.unionByName(rows.where("t < 100")).unionByName(spark.createDataFrame([(None, 5), (1, None)], "k long, t long"))
    looked_up = lambda: sorted((r["k"], r["t"], r["id"]) for r in ops.calibration_lookup(rows, ranges, ["k"], "t").collect())
    got = looked_up()  # keys 0, 2 and 7 by time, 1 by key
    assert got == sorted((r["k"], r["t"], r["id"]) for r in rows.join(ranges, "k").where("validity.begin <= t AND validity.end > t").collect())
    for few, busy in ((1000, 10**6), (0, 10**6), (1000, 0)):
        monkeypatch.setattr(ops, "FEW", few)
        monkeypatch.setattr(ops, "BUSY", busy)
        assert looked_up() == got
    monkeypatch.undo()
    few = queries.calib_lookup_shipments(spark, BASE)
    assert few.collect() and "_level" not in plan_of(few).split("== Initial Plan ==")[0]  # no row goes to cells
