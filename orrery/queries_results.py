"""Further queries over the test tables: results in their shapes, sets of data IDs and records, validity writes, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import timespan as ts
from orrery.operators import bookkeeping, catalog as ops, datasets, obscore, transfer
from orrery.plans import expressions as ex
from orrery.plans.query import Catalog
from orrery.plans.universe import Element, Universe
from orrery.queries import CHAINS_SQL, DAY, RANGES_SQL, SHIPPED_SQL, catalog, nsec, query, shipments, table, terms
from orrery.queries_more import ORACLES, QUERIES, shared_folder
from orrery.sources import columnar

__all__ = ["ORACLES", "QUERIES"]

FIRST_SQL = f"""SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL})
QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY CASE run WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1"""


@query("""SELECT p_partkey AS part, p_brand AS brand, p_retailprice::DOUBLE AS price FROM part WHERE p_size > 20 AND p_retailprice > 950""")
def materialized_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over data IDs that were computed once, with a further condition."""
    kept = catalog(spark, sf_dir).query().where("part.size > 20").materialize(["part"])
    found = kept.where("part.retailprice > 950.0").general(["part"], dimension_fields={"part": ["retailprice"]})
    return found.frame().select("part", "brand", F.col("part__retailprice").cast("double").alias("price"))


@query(f"SELECT DISTINCT part, supplier FROM ({SHIPPED_SQL}) JOIN part ON p_partkey = part WHERE p_size < 10 AND run IN ('R', 'N')")
def data_ids_of_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data IDs alone of a dataset query, with a condition that comes after it."""
    found = catalog(spark, sf_dir).query().datasets("shipment", ["R", "N"], find_first=False)
    return found.where("part.size < 10").data_ids().frame().select("part", "supplier")


@query(f"""SELECT f.part, f.supplier, f.dataset_id, p_name AS part_name, s_name AS supplier_name, n_name AS nation_name FROM ({FIRST_SQL}) f
JOIN part ON p_partkey = part JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000""")
def datasets_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets with the records of their data IDs, implied ones too."""
    found = catalog(spark, sf_dir).query().where("supplier.acctbal > 5000.0").datasets("shipment", "all").with_dimension_records()
    names = {"part__name": "part_name", "supplier__name": "supplier_name", "nation__name": "nation_name"}
    return found.frame().select("part", "supplier", "dataset_id", *(F.col(c).alias(n) for c, n in names.items()))


@query(f"SELECT part, supplier, dataset_id, run FROM ({FIRST_SQL}) JOIN supplier ON s_suppkey = supplier WHERE s_acctbal < 0")
def datasets_of_data_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dataset of each data ID of another query's result."""
    ids = catalog(spark, sf_dir).query().join_dataset_search("shipment", "all").where("supplier.acctbal < 0.0").data_ids(["part", "supplier"])
    return ids.find_datasets("shipment", "all").frame().select("part", "supplier", "dataset_id", "run")


@query("""SELECT o_orderkey AS "order", o_totalprice > 200000 AS dear FROM orders WHERE o_totalprice > 200000 AND NOT (o_orderstatus = 'F')""")
def where_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of booleans as conditions."""
    u = Universe([Element("order", "o", metadata={"dear": "bool", "closed": "bool"})])
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("order"), (F.col("o_totalprice") > 200000).alias("dear"), (F.col("o_orderstatus") == "F").alias("closed"))
    found = Catalog(u, {"order": rows}).query().where("order.dear AND NOT order.closed")
    return found.general(["order"], dimension_fields={"order": ["dear"]}).frame().select("order", F.col("order__dear").alias("dear"))


@query("""SELECT p_partkey AS part, p_brand AS brand FROM part WHERE (p_size = 1 OR p_size = 5 OR p_size = 9) AND NOT (p_type LIKE 'PROMO%') AND p_retailprice > 950""")
def where_many_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates made in Python: any of several, and all of several."""
    q = catalog(spark, sf_dir).query().join_dimensions("part")
    sizes = ex.any_of(*(ex.compare("=", q.x("part.size"), ex.as_value(k)) for k in (1, 5, 9)))
    plain = ex.not_(ex.predicate("GLOB(part.type, 'PROMO*')", q.resolver()))
    dear = ex.compare(">", q.x("part.retailprice"), ex.as_value(950.0))
    return q.where(ex.all_of(sizes, plain, dear)).data_ids(["part"]).frame()


@query("""SELECT o_orderkey AS "order" FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1996-03-01'""")
def where_timespan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of a timespan, and overlap with a literal one, in predicates made in Python."""
    q = catalog(spark, sf_dir).query().join_dimensions("order")
    span = q.x("order.timespan")
    low = ts.Timespan.day_obs(19950301).begin
    window = ts.Timespan(low, ts.Timespan.day_obs(19960301).begin)
    begun = ex.compare(">=", span.begin, ex.as_value(ex.Time(low)))
    return q.where(begun & ex.overlap(span, ex.as_value(window))).data_ids(["order"]).frame().select("order")


# ---------------------------------------------------------------- sets


@query("""SELECT s_suppkey AS supplier, s_name AS name FROM supplier WHERE s_acctbal > 3000 AND s_suppkey % 2 = 0""")
def record_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).elements["supplier"]
    return datasets.record_intersection(rows.where("acctbal > 3000"), rows.where("supplier % 2 = 0"), ["supplier"]).select("supplier", "name")


@query("""SELECT s_suppkey AS supplier, s_name AS name FROM supplier WHERE s_acctbal > 3000 AND s_suppkey % 2 <> 0""")
def record_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).elements["supplier"]
    return datasets.record_difference(rows.where("acctbal > 3000"), rows.where("supplier % 2 = 0"), ["supplier"]).select("supplier", "name")


@query(f"""SELECT n_nationkey AS nation, n_name AS name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM ({SHIPPED_SQL}) JOIN supplier ON s_suppkey = supplier WHERE run = 'R' AND part % 50 = 0)""")
def records_of_data_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that data IDs need, of a dimension that they imply."""
    ids = shipments(spark, sf_dir).where("run = 'R' AND part % 50 = 0").select("part", "supplier")
    return datasets.records_of(catalog(spark, sf_dir), ids)["nation"].select("nation", "name")


@query("""SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_acctbal > 9000""")
def data_id_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data IDs of some dimensions of others."""
    c = catalog(spark, sf_dir)
    ids = c.query().where("supplier.acctbal > 9000.0").data_ids(["supplier"]).frame()
    return transfer.subset(c, ids, ["nation"]).select("nation")


@query(f"""WITH s AS ({SHIPPED_SQL}), r AS (SELECT DISTINCT part, supplier FROM s WHERE run = 'R'), n AS (SELECT DISTINCT part, supplier FROM s WHERE run = 'N')
SELECT NOT EXISTS (SELECT * FROM r EXCEPT SELECT * FROM n) AS within, NOT EXISTS (SELECT * FROM r INTERSECT SELECT * FROM n) AS apart, true AS own""")
def data_id_set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the data IDs of one run are among another's, or apart from them, or among all."""
    s = shipments(spark, sf_dir)
    r, n = (s.where(F.col("run") == run).select("part", "supplier") for run in "RN")
    told = (ops.issubset(r, n), ops.isdisjoint(r, n), ops.issubset(r, s.select("part", "supplier")))
    return spark.createDataFrame([told], "within boolean, apart boolean, own boolean")


# ---------------------------------------------------------------- catalogues


@query(f"SELECT dataset_id::VARCHAR AS dataset_id, 'shipment' AS dataset_type FROM ({SHIPPED_SQL}) WHERE run = 'A' UNION ALL SELECT o_orderkey::VARCHAR, 'invoice' FROM orders")
def ids_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.ids_of_run(catalog(spark, sf_dir), "A")


@query(f"""SELECT o_custkey AS customer, o_orderkey AS dataset_id, begin, "end" FROM ({RANGES_SQL})""")
def certified_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity ranges certified beside those that are there: none of a data ID overlap."""
    rows = terms(spark, sf_dir).select("customer", "dataset_id", "timespan")
    made = ops.certify(rows.where("dataset_id % 2 = 0"), rows.where("dataset_id % 2 <> 0"), ["customer"], "timespan")
    return made.select("customer", "dataset_id", "timespan.begin", "timespan.end")


@query(f"WITH c AS ({CHAINS_SQL}) SELECT parent, min(position) AS first, max(position) AS last FROM c GROUP BY 1")
def chain_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last place of each chain of nations' customers and regions' nations."""
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    link = lambda df, parent, child, at: df.select(parent.alias("parent"), F.col(child).alias("child"), at.cast("int").alias("position"))
    placed = n.join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))  # tables of fixed size
    mine = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    others = mine.where("c_acctbal > 9000").join(F.broadcast(r), F.col("r_regionkey") != F.col("n_regionkey"))
    links = link(r, F.lit("top"), "r_name", F.col("r_regionkey")).unionByName(link(placed, F.col("r_name"), "n_name", F.col("n_nationkey")))
    links = links.unionByName(link(mine, F.col("n_name"), "c_name", F.col("c_custkey")))
    links = links.unionByName(link(others, F.col("r_name"), "c_name", F.col("c_custkey") + 1000))
    return bookkeeping.chain_ends(links)


@query("""SELECT l_suppkey::VARCHAR AS dataset_type, list_sort(list(DISTINCT l_returnflag))[1] AS first, count(DISTINCT l_returnflag)::BIGINT AS n FROM lineitem GROUP BY 1""")
def collections_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of collections turned round: the collections of each type."""
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("collection"), F.col("l_suppkey").cast("string").alias("dataset_type"))
    found = datasets.collections_by_type(ops.summaries(tags, []))
    return found.select("dataset_type", F.col("collections")[0].alias("first"), F.size("collections").cast("long").alias("n"))


@query(f"""SELECT dataset_type, count(*)::BIGINT AS n FROM (SELECT 'shipment' AS dataset_type FROM ({SHIPPED_SQL}) WHERE part % 7 = 0
UNION ALL SELECT 'invoice' FROM orders WHERE o_totalprice < 100000) GROUP BY 1""")
def refs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of several types, taken apart by type and counted."""
    refs = shipments(spark, sf_dir).where("part % 7 = 0").select(F.lit("shipment").alias("dataset_type"), "dataset_id")
    cheap = table(spark, sf_dir, "orders").where("o_totalprice < 100000")
    refs = refs.unionByName(cheap.select(F.lit("invoice").alias("dataset_type"), F.col("o_orderkey").alias("dataset_id")))
    counted = [df.groupBy("dataset_type").agg(F.count("*").alias("n")) for df in bookkeeping.by_type(refs).values()]
    return counted[0].unionByName(counted[1])


@query("""SELECT o_orderkey AS dataset_id, o_orderpriority AS priority FROM orders WHERE o_orderpriority = '1-URGENT'""")
def observations_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an observation table by the values of its columns."""
    config = obscore.Config("test", {"invoice": obscore.TypeConfig("table")}, extra={"priority": "order__priority"})
    rows = obscore.table(catalog(spark, sf_dir), config)
    return bookkeeping.observations(rows, ["dataset_id", "priority"], priority="1-URGENT", dataset_type="invoice")


@query(f"""WITH s AS ({SHIPPED_SQL}) SELECT part, supplier, dataset_id FROM s WHERE run = 'R' AND part % 11 = 0""")
def opaque_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table of locations by run and by the beginning of their paths."""
    path = F.concat(F.lit("mod"), (F.col("part") % 11).cast("string"), F.lit("/"), F.col("dataset_id").cast("string"))
    rows = shipments(spark, sf_dir).withColumn("path", path)
    return transfer.fetch(rows, run=["R"], path="mod0/*").select("part", "supplier", "dataset_id")


# ---------------------------------------------------------------- payloads


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and read with their schema."""
    rows, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), shared_folder(spark, "json")
    columnar.write_json(rows, path)
    return columnar.read_json(spark, path, rows.schema)


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_double FROM lineitem""")
def parquet_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as Parquet in row groups of some bytes, and some columns read."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_double", F.col("l_quantity") * 2)
    path = shared_folder(spark, "parquet")
    columnar.write(rows, path, row_group_bytes=1 << 20)
    return columnar.read(spark, path, columns=["l_order*", "l_linen*", "l_double"])


@query("""SELECT o_custkey AS customer, min(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000) AS begin,
max(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000) + 2592000000000000 AS "end" FROM orders GROUP BY 1""")
def timespans_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What spans of a group cover from the first to the last."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), ts.span(nsec("o_orderdate"), nsec("o_orderdate") + 30 * DAY).alias("s"))
    return o.groupBy("customer").agg(F.min("s.begin").alias("begin"), F.max("s.end").alias("end"))
