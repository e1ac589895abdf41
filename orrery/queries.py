"""Queries over the test tables through the catalogue, each beside DuckDB SQL with the same result.

The overlay: region (governor) <- nation <- customer, supplier; part -> brand;
order -> customer, with a timespan of 30 days; lineitem rows are datasets of
type shipment for (part, supplier), in the run named by their return flag.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import region as rg, timespan as ts
from orrery.functions.glob import glob
from orrery.operators import catalog as ops, datasets, spatial
from orrery.plans.collections import Collections, Kind, flattened
from orrery.plans.query import Catalog, DatasetType, all_datasets, extents
from orrery.plans.universe import Element, Universe
from orrery.sources import columnar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = ts.DAY


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


UNIVERSE = Universe(
    [
        Element("region", "r_name", "string", governor=True),
        Element("nation", "n_nationkey", implied=("region",), metadata={"name": "string"}),
        Element("customer", "c_custkey", implied=("nation",), metadata={"name": "string", "acctbal": "float", "mktsegment": "string"}),
        Element("supplier", "s_suppkey", implied=("nation",), metadata={"name": "string", "acctbal": "float"}),
        Element("brand", "p_brand", "string", union_of="part"),
        Element("part", "p_partkey", implied=("brand",), metadata={"name": "string", "type": "string", "size": "int", "retailprice": "float"}),
        Element(
            "order", "o_orderkey", implied=("customer",), temporal="orders",
            metadata={"status": "string", "totalprice": "float", "priority": "string"},
        ),
    ],
    {"temporal": {"orders": ("order",)}},
)



@functools.lru_cache
def _id_kind(spark: SparkSession, path: str) -> str:
    """bigint, as in SQL. Where an id of the table doesn't fit, so that SQL fails, a decimal that holds it."""
    line = F.col("l_orderkey").cast("double") * 8 + F.col("l_linenumber")
    about = F.abs((line * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey"))
    largest = spark.read.parquet(path).agg(F.max(about)).first()[0]
    return "bigint" if (largest or 0) < 2.0**63 - 2**13 else "decimal(38,0)"  # but for rounding


def dataset_id(spark: SparkSession, sf_dir: str):
    kind = _id_kind(spark, f"{sf_dir}/lineitem.parquet")
    line = F.col("l_orderkey").cast(kind) * 8 + F.col("l_linenumber")
    return ((line * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")).cast(kind).alias("dataset_id")


ID_SQL = "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"
SHIPPED_SQL = f"""SELECT l_partkey AS part, l_suppkey AS supplier, l_returnflag AS run, max({ID_SQL})::BIGINT AS dataset_id
  FROM lineitem GROUP BY ALL"""


def nsec(column: str):
    """Nanoseconds of a column of midnights."""
    return F.unix_date(F.to_date(column)).cast("long") * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task has of a table that is dealt out.
EACH = 500_000


@functools.lru_cache
def _rows_in(spark: SparkSession, path: str) -> int:
    """The rows of a table, from the footers of its files; only what is dealt out by it depends on it."""
    return spark.read.parquet(path).count()


def shares(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many partitions a table is dealt to: as many as it needs, and no fewer than are set."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_rows_in(spark, f"{sf_dir}/{name}.parquet") // EACH))


def dealt(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Rows as many as a table's, dealt by keys to as many partitions as it needs, if these are more than are set."""
    n = shares(spark, sf_dir, name)
    return df.repartition(n, *keys) if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset for each part, supplier and run: that of the largest id."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("run"), dataset_id(spark, sf_dir)
    )
    # dealt by the data ID, which has hardly more rows than this aggregation: a find-first after it needs no other shuffle
    lines = lines.repartition(shares(spark, sf_dir, "lineitem"), "part", "supplier")
    once = lines.groupBy("part", "supplier", "run").agg(F.max("dataset_id").alias("dataset_id"))
    return once.withColumn("collection", F.col("run"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = lambda name: table(spark, sf_dir, name)
    region = t("region").select(F.col("r_regionkey").alias("_r"), F.col("r_name").alias("region"))
    nations = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("_r"))  # tables of fixed size
    order = t("orders")
    elements = {
        "region": region.select("region"),
        "nation": nations.select(F.col("n_nationkey").alias("nation"), "region", F.col("n_name").alias("name")),
        "customer": t("customer").select(
            F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"),
        ),
        "supplier": t("supplier").select(
            F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal")
        ),
        "part": t("part").select(
            F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
            F.col("p_size").alias("size"), F.col("p_retailprice").alias("retailprice"),
        ),
        "order": order.select(
            F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("totalprice"), F.col("o_orderpriority").alias("priority"),
            ts.span(nsec("o_orderdate"), nsec("o_orderdate") + 30 * DAY).alias("timespan"),
        ),
    }
    names = Collections()
    for run in ("A", "N", "R"):
        names.register(run, Kind.RUN)
    names.register("all", Kind.CHAINED)
    names.redefine("all", ["R", "A", "N"])
    tasks = {"part": "lineitem", "supplier": "lineitem", "customer": "orders"}  # the largest table that looks up each
    large = [k for k in tasks if _rows_in(spark, f"{sf_dir}/{k}.parquet") > EACH]  # others are broadcast
    tasks = {k: n for k in large if (n := shares(spark, sf_dir, tasks[k])) > int(spark.conf.get("spark.sql.shuffle.partitions"))}
    out = Catalog(UNIVERSE, elements, collections=names, tasks=tasks)
    out.register(DatasetType("shipment", ("part", "supplier"), shipments(spark, sf_dir)))
    out.register(
        DatasetType("invoice", ("order",), order.select(F.col("o_orderkey").alias("order"), F.col("o_orderkey").alias("dataset_id"), F.lit("A").alias("run"), F.lit("A").alias("collection")))
    )
    return out


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations of customers: each order's id, valid from its day to that of the customer's next."""
    ranges = _ranges(spark, sf_dir)
    return ranges.select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("dataset_id"), F.lit("calib").alias("collection"),
        F.lit("A").alias("run"), F.col("validity").alias("timespan"),
    )


def calibrated(spark: SparkSession, sf_dir: str) -> Catalog:
    out = catalog(spark, sf_dir)
    out.collections.register("calib", Kind.CALIBRATION)
    out.register(DatasetType("terms", ("customer",), terms(spark, sf_dir), is_calibration=True))
    return out


# ---------------------------------------------------------------- find-first and projections


@query(f"""SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL})
QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY CASE run WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1""")
def find_first_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a find-first search of a chain of runs."""
    return catalog(spark, sf_dir).query().datasets("shipment", "all").frame()


@query(f"""SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL}) s JOIN part ON p_partkey = part
WHERE p_size BETWEEN 1 AND 20 AND p_retailprice > 930
QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY CASE run WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1
ORDER BY part DESC, supplier LIMIT 500""")
def find_first_where_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().where("part.size IN (1..20) AND part.retailprice > 930")
    return q.datasets("shipment", "all").order_by("-part", "supplier").limit(500).frame()


@query("SELECT DISTINCT r_name AS region, n_nationkey AS nation FROM nation JOIN region ON n_regionkey = r_regionkey")
def data_ids_nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().data_ids(["nation"]).frame()


@query("SELECT DISTINCT p_brand AS brand FROM part")
def implied_union_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().data_ids(["brand"]).frame()


@query("""SELECT r_name AS region, c_nationkey AS nation, c_custkey AS customer, c_name AS customer__name, c_acctbal AS customer__acctbal,
c_mktsegment AS customer__mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)""")
def records_customer_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_dimensions("order").where("order.totalprice > 100000")
    return q.dimension_records("customer").frame()


@query(f"SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL})")
def general_shipments_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query()
    return q.general(["part", "supplier"], dataset_fields={"shipment": ["dataset_id", "run"]}, collections={"shipment": ["all"]}, find_first=False).frame().select("part", "supplier", "dataset_id", "run")


@query("""SELECT p_partkey AS part, p_brand AS brand, p_name AS part__name, p_size AS part__size FROM part WHERE p_size > 40""")
def general_part_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().where("size > 40")
    return q.general(["part"], {"part": ["name", "size"]}).frame()


@query("""SELECT l_partkey AS part, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE l_returnflag = 'R' GROUP BY ALL""")
def dataset_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().join_dataset_search("shipment", "R").data_ids(["part"]).frame()


@query("""SELECT n_nationkey AS nation, c_custkey AS customer, s_suppkey AS supplier, r_name AS region
FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE c_acctbal > 9000""")
def natural_join_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().where("customer.acctbal > 9000").data_ids(["customer", "supplier"]).frame()


@query("""SELECT o_orderkey AS "order", o_custkey AS customer, c_nationkey AS nation, r_name AS region FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_totalprice > 300000""")
def expand_data_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.expand(c.elements["order"].where("totalprice > 300000").select("order"))


# ---------------------------------------------------------------- predicates


def _parts(spark: SparkSession, sf_dir: str, text: str, **bind: object) -> DataFrame:
    return catalog(spark, sf_dir).query().where(text, bind=bind).data_ids(["part"]).frame()


PART_SQL = "SELECT p_partkey AS part, p_brand AS brand FROM part WHERE "


@query(PART_SQL + "p_size BETWEEN 1 AND 50 AND p_size % 5 = 1")
def where_in_range_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "part.size IN (1..50:5)")


@query(PART_SQL + "p_type LIKE 'PRO%'")
def where_glob_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "GLOB(part.type, 'PRO*')")


@query(PART_SQL + "p_name LIKE '_m%i%'")
def where_glob_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "GLOB(part.name, '?m*i*')")


@query(PART_SQL + "NOT (p_size < 10 OR p_retailprice > 980 AND p_type = 'ECONOMY') OR p_partkey IN (1, 2, 3)")
def where_not_or_cnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "NOT (size < 10 OR retailprice > 980 AND part.type = 'ECONOMY') OR part IN (1, 2, 3)")


@query(PART_SQL + "p_size IN (3, 7, 9) OR p_size BETWEEN 40 AND 44")
def where_in_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "part.size IN (:wanted, 40..44)", wanted=[3, 7, 9])


@query(PART_SQL + "(p_size * 3 + 1) % 7 = 2 AND p_retailprice / 2.0 - 1.0 > 460")
def where_arith_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, "(part.size * 3 + 1) % 7 = 2 AND retailprice / 2.0 - 1.0 > 460")


@query(PART_SQL + "-p_size > -10 AND NOT p_size = 3")
def where_unary_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_dimensions("part")
    size = q.x("part.size")
    return q.where((-size > -10) & ~(size == 3)).data_ids(["part"]).frame()


@query(PART_SQL + "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def where_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_dimensions("part")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return q.where(q.x("part").in_query(lines, "l_partkey")).data_ids(["part"]).frame()


@query(PART_SQL + "p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def where_not_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_dimensions("part")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return q.where(~q.x("part").in_query(lines, "l_partkey")).data_ids(["part"]).frame()


@query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS NULL OR s <> 'O'")
def where_null_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.plans.expressions import frame_resolver, predicate

    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return predicate("s = NULL OR s != 'O'", frame_resolver(df)).apply(df).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT *, nullif(o_orderstatus, 'F') AS s FROM orders)")
def where_glob_all_matches_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    return df.where(glob(F.col("s"), "*")).select("o_orderkey")


@query("""SELECT o_orderkey AS "order", o_custkey AS customer, c_nationkey AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE o_orderdate < TIMESTAMP '1996-02-01 00:00:30' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1996-01-01 00:00:30'""")
def where_timespan_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals are UTC and columns TAI, which was 30 seconds ahead."""
    q = catalog(spark, sf_dir).query().join_dimensions("order")
    return q.where("order.timespan OVERLAPS (T'1996-01-01', T'1996-02-01')").data_ids(["order"]).frame()


@query("""SELECT o_orderkey AS "order", o_custkey AS customer, c_nationkey AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:32' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '2000-06-01 00:00:32'""")
def where_timespan_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_dimensions("order")
    return q.where("order.timespan.begin >= T'2000-01-01' AND timespan.end < T'2000-06-01'").data_ids(["order"]).frame()


@query("""SELECT c_custkey AS customer, c_nationkey AS nation, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'""")
def default_data_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    c.defaults["region"] = "ASIA"
    return c.query().data_ids(["customer"]).frame()


# ---------------------------------------------------------------- counts, order, limits


@query("SELECT count(*)::BIGINT AS n FROM part WHERE p_size > 10")
def count_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().where("part.size > 10").data_ids(["part"]).frame().agg(F.count("*").alias("n"))


@query("SELECT EXISTS (SELECT 1 FROM part WHERE p_size > 10) AS found, EXISTS (SELECT 1 FROM part WHERE p_size > 1000) AS none")
def any_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query()
    some = lambda text: q.where(text).data_ids(["part"]).frame().limit(1).agg(F.count("*").alias("n"))
    one = some("part.size > 10").select((F.col("n") > 0).alias("found"))
    return one.join(some("part.size > 1000").select((F.col("n") > 0).alias("none")), F.lit(True))  # one row each


@query("""SELECT p_partkey AS part, p_brand AS brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25""")
def order_limit_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).query().data_ids(["part"]).order_by("-part.retailprice", "part").limit(25).frame()


# ---------------------------------------------------------------- time

RANGES_SQL = """SELECT o_custkey, o_orderkey, d AS begin, coalesce(lead(d) OVER (PARTITION BY o_custkey ORDER BY d), 4102444800000000000) AS "end"
FROM (SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS d, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", nsec("o_orderdate").alias("begin"))
    return ops.validity_ranges(orders, ["o_custkey"], "begin", "o_orderkey").select("o_custkey", "o_orderkey", "validity")


@query(RANGES_SQL)
def validity_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("o_custkey", "o_orderkey", "validity.begin", "validity.end")


@query(f"""WITH r AS ({RANGES_SQL}), l AS (SELECT {ID_SQL} AS dataset_id, o_custkey,
date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400000000000 AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT dataset_id, l.o_custkey, t, r.o_orderkey FROM l JOIN r ON l.o_custkey = r.o_custkey AND r.begin <= t AND r.end > t""")
def calib_lookup_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", dataset_id(spark, sf_dir), nsec("l_shipdate").alias("t"))
    lines = dealt(spark, sf_dir, "lineitem", lines, "l_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("dataset_id", "o_custkey", "t")
    # dealt by the key of the lookup, which needs no other shuffle of them
    rows = rows.repartition(shares(spark, sf_dir, "lineitem"), "o_custkey").distinct()
    return ops.calibration_lookup(rows, _ranges(spark, sf_dir), ["o_custkey"], "t").select("dataset_id", "o_custkey", "t", "o_orderkey")


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY""")
def timespan_overlap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", ts.span(nsec("o_orderdate"), nsec("o_orderdate") + 30 * DAY).alias("s"))
    a, b = o.withColumnRenamed("o_orderkey", "a"), o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("s").alias("r"))
    return ops.overlap_join(a, b, ["o_custkey"], "s", "r").where("a < b").select("a", "b")


WINDOW_BEGIN, WINDOW_END = 820454400000000000, 915148800000000000  # 1996-01-01 and 1999-01-01


@query(f"""WITH r AS ({RANGES_SQL}) SELECT * FROM (
SELECT o_custkey, o_orderkey, begin, "end" FROM r WHERE NOT ("end" > {WINDOW_BEGIN} AND {WINDOW_END} > begin)
UNION ALL SELECT o_custkey, o_orderkey, begin, {WINDOW_BEGIN} FROM r WHERE "end" > {WINDOW_BEGIN} AND {WINDOW_END} > begin AND begin < {WINDOW_BEGIN}
UNION ALL SELECT o_custkey, o_orderkey, {WINDOW_END}, "end" FROM r WHERE "end" > {WINDOW_BEGIN} AND {WINDOW_END} > begin AND "end" > {WINDOW_END})""")
def decertify_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ops.decertify(_ranges(spark, sf_dir), ts.Timespan(WINDOW_BEGIN, WINDOW_END))
    return cut.select("o_custkey", "o_orderkey", "validity.begin", "validity.end")


@query("""SELECT a.o_custkey, count(*)::BIGINT AS n_conflicts FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY GROUP BY 1""")
def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = timespan_overlap_orders(spark, sf_dir)
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), "o_custkey")
    return pairs.join(owner, "a").groupBy("o_custkey").agg(F.count("*").alias("n_conflicts"))


# ---------------------------------------------------------------- collections


CHAINS_SQL = """SELECT 'top' AS parent, r_name AS child, r_regionkey::INT AS position FROM region
UNION ALL SELECT r_name, n_name, n_nationkey::INT FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_name, c_name, c_custkey::INT FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT r_name, c_name, c_custkey::INT + 1000 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey <> n_regionkey WHERE c_acctbal > 9000"""


@query(f"""WITH RECURSIVE c AS ({CHAINS_SQL}),
w AS (SELECT child, [position] AS path FROM c WHERE parent = 'top' UNION ALL SELECT c.child, list_append(w.path, c.position) FROM w JOIN c ON c.parent = w.child)
SELECT child, (row_number() OVER (ORDER BY path) - 1)::INT AS rank FROM (SELECT child, min(path) AS path FROM w GROUP BY child)""")
def chain_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of regions, nations and customers, some of them in several places, flattened from a table of links."""
    t = lambda name: table(spark, sf_dir, name)
    link = lambda df, parent, child, at: df.select(parent.alias("parent"), F.col(child).alias("child"), at.cast("int").alias("position"))
    r, n, c = t("region"), t("nation"), t("customer")
    placed = n.join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))  # tables of fixed size
    mine = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"))
    others = mine.where("c_acctbal > 9000").join(F.broadcast(r), F.col("r_regionkey") != F.col("n_regionkey"))
    chain = link(r, F.lit("top"), "r_name", F.col("r_regionkey"))
    chain = chain.unionByName(link(placed, F.col("r_name"), "n_name", F.col("n_nationkey")))
    chain = chain.unionByName(link(mine, F.col("n_name"), "c_name", F.col("c_custkey")))
    chain = chain.unionByName(link(others, F.col("r_name"), "c_name", F.col("c_custkey") + 1000))
    return flattened(spark, chain, "top")


@query("""SELECT l_returnflag AS collection, list_sort(list(DISTINCT r_name))[1] AS first_region, count(DISTINCT r_name)::BIGINT AS n_regions
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def collection_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    places = c.expand(c.elements["supplier"].select("supplier", "nation")).select("supplier", "region")
    tags = c.types["shipment"].frame.select("collection", "supplier", F.lit("shipment").alias("dataset_type")).distinct()
    found = ops.summaries(tags.join(places, "supplier"), ["region"])
    return found.select("collection", F.get("region", F.lit(0)).alias("first_region"), F.size("region").cast("long").alias("n_regions"))


@query(f"""SELECT 'invoice' AS dataset_type, o_orderkey AS dataset_id, 'A' AS run FROM orders
UNION ALL SELECT 'shipment', dataset_id, run FROM ({SHIPPED_SQL}) WHERE run = 'A'""")
def union_dataset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_datasets(catalog(spark, sf_dir), ["shipment", "invoice"], ["A"]).select("dataset_type", "dataset_id", "run")


@query(f"""SELECT dataset_id FROM ({SHIPPED_SQL}) WHERE run = 'A' UNION SELECT o_orderkey FROM ({{RANGES_SQL}})""".replace("{RANGES_SQL}", """SELECT min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate"""))
def tags_union_calibs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that a tag or a calibration collection holds."""
    tagged = shipments(spark, sf_dir).where("run = 'A'").select("dataset_id")
    certified = terms(spark, sf_dir).select("dataset_id")
    return ops.union(tagged, certified)


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = shipments(spark, sf_dir)
    return s.where("run = 'A'").select("part", "supplier"), s.where("run = 'R'").select("part", "supplier")


SETS_SQL = f"SELECT part, supplier FROM ({SHIPPED_SQL}) WHERE run = "


@query(f"{SETS_SQL} 'A' INTERSECT {SETS_SQL} 'R'")
def setop_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.intersection(*_two_sets(spark, sf_dir))


@query(f"{SETS_SQL} 'A' UNION {SETS_SQL} 'R'")
def setop_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.union(*_two_sets(spark, sf_dir))


@query(f"{SETS_SQL} 'A' EXCEPT {SETS_SQL} 'R'")
def setop_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.difference(*_two_sets(spark, sf_dir))


@query(f"({SETS_SQL} 'A' EXCEPT {SETS_SQL} 'R') UNION ALL ({SETS_SQL} 'R' EXCEPT {SETS_SQL} 'A')")
def setop_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symmetric_difference(*_two_sets(spark, sf_dir))


@query("SELECT p_partkey AS part, p_brand AS brand FROM part JOIN (VALUES (1), (5), (7), (100000000)) v(k) ON k = p_partkey")
def upload_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = catalog(spark, sf_dir).query().join_data_coordinates([{"part": k} for k in (1, 5, 7, 100_000_000)])
    return q.data_ids(["part"]).frame()


@query(f"""SELECT dataset_id, run AS collection, 0::BIGINT AS begin, 4102444800000000000 AS "end" FROM ({SHIPPED_SQL})
UNION SELECT o_orderkey, 'calib', begin, "end" FROM ({RANGES_SQL})""")
def associations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    calibs = _ranges(spark, sf_dir).select(F.col("o_orderkey").alias("dataset_id"), F.lit("calib").alias("collection"), "validity")
    got = ops.associations(shipments(spark, sf_dir), calibs, shares(spark, sf_dir, "lineitem"))
    return got.select("dataset_id", "collection", "validity.begin", "validity.end")


# ---------------------------------------------------------------- space


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", (F.get("embedding", F.lit(0)) * 180).cast("double").alias("lon"), (F.get("embedding", F.lit(1)) * 90).cast("double").alias("lat"))


POINTS_SQL = "SELECT vec_id, embedding[1]::DOUBLE * 180 AS lon, embedding[2]::DOUBLE * 90 AS lat FROM embeddings"


@query(f"""SELECT vec_id FROM ({POINTS_SQL}) WHERE degrees(2 * asin(sqrt(least(1, pow(sin((radians(5) - radians(lat)) / 2), 2)
+ cos(radians(lat)) * cos(radians(5)) * pow(sin((radians(10) - radians(lon)) / 2), 2))))) <= 20""")
def spatial_constraint_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.constrained(_points(spark, sf_dir), "region", rg.Region.circle(10, 5, 20), "lon", "lat").select("vec_id")


BOXES_SQL = f"SELECT vec_id, lon - 0.5 AS x0, lon + 0.5 AS x1, lat - 0.25 AS y0, lat + 0.25 AS y1 FROM ({POINTS_SQL})"
PAIRS_SQL = f"""SELECT a.vec_id AS a, b.vec_id AS b FROM ({BOXES_SQL}) a JOIN ({BOXES_SQL}) b
ON a.vec_id < b.vec_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"""


def _box_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _points(spark, sf_dir)
    # longitudes are shifted by 180, away from the meridian, where the test table has points on both sides
    x, y = F.col("lon") + 180, F.col("lat")
    made = rg.box(x - 0.5, y - 0.25, x + 0.5, y + 0.25)
    return p.select(F.col("vec_id").alias("a"), made.alias("ra")), p.select(F.col("vec_id").alias("b"), made.alias("rb"))


@query(PAIRS_SQL)
def spatial_join_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.join(*_box_sides(spark, sf_dir), "ra", "rb").where("a < b").select("a", "b")


@query(f"SELECT DISTINCT a FROM ({PAIRS_SQL})")
def projected_overlap_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.project(spatial.matched(*_box_sides(spark, sf_dir), "ra", "rb", F.col("a") < F.col("b")), ["a"])


# ---------------------------------------------------------------- writes


@query("""SELECT * FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey, s_name, s_acctbal + 1 FROM supplier WHERE s_suppkey % 3 = 0)""")
def replace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return ops.replace(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE NOT s_acctbal > 0""")
def ensure_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers inserted where those in credit are there already."""
    s = table(spark, sf_dir, "supplier")
    held = s.where("s_acctbal > 0").select("s_suppkey", "s_name")
    return ops.ensure(held, s.select("s_suppkey", F.lit("new").alias("s_name")), ["s_suppkey"])


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0""")
def ensure_absent_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ensure_absent, into a table that grows with supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return ops.ensure(s.where("s_suppkey % 3 = 0"), s.where("s_suppkey % 2 = 0").withColumn("s_name", F.lit("new")), ["s_suppkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return ops.update(s, s.where("s_suppkey % 4 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), ["s_suppkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 AND NOT s_acctbal < 0")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return ops.delete_where(ops.delete(s, s.where("s_suppkey % 5 = 0"), ["s_suppkey"]), F.col("s_acctbal") < 0).select("s_suppkey")


def _conflicts(s: DataFrame, altered: str = "true") -> DataFrame:
    """Conflicts of all shipments, of which those that ``altered`` says are changed, with what is there."""
    s = s.withColumn("dataset_type", F.lit("shipment"))
    one = lambda c, n: ((c % n == 0) & F.expr(altered)).cast("int")
    part = F.col("part")
    new = s.select(
        (F.col("dataset_id") + one(part, 11)).alias("dataset_id"), "dataset_type",
        F.when((part % 7 == 0) & F.expr(altered), "X").otherwise(F.col("run")).alias("run"), (part + one(part, 5)).alias("part"), "supplier",
    )
    return ops.import_conflicts(s, s, new, ["part", "supplier"])


def conflicts_sql(altered: str) -> str:
    return f"""WITH d AS ({SHIPPED_SQL}), n AS (SELECT dataset_id, part, supplier, CASE WHEN part % 7 = 0 AND {altered} THEN 'X' ELSE run END AS run,
part + (part % 5 = 0 AND {altered})::INT AS np, dataset_id + (part % 11 = 0 AND {altered})::INT AS nid FROM d)
SELECT DISTINCT dataset_id, reason FROM (
SELECT nid AS dataset_id, 'definition' AS reason FROM n JOIN d ON d.dataset_id = nid WHERE d.run <> n.run
UNION ALL SELECT nid, 'data_id' FROM n JOIN d ON d.dataset_id = nid AND d.run = n.run WHERE d.part <> np OR d.supplier <> n.supplier
UNION ALL SELECT nid, 'id' FROM n JOIN d ON d.run = n.run AND d.part = np AND d.supplier = n.supplier WHERE d.dataset_id <> nid)"""


@query(conflicts_sql("run = 'A'"))
def import_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipments imported again, those of one run altered."""
    return _conflicts(shipments(spark, sf_dir), "run = 'A'")


@query(conflicts_sql("true"))
def import_conflicts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As import_conflicts, with those of every run altered."""
    return _conflicts(shipments(spark, sf_dir))


@query("SELECT ((l_partkey::BIGINT << 20) | l_suppkey)::BIGINT AS packed, l_partkey AS part, l_suppkey AS supplier FROM lineitem GROUP BY ALL")
def pack_data_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = shipments(spark, sf_dir).select("part", "supplier").distinct()
    bits = {"part": 40, "supplier": 20}
    out = ids.select(ops.packed(bits).alias("packed"))
    return out.select("packed", *ops.unpacked(F.col("packed"), bits).values())


@query("""SELECT 'shipment' AS dataset_type, dataset_id, 'part' || lpad(part::VARCHAR, 8, '0') || '/' || supplier AS path, p_brand AS brand, n_name AS nation_name
FROM (""" + SHIPPED_SQL + """) JOIN part ON p_partkey = part JOIN supplier ON s_suppkey = supplier JOIN nation ON n_nationkey = s_nationkey WHERE run = 'R'""")
def obscore_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row for each dataset."""
    c = catalog(spark, sf_dir)
    rows = c.query().datasets("shipment", "R").frame()
    wide = c.expand(rows, records=True)
    return wide.select(F.lit("shipment").alias("dataset_type"), "dataset_id", ops.templated("part{part:08d}/{supplier}").alias("path"), "brand", F.col("nation__name").alias("nation_name"))


# ---------------------------------------------------------------- sources


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def parquet_column_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.read(spark, f"{sf_dir}/customer.parquet", columns=["c_*key", "c_name"])


@query("SELECT count(*)::BIGINT AS rowcount FROM customer")
def parquet_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columnar.read(spark, f"{sf_dir}/customer.parquet", component="rowcount")


# ---------------------------------------------------------------- joins that the planner makes

VALID_SQL = f"""WITH r AS ({RANGES_SQL}), o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS t FROM orders)
SELECT o.o_orderkey AS "order", r.o_orderkey AS dataset_id FROM o JOIN r ON o.o_custkey = r.o_custkey AND """


@query(VALID_SQL + 'r.begin < o.t + 2592000000000000 AND r."end" > o.t')
def validity_join_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with all terms of their customer whose validity overlaps the order's 30 days."""
    q = calibrated(spark, sf_dir).query().join_dimensions("order")
    found = q.general(["order"], dataset_fields={"terms": ["dataset_id"]}, collections={"terms": ["calib"]}, find_first=False)
    return found.frame().select("order", "dataset_id")


@query(VALID_SQL + 'r.begin <= o.t AND r."end" > o.t')
def calib_find_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the one set of terms that is valid when they begin; a second one would fail the query."""
    q = calibrated(spark, sf_dir).query().join_dimensions("order").join_dataset_search("terms", "calib")
    q = q.where("terms.timespan OVERLAPS order.timespan.begin")
    found = q.general(["order"], dataset_fields={"terms": ["dataset_id"]}, collections={"terms": ["calib"]}, find_first=True)
    return found.frame().select("order", "dataset_id")


@query(f"""SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL}) JOIN supplier ON s_suppkey = supplier
WHERE run = 'R' AND s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def find_first_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of one run, once each, though a join with customers repeats them."""
    q = catalog(spark, sf_dir).query().join_dimensions("customer").where("customer.acctbal > 9000")
    return q.datasets("shipment", "R").frame()


def _days(spark: SparkSession, sf_dir: str) -> Catalog:
    """Two temporal families: the days of all orders, and those of urgent ones."""
    u = Universe([Element("order", "o", temporal="orders"), Element("urgent", "u", temporal="urgent")], {"temporal": {"orders": ("order",), "urgent": ("urgent",)}})
    o = table(spark, sf_dir, "orders")
    day = ts.span(nsec("o_orderdate"), nsec("o_orderdate") + DAY).alias("timespan")
    return Catalog(u, {"order": o.select(F.col("o_orderkey").alias("order"), day), "urgent": o.where("o_orderpriority LIKE '1%'").select(F.col("o_orderkey").alias("urgent"), day)})


@query("""SELECT a.o_orderkey AS "order", b.o_orderkey AS urgent FROM orders a JOIN orders b ON a.o_orderdate::DATE = b.o_orderdate::DATE WHERE b.o_orderpriority LIKE '1%'""")
def temporal_join_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families without a key in common: their spans overlap."""
    return _days(spark, sf_dir).query().data_ids(["order", "urgent"]).frame()


def _boxes(spark: SparkSession, sf_dir: str) -> Catalog:
    u = Universe([Element("here", "h", spatial="here"), Element("there", "t", spatial="there")], {"spatial": {"here": ("here",), "there": ("there",)}})
    x, y = F.col("lon") + 180, F.col("lat")
    made = rg.box(x - 0.5, y - 0.25, x + 0.5, y + 0.25).alias("region")
    p = _points(spark, sf_dir)
    return Catalog(u, {"here": p.select(F.col("vec_id").alias("here"), made), "there": p.select(F.col("vec_id").alias("there"), made)})


@query(f"""SELECT a.vec_id AS here, b.vec_id AS there FROM ({BOXES_SQL}) a JOIN ({BOXES_SQL}) b
ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1""")
def spatial_join_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that the condition spells out is a join over pixels, too."""
    q = _boxes(spark, sf_dir).query().join_dimensions("here", "there").where("here.region OVERLAPS there.region")
    return q.data_ids(["here", "there"]).frame()


# ---------------------------------------------------------------- times and globs


@query("""SELECT o_orderkey AS "order" FROM orders WHERE o_orderdate = TIMESTAMP '1998-03-05'""")
def where_time_literal_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar literals are UTC: midnight in TAI comes 31 seconds before."""
    q = catalog(spark, sf_dir).query().join_dimensions("order")
    text = "order.timespan.begin >= T'1998-03-04T23:59:29' AND order.timespan.begin < T'1998-03-05 00:00:00' AND order.timespan.begin = T'1998-03-05/tai'"
    return q.where(text).data_ids(["order"]).frame().select("order")


@query(r"""SELECT p_partkey FROM part WHERE starts_with(p_type || '\x' || p_size || '*', 'PRO') AND contains(p_type || '\x' || p_size || '*', '\x1') AND p_size >= 10""")
def where_glob_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backslash before an ordinary character is one; before a wildcard it makes that plain."""
    from orrery.plans.expressions import frame_resolver, predicate

    df = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit("\\x"), F.col("p_size").cast("string"), F.lit("*")).alias("s"))
    return predicate(r"GLOB(s, 'PRO*\x1?\*')", frame_resolver(df)).apply(df).select("p_partkey")


@query("""SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS begin,
(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 1) * 86400000000000 AS "end" FROM orders""")
def day_obs_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of YYYYMMDD days, whatever the session's zone."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.to_date("o_orderdate"), "yyyyMMdd").cast("int").alias("day"))
    return o.select("o_orderkey", ts.day_obs_span(F.col("day")).alias("s")).select("o_orderkey", "s.begin", "s.end")


# ---------------------------------------------------------------- writes and lookups of catalogues


@query(f"""SELECT part, supplier, 'R' AS first_run FROM ({SHIPPED_SQL}) WHERE run = 'R'
UNION ALL SELECT part, supplier, 'new' FROM (SELECT part, supplier FROM ({SHIPPED_SQL}) WHERE run = 'N' EXCEPT SELECT part, supplier FROM ({SHIPPED_SQL}) WHERE run = 'R')""")
def insert_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets inserted into a new run, then found behind those of another."""
    c = catalog(spark, sf_dir)
    c.collections.register("new", Kind.RUN)
    ids = c.query().datasets("shipment", "N").frame().select("part", "supplier")
    c = datasets.insert_datasets(c, "shipment", "new", ids)
    return c.query().datasets("shipment", ["R", "new"]).frame().select("part", "supplier", F.col("run").alias("first_run"))


@query(f"SELECT dataset_id, run FROM ({SHIPPED_SQL}) WHERE part % 2 <> 0 OR run <> 'A'")
def prune_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's datasets of some data IDs purged; the rest of all runs."""
    c = catalog(spark, sf_dir)
    gone = c.query().where("part % 2 = 0").datasets("shipment", "A").frame().select("dataset_id")
    return datasets.prune(c, "shipment", gone, purge=True).types["shipment"].frame.select("dataset_id", "run")


@query(f"SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL}) WHERE run <> 'R' QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY run) = 1")
def remove_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A find-first search of a chain after one of its runs was removed."""
    c = datasets.remove_runs(catalog(spark, sf_dir), ["R"], unlink=True)
    return c.query().datasets("shipment", "all").frame()


@query(f"""WITH w AS (SELECT dataset_id FROM ({SHIPPED_SQL}) WHERE supplier % 7 = 0 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)
SELECT dataset_id::VARCHAR AS dataset_id, 'shipment' AS dataset_type, run FROM ({SHIPPED_SQL}) WHERE dataset_id IN (SELECT dataset_id FROM w)
UNION ALL SELECT o_orderkey::VARCHAR, 'invoice', 'A' FROM orders WHERE o_orderkey IN (SELECT dataset_id FROM w)""")
def refs_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of any type by their ids."""
    c = catalog(spark, sf_dir)
    wanted = shipments(spark, sf_dir).where("supplier % 7 = 0").select("dataset_id")
    wanted = wanted.union(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("dataset_id")))
    return datasets.refs_by_id(c, wanted, partitions=shares(spark, sf_dir, "lineitem")).select("dataset_id", "dataset_type", "run")


@query("""SELECT o_orderkey AS "order", date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS begin,
(date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 30) * 86400000000000 AS "end" FROM orders WHERE o_totalprice > 200000""")
def data_id_timespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timespans of data IDs."""
    c = catalog(spark, sf_dir)
    ids = c.query().where("order.totalprice > 200000").data_ids(["order"]).frame().select("order")
    return extents(c, ids).select("order", "timespan.begin", "timespan.end")


@query("""SELECT 'all' AS collection, count(DISTINCT r_name)::BIGINT AS n_regions FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT l_returnflag, count(DISTINCT r_name) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def chained_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of runs, and of the chain that holds them."""
    c = catalog(spark, sf_dir)
    places = c.expand(c.elements["supplier"].select("supplier", "nation")).select("supplier", "region")
    tags = c.types["shipment"].frame.select("collection", "supplier", F.lit("shipment").alias("dataset_type")).distinct()
    found = datasets.merged_summaries(ops.summaries(tags.join(places, "supplier"), ["region"]), c.collections)
    return found.select("collection", F.size("region").cast("long").alias("n_regions"))


@query("""SELECT s_suppkey AS supplier, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000 OR s_suppkey % 2 = 0""")
def record_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).elements["supplier"]
    return datasets.record_union(rows.where("acctbal > 5000"), rows.where("supplier % 2 = 0"), ["supplier"]).select("supplier", "name", "nation")
