"""Further queries over the test tables: sky pixels and their index, intervals of all lengths, stored layouts, pages, keyed writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import pixels as px, region as rg, times, timespan as ts
from orrery.operators import catalog as ops, datasets, obscore, transfer
from orrery.plans.query import Catalog, DatasetType, all_datasets
from orrery.plans.universe import Element, Universe
from orrery.queries import DAY, ID_SQL, ORACLES, POINTS_SQL, QUERIES, SHIPPED_SQL, _points, catalog, dataset_id, nsec, query, shares, shipments, table


__all__ = ["ORACLES", "QUERIES"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: below the checkpoint folder, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return f"{base.rstrip('/')}/orrery/{uuid.uuid4().hex}/{name}"


# ---------------------------------------------------------------- sky pixels


def _vector_sql(of: str) -> str:
    return f"cos(radians({of}.lon)) * cos(radians({of}.lat)) AS x, sin(radians({of}.lon)) * cos(radians({of}.lat)) AS y, sin(radians({of}.lat)) AS z"


def _mesh_sql(depth: int) -> str:
    """A recursive table ``mesh`` (id, depth, dx, ... fz) of all pixels down to a depth."""
    names = [f"{v}{c}" for v in "def" for c in "xyz"]
    corner = lambda i: ", ".join(f"{float(c)}::DOUBLE" for c in px.CORNERS[i])
    roots = ", ".join(f"({8 + k}::BIGINT, 0, {', '.join(corner(i) for i in f)})" for k, f in enumerate(px.FIRST))
    halves = {"u": "ef", "v": "df", "w": "de"}
    sums = ", ".join(f"{p[0]}{c} + {p[1]}{c} AS {m}{c}" for m, p in halves.items() for c in "xyz")
    units = ", ".join(f"{m}{c} / sqrt({m}x * {m}x + {m}y * {m}y + {m}z * {m}z) AS {m}{c}" for m in halves for c in "xyz")
    kids = [("d", "w", "v"), ("e", "u", "w"), ("f", "v", "u"), ("u", "v", "w")]
    picked = ", ".join("CASE k " + " ".join(f"WHEN {k} THEN {kid[i]}{c}" for k, kid in enumerate(kids)) + " END" for i in range(3) for c in "xyz")
    kept = ", ".join(names)
    return f"""mesh(id, depth, {kept}) AS (
      SELECT * FROM (VALUES {roots}) t(id, depth, {kept})
      UNION ALL
      SELECT id * 4 + k, depth + 1, {picked}
      FROM (SELECT id, depth, {kept}, {units} FROM (SELECT id, depth, {kept}, {sums} FROM mesh WHERE depth < {depth})), (VALUES (0), (1), (2), (3)) ks(k)
    )"""


def _side_sql(p: str, q: str, v: str) -> str:
    """(p x q) . v, of corners of ``m`` and a vector."""
    return (
        f"((m.{p}y * m.{q}z - m.{p}z * m.{q}y) * {v}.x + (m.{p}z * m.{q}x - m.{p}x * m.{q}z) * {v}.y"
        f" + (m.{p}x * m.{q}y - m.{p}y * m.{q}x) * {v}.z)"
    )


_SIDES = (("d", "e"), ("e", "f"), ("f", "d"))
_INSIDE_SQL = " AND ".join(f"{_side_sql(p, q, 'v')} >= -1e-15" for p, q in _SIDES)


def _edge_sql(p: str, q: str) -> str:
    """The angle from v to the side between two corners of m."""
    n = {
        "x": f"(m.{p}y * m.{q}z - m.{p}z * m.{q}y)", "y": f"(m.{p}z * m.{q}x - m.{p}x * m.{q}z)", "z": f"(m.{p}x * m.{q}y - m.{p}y * m.{q}x)",
    }
    dot = lambda a, b: " + ".join(f"{a(c)} * {b(c)}" for c in "xyz")
    of_n, of_v = (lambda c: n[c]), (lambda c: f"v.{c}")
    corner = lambda k: lambda c: f"m.{k}{c}"

    def turn(a, b) -> str:
        return f"(({a('y')} * {b('z')} - {a('z')} * {b('y')}) * v.x + ({a('z')} * {b('x')} - {a('x')} * {b('z')}) * v.y + ({a('x')} * {b('y')} - {a('y')} * {b('x')}) * v.z)"

    ends = ", ".join(f"acos(greatest(-1, least(1, {dot(corner(k), of_v)})))" for k in (p, q))
    sine = f"abs({dot(of_n, of_v)}) / sqrt({dot(of_n, of_n)})"
    return f"CASE WHEN {turn(of_n, corner(p))} >= 0 AND {turn(corner(q), of_n)} >= 0 THEN asin(least(1, {sine})) ELSE least({ends}) END"


DEPTH, RADIUS = 4, 3.0


@query(f"""WITH RECURSIVE {_mesh_sql(DEPTH)}, v AS (SELECT vec_id, {_vector_sql("p")} FROM ({POINTS_SQL}) p)
SELECT vec_id, min(m.id) AS htm4, min(m.id) // 16 AS htm2, 4 AS depth FROM v JOIN (SELECT * FROM mesh WHERE depth = {DEPTH}) m ON {_INSIDE_SQL} GROUP BY vec_id""")
def skypix_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's pixel, the one that holds it two depths above, and the depth that the id tells."""
    found = _points(spark, sf_dir).select("vec_id", px.of_point("lon", "lat", DEPTH).alias("htm4"))
    return found.select("vec_id", "htm4", px.parent(F.col("htm4"), 2).alias("htm2"), px.depth_of(F.col("htm4")).alias("depth"))


def sky(spark: SparkSession, sf_dir: str, radius: float = RADIUS) -> Catalog:
    """The test vectors as sources with circles, beside the pixels of depth 3."""
    u = Universe([Element("source", "s", spatial="source"), Universe.sky_pixels(3)], {"spatial": {"source": ("source",), "htm3": ("htm3",)}})
    made = F.struct(F.lit("circle").alias("kind"), F.array("lon", "lat", F.lit(radius)).alias("values")).alias("region")
    return Catalog(u, {"source": _points(spark, sf_dir).select(F.col("vec_id").alias("source"), made)})


@query(f"""WITH RECURSIVE {_mesh_sql(3)}, v AS (SELECT vec_id, {_vector_sql("p")} FROM ({POINTS_SQL}) p)
SELECT vec_id AS source, m.id AS htm3 FROM v JOIN (SELECT * FROM mesh WHERE depth = 3) m
ON ({_INSIDE_SQL}) OR degrees(least({", ".join(_edge_sql(p, q) for p, q in _SIDES)})) <= {RADIUS} + 1e-10""")
def skypix_join_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and the pixels that they overlap: a dimension without a table, joined by the planner."""
    return sky(spark, sf_dir).query().data_ids(["source", "htm3"]).frame()


@query(f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN lon + 90 ELSE lon END AS lon, lat FROM ({POINTS_SQL}) WHERE vec_id % 10 <> 3)
SELECT vec_id AS source FROM p WHERE degrees(2 * asin(sqrt(least(1, pow(sin((radians(5) - radians(lat)) / 2), 2)
+ cos(radians(lat)) * cos(radians(5)) * pow(sin((radians(10) - radians(lon)) / 2), 2))))) <= 20 + {RADIUS}""")
def spatial_constraint_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circle's sources by a stored index of pixels, after some records were replaced and some deleted."""
    c = datasets.with_index(sky(spark, sf_dir), "source", shared_folder(spark, "pixels"), depth=5)
    some = c.elements["source"].where("source % 10 = 0")
    v = F.col("region.values")
    moved = F.struct(F.lit("circle").alias("kind"), F.array(v[0] + 90, v[1], v[2]).alias("values"))
    c = datasets.insert_records(c, "source", some.withColumn("region", moved), replace_=True)
    c = datasets.delete_records(c, "source", c.elements["source"].where("source % 10 = 3").select("source"))
    return c.query().where("source.region OVERLAPS CIRCLE(10, 5, 20)").data_ids(["source"]).frame()


# ---------------------------------------------------------------- intervals


@query("""WITH y AS (SELECT DISTINCT date_trunc('year', o_orderdate)::DATE AS y FROM orders)
SELECT o_orderkey AS "order", year(y)::BIGINT AS year FROM orders JOIN y ON o_orderdate::DATE >= y AND o_orderdate::DATE < y + INTERVAL 1 YEAR
UNION ALL SELECT o_orderkey, 0 FROM orders""")
def temporal_join_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days beside whole years, and beside a span without ends."""
    o = table(spark, sf_dir, "orders")
    years = o.select(F.year("o_orderdate").cast("long").alias("year")).distinct()
    begin = lambda y: F.unix_date(F.make_date(y.cast("int"), F.lit(1), F.lit(1))).cast("long") * DAY
    spans = years.select("year", ts.span(begin(F.col("year")), begin(F.col("year") + 1)).alias("timespan"))
    spans = spans.unionByName(spans.groupBy().agg(F.lit(0).cast("long").alias("year")).withColumn("timespan", ts.Timespan().column()))
    u = Universe([Element("order", "o", temporal="orders"), Element("year", "y", temporal="years")], {"temporal": {"orders": ("order",), "years": ("year",)}})
    day = ts.span(nsec("o_orderdate"), nsec("o_orderdate") + DAY).alias("timespan")
    c = Catalog(u, {"order": o.select(F.col("o_orderkey").alias("order"), day), "year": spans})
    return c.query().data_ids(["order", "year"]).frame()


_ONE_KEY_SQL = """SELECT d AS begin, coalesce(lead(d) OVER (ORDER BY d), 4102444800000000000) AS "end"
FROM (SELECT DISTINCT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS d FROM orders)"""


@query(f"""WITH r AS ({_ONE_KEY_SQL}), l AS (SELECT l_orderkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 86400000000000 AS t FROM lineitem)
SELECT l_orderkey, t, r.begin FROM l JOIN r ON r.begin <= t AND r."end" > t""")
def validity_lookup_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line looked up in the ranges of one key: rows that repeat come back as often."""
    days = table(spark, sf_dir, "orders").select(F.lit("all").alias("k"), nsec("o_orderdate").alias("begin"), F.lit(0).alias("tie"))
    ranges = ops.validity_ranges(days, ["k"], "begin", "tie").select("k", "validity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("all").alias("k"), nsec("l_shipdate").alias("t"))
    found = ops.calibration_lookup(lines, ranges, ["k"], "t")
    return found.select("l_orderkey", "t", "validity.begin")


# ---------------------------------------------------------------- times of columns


@query("""SELECT l_partkey AS part, l_suppkey AS supplier, max(l_shipdate)::DATE::VARCHAR AS ingested FROM lineitem GROUP BY 1, 2
HAVING max(l_shipdate) >= TIMESTAMP '1997-07-01' AND max(l_shipdate) < TIMESTAMP '1999-01-01'""")
def where_ingest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by when they came in: timestamps of UTC against literals, across two leap seconds."""
    c = catalog(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_shipdate", dataset_id(spark, sf_dir))
    lines = lines.repartition(shares(spark, sf_dir, "lineitem"), "part", "supplier").groupBy("part", "supplier")
    rows = lines.agg(F.max("l_shipdate").cast("timestamp_ntz").alias("ingest_date"), F.max("dataset_id").alias("dataset_id"))
    c.register(DatasetType("arrival", ("part", "supplier"), rows.withColumns({"run": F.lit("A"), "collection": F.lit("A")})))
    q = c.query().join_dataset_search("arrival", "A").where("arrival.ingest_date >= T'1997-07-01' AND arrival.ingest_date < T'1999-01-01'")
    found = q.general(["part", "supplier"], dataset_fields={"arrival": ["ingest_date"]}, collections={"arrival": ["A"]}, find_first=False)
    return found.frame().select("part", "supplier", F.to_date("ingest_date").cast("string").alias("ingested"))


@query("""WITH u AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 86400000000000 AS utc, o_orderdate::DATE AS d FROM orders)
SELECT utc, utc + 1000000000::BIGINT * CASE WHEN d >= '1999-01-01' THEN 32 WHEN d >= '1997-07-01' THEN 31 WHEN d >= '1996-01-01' THEN 30 WHEN d >= '1994-07-01' THEN 29
WHEN d >= '1993-07-01' THEN 28 WHEN d >= '1992-07-01' THEN 27 ELSE 26 END AS tai, utc AS back FROM u""")
def tai_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of orders as TAI, and back."""
    days = table(spark, sf_dir, "orders").select(nsec("o_orderdate").alias("utc")).distinct()
    made = days.withColumn("tai", times.tai_of(F.col("utc")))
    return made.withColumn("back", times.utc_of(F.col("tai")))


# ---------------------------------------------------------------- writes with repeated keys


@query("""WITH new AS (SELECT nullif(l_suppkey % 7, 0) AS k, l_suppkey, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
SELECT k, l_suppkey, price, 'old' AS source FROM new WHERE l_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM new n WHERE n.k IS NOT DISTINCT FROM new.k AND n.l_suppkey % 3 = 0)
UNION ALL
SELECT k, s.l_suppkey, s.price, 'new' FROM (SELECT k, min(struct_pack(l_suppkey := l_suppkey, price := price)) AS s FROM new WHERE l_suppkey % 3 = 0 GROUP BY k)""")
def replace_upsert_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many new rows of each key, one of them null: the least of each takes the place of what is there."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("nullif(l_suppkey % 7, 0)").alias("k"), "l_suppkey")
    rows = rows.agg(F.min("l_extendedprice").alias("price"))
    old = rows.where("l_suppkey % 2 = 0").withColumn("source", F.lit("old"))
    return ops.replace(old, rows.where("l_suppkey % 3 = 0").withColumn("source", F.lit("new")), ["k"])


@query("""SELECT s_suppkey, s_name, coalesce(p, s_acctbal)::DOUBLE AS s_acctbal FROM supplier LEFT JOIN
(SELECT l_suppkey, min(l_extendedprice) AS p FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) ON l_suppkey = s_suppkey""")
def update_rows_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as an update of its supplier: the table keeps its rows, and has the least."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 = 0")
    new = lines.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_extendedprice").cast("double").alias("s_acctbal"))
    return ops.update(s, new, ["s_suppkey"])


# ---------------------------------------------------------------- layouts and results


@query(f"SELECT part, supplier, dataset_id, run FROM ({SHIPPED_SQL}) QUALIFY row_number() OVER (PARTITION BY part, supplier ORDER BY CASE run WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) = 1")
def find_first_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A find-first search of a type that is stored by collection and data ID: no shuffle after the scan."""
    c = datasets.stored(catalog(spark, sf_dir), "shipment", f"shipment_{uuid.uuid4().hex}", buckets=shares(spark, sf_dir, "lineitem"))
    return c.query().datasets("shipment", "all").frame()


@query(f"""WITH s AS ({SHIPPED_SQL}), h AS (SELECT l_partkey AS part, l_suppkey AS supplier, l_returnflag AS run, max({ID_SQL})::BIGINT AS dataset_id
FROM lineitem WHERE l_quantity > 25 GROUP BY ALL), a AS (SELECT 'shipment' AS dataset_type, * FROM s UNION ALL SELECT 'heavy', * FROM h),
f AS (SELECT dataset_type, part, supplier, dataset_id, run FROM a JOIN part ON p_partkey = part AND p_size > 20 WHERE run IN ('R', 'A')
  QUALIFY row_number() OVER (PARTITION BY dataset_type, part, supplier ORDER BY run DESC) = 1)
SELECT dataset_type, dataset_id, run, '{{"supplier":' || supplier || ',"part":' || part || '}}' AS data_id FROM f""")
def datasets_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two types with the same dimensions in the same runs: one group."""
    c = catalog(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("run"), dataset_id(spark, sf_dir)
    )
    heavy = lines.groupBy("part", "supplier", "run").agg(F.max("dataset_id").alias("dataset_id")).withColumn("collection", F.col("run"))
    c.register(DatasetType("heavy", ("part", "supplier"), heavy))
    return all_datasets(c, ["heavy", "shipment"], ["R", "A"], "part.size > 20")


@query("""SELECT o_orderkey AS "order", o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 1000""")
def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of an ordered result that is written once."""
    found = catalog(spark, sf_dir).query().general(["order"], dimension_fields={"order": ["totalprice"]}).order_by("-order.totalprice", "order")
    pages = found.snapshot(shared_folder(spark, "orders"), 500)
    return pages.page(2).select("order", F.col("order__totalprice").alias("totalprice"))


@query(f"""WITH u AS (SELECT DISTINCT supplier FROM ({SHIPPED_SQL}) WHERE run = 'R')
SELECT s_suppkey AS supplier, CASE WHEN s_acctbal > 5000 THEN 'given' WHEN s_suppkey % 2 = 0 THEN 'held' ELSE s_name END AS name
FROM supplier WHERE s_suppkey IN (SELECT supplier FROM u)""")
def records_of_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the suppliers of a run: those given, those held, and the table's for the rest."""
    c = catalog(spark, sf_dir)
    rows = c.elements["supplier"]
    given = rows.where("acctbal > 5000").withColumn("name", F.lit("given"))
    held = rows.where("supplier % 2 = 0").withColumn("name", F.lit("held"))
    ids = shipments(spark, sf_dir).where("run = 'R'").select("supplier")
    return datasets.records_from_layers(c, "supplier", ids, given, held).select("supplier", "name")


_TAI_SQL = """CASE WHEN d > DATE '1999-01-01' THEN 32 WHEN d > DATE '1997-07-01' THEN 31 WHEN d > DATE '1996-01-01' THEN 30 WHEN d > DATE '1994-07-01' THEN 29
WHEN d > DATE '1993-07-01' THEN 28 WHEN d > DATE '1992-07-01' THEN 27 ELSE 26 END"""


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, c_name, unnest([0, 30]) AS k, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT *, (day + INTERVAL (k) DAY)::DATE AS d FROM o),
m AS (SELECT *, (date_diff('day', DATE '1970-01-01', d)::BIGINT * 86400000000000 - ({_TAI_SQL})::BIGINT * 1000000000)::DOUBLE / 86400000000000.0::DOUBLE + 40587 AS mjd FROM t)
SELECT o_orderkey AS dataset_id, 'invoice' AS dataset_type, 'table' AS dataproduct_type, 'order' || lpad(o_orderkey::VARCHAR, 9, '0') AS obs_id,
'test' AS obs_collection, 'ivo://test/' || o_orderkey AS obs_publisher_did, min(mjd) AS t_min, max(mjd) AS t_max, 2592000.0::DOUBLE AS t_exptime,
CASE o_orderstatus WHEN 'F' THEN 4e-7 WHEN 'O' THEN 6e-7 END AS em_min, CASE o_orderstatus WHEN 'F' THEN 5e-7 WHEN 'O' THEN 7e-7 END AS em_max,
o_orderpriority AS priority, c_name AS target_name FROM m GROUP BY ALL""")
def obscore_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as an observation table, with the times of their orders."""
    c = catalog(spark, sf_dir)
    config = obscore.Config(
        "test",
        {"invoice": obscore.TypeConfig("table", obs_id="order{order:09d}", target_name="{customer__name}")},
        collections=("A", "all"),
        extra={"priority": "order__priority"},
        spectral=("order__status", {"F": (4e-7, 5e-7), "O": (6e-7, 7e-7)}),
    )
    made = obscore.table(c, config)
    return made.select(
        "dataset_id", "dataset_type", "dataproduct_type", "obs_id", "obs_collection", "obs_publisher_did", "t_min", "t_max", "t_exptime",
        "em_min", "em_max", "priority", "target_name",
    )


@query(f"""WITH s AS ({SHIPPED_SQL}), x AS (SELECT dataset_id, run FROM s WHERE part % 3 = 0 EXCEPT SELECT dataset_id, run FROM s WHERE run = 'R')
SELECT 'shipment' AS dataset_type, dataset_id, run FROM x UNION ALL SELECT 'invoice', o_orderkey, 'A' FROM orders WHERE o_totalprice > 200000""")
def transfer_of_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes of wanted datasets to a catalogue that has some of them, and lacks one of the types."""
    c = catalog(spark, sf_dir)
    there = Catalog(c.universe, c.elements, {"shipment": c.types["shipment"]}, c.collections)
    there.types["shipment"] = DatasetType("shipment", ("part", "supplier"), c.types["shipment"].frame.where("run = 'R'"))
    wanted = shipments(spark, sf_dir).where("part % 3 = 0").select(F.lit("shipment").alias("dataset_type"), "dataset_id")
    dear = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    wanted = wanted.unionByName(dear.select(F.lit("invoice").alias("dataset_type"), F.col("o_orderkey").alias("dataset_id")))
    return transfer.transfer_refs(c, there, wanted, register_types=True, dry_run=True)[1]


@query("""SELECT o_orderkey AS "order", p_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_totalprice > 300000 GROUP BY ALL""")
def standardized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data IDs of texts and of names that stand for keys."""
    c = catalog(spark, sf_dir)
    o, li, p = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part"))
    rows = o.where("o_totalprice > 300000").join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    # names of parts are not unique in the test tables, so they are keys together with the number
    keyed = F.concat_ws("/", F.col("p_name"), F.col("p_partkey").cast("string"))
    c.elements["part"] = c.elements["part"].withColumn("name", F.concat_ws("/", "name", F.col("part").cast("string")))
    ids = rows.select(F.col("o_orderkey").cast("string").alias("order"), keyed.alias("part.name")).distinct()
    return transfer.standardized(c, ids, ["order", "part"]).select("order", "part")
