"""Tables and files in the folder that driver and executors share, column names, and filters for keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from orrery.llm import rolling

_SETTING = "spark.checkpoint.dir"
#: A filter takes no more bits than this: 64 MB.
FILTER_BITS = 1 << 29
_SEGMENT = 1 << 20


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Where none is set, one machine may take a temporary one; a cluster may not."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/orrery/{uuid.uuid4().hex}/{name}"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path that ``folder`` gave, with what is below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Intermediate tables of one computation, deleted when it is done, but for those its result reads.

    What follows a table starts from files, so a lost executor costs its own tasks and no earlier stage.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, str] = {}
        self._held: list[DataFrame] = []

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = folder(self.spark, name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        self._held.append(out)  # so that no other frame gets its id
        return out

    def drop(self, *gone: DataFrame) -> None:
        for df in gone:
            if path := self._paths.pop(id(df), None):
                dropped(self.spark, path)

    def keep_only(self, *kept: DataFrame) -> None:
        self.drop(*(df for df in self._held if not any(df is k for k in kept)))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` computed once into a Parquet table in the shared folder, and read from there."""
    return Tables(df.sparkSession).write(df, name, **options)


def col(name: str) -> Column:
    """The column of this very name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` with all its columns in the struct ``doc``, beside these: no name of theirs can clash."""
    return docs.select(F.struct(*(col(c) for c in docs.columns)).alias("doc"), *(c.alias(n) for n, c in columns.items()))


def unwrapped(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that ``whole`` put into ``doc``."""
    return df.select(*(F.col("doc")[c].alias(c) for c in docs.columns)) if docs.columns else df.drop("doc")


def text_of(name: str) -> Column:
    """The bytes of a text, null as empty."""
    return F.coalesce(col(name), F.lit("")).cast("binary")


def key_of(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


class Filter:
    """Which 64-bit values are certainly not, or probably, among those of a column; for a broadcast of bounded size.

    It has forty bits a value or more, of which three are looked at; beyond
    FILTER_BITS it stays as it is, with less to say: of 50 million values it lets
    2 percent of others pass, of 100 million 8, of 500 million 61. It is made in
    segments: the driver gets each bit once.
    """

    def __init__(self, bits: int, looks: int, sent: object) -> None:
        self.bits, self.looks, self.sent = bits, looks, sent

    def _place(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((rolling.mixed(x.view(np.uint64)) >> np.uint64((0, 21, 34)[k])) & np.uint64(self.bits - 1)).astype(np.int64)

    def test(self, x: np.ndarray) -> np.ndarray:
        held, left = self.sent.value, np.arange(len(x))
        for k in range(self.looks):  # each look takes what the ones before it let pass
            p = self._place(x[left], k)
            left = left[(held[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(x), dtype=bool)
        out[left] = True
        return out

    @classmethod
    def of(cls, values: DataFrame) -> Filter:
        """``values``: one column of long."""
        n = values.count()
        bits = min(FILTER_BITS, 1 << max(20, (n * 40).bit_length()))
        out = cls(bits, 3 if n * 4 <= bits else 1, None)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(bits, dtype=bool)
            for batch in batches:
                for k in range(out.looks):
                    seen[out._place(_longs(batch.column(0)), k)] = True
            for at in range(0, bits, _SEGMENT):
                part = seen[at : at + _SEGMENT]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at // _SEGMENT]), pa.array([np.packbits(part).tobytes()], type=pa.binary())], names=["segment", "bits"]
                    )

        def either(table: pa.Table) -> pa.Table:
            found = None
            for row in table.column("bits"):
                part = np.frombuffer(row.as_buffer(), dtype=np.uint8)
                found = part.copy() if found is None else found | part
            return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([found.tobytes()], type=pa.binary())})

        filled = np.zeros(bits // 8, dtype=np.uint8)
        made = values.coalesce(8).mapInArrow(build, "segment long, bits binary").groupBy("segment")
        for row in made.applyInArrow(either, "segment long, bits binary").toLocalIterator():
            part = np.frombuffer(row["bits"], dtype=np.uint8)
            at = row["segment"] * _SEGMENT // 8
            filled[at : at + len(part)] = part
        out.sent = values.sparkSession.sparkContext.broadcast(filled)
        return out


def _longs(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False))


def among(keys: DataFrame, *columns: str) -> Column:
    """Whether the values of these columns are certainly not, or probably, among the rows of ``keys``.

    Only spares shuffling rows that a join would drop anyway.
    """
    made = Filter.of(keys.select(F.xxhash64(*(F.col(c) for c in columns)).alias("h")))

    @F.arrow_udf(T.BooleanType())
    def tested(column: pa.Array) -> pa.Array:
        return pa.array(made.test(_longs(column)))

    return tested(F.xxhash64(*(F.col(c) for c in columns)))


def likely(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose values of these columns may be among ``keys``: all that are, and few others."""
    return df.where(among(keys, *columns))


def ranked(df: DataFrame, group: str, *order: str) -> tuple[DataFrame, int, int]:
    """``df`` with ``tree``, the rank of its group among groups, and ``place`` in its group, both from 0; how many groups, and rows of the largest.

    Rows are dealt out by ranges of (group, order), so that a hot group takes many
    tasks, and numbered within each range. Only the groups at a range's two ends can
    go on in others: of those the driver gets one row a range. Nulls come first.
    ``df`` is read more than once: give a written table.
    """
    tables, n = Tables(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    at = dealt.columns.index(group)
    schema = T.StructType([*dealt.schema, T.StructField("_run", T.LongType()), T.StructField("_step", T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, step = None, -1, 0  # the group before as an array of one, its number, its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(at)
            before = pa.concat_arrays([g.slice(0, 1) if last is None else last, g.slice(0, len(g) - 1)])
            both = pc.and_(pc.is_null(g), pc.is_null(before))
            new = ~pc.or_(both, pc.fill_null(pc.equal(g, before), False)).to_numpy(zero_copy_only=False)
            new[0] |= last is None
            i = np.arange(len(g), dtype=np.int64)
            begun = np.maximum.accumulate(np.where(new, i, -1 - step))
            runs = run + np.cumsum(new)
            steps = i - begun + np.where(begun < 0, -1, 0)
            last, run, step = g.slice(len(g) - 1, 1), int(runs[-1]), int(steps[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(steps)], names=schema.names)

    made = tables.write(dealt.mapInArrow(numbered, schema), "ranked")
    ends = made.groupBy("_part").agg(
        F.min(F.struct(col(group))).alias("low"),
        F.max(F.struct(col(group))).alias("high"),
        F.max("_run").alias("run"),
        F.max(F.when(F.col("_run") == 0, F.col("_step"))).alias("first"),
        F.max(F.struct("_run", "_step"))["_step"].alias("last"),
        F.max("_step").alias("longest"),
    )
    rows, tree, place, held, largest = [], -1, 0, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        goes_on = held is not None and tuple(r["low"]) == held
        tree, place = (tree, place) if goes_on else (tree + 1, 0)
        rows.append((r["_part"], tree, place))
        largest = max(largest, r["longest"] + 1, place + r["first"] + 1)
        place = place + r["last"] + 1 if r["run"] == 0 else r["last"] + 1
        tree, held = tree + r["run"], tuple(r["high"])
    bases = df.sparkSession.createDataFrame(rows, "_part int, _tree long, _place long")
    joined = made.join(F.broadcast(bases), "_part")  # a row a range
    out = joined.withColumn("tree", F.col("_tree") + F.col("_run")).withColumn(
        "place", F.col("_step") + F.when(F.col("_run") == 0, F.col("_place")).otherwise(0)
    )
    return out.drop("_part", "_run", "_step", "_tree", "_place"), tree + 1, largest


def unwrapped_with(df: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """As ``unwrapped``, with these columns of ``df`` in the place of any of ``docs`` of their names."""
    kept = (F.col("doc")[c].alias(c) for c in docs.columns if c not in columns)
    return df.select(*kept, *columns)
