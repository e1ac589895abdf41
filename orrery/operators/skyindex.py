"""A stored index of which sky pixels the regions of an element's records overlap.

One row for each record and pixel of a depth, in Parquet, in folders by coarse pixel and in
order within them: a constraint reads the folders and row groups of its own pixels
only. Writes change the folders that the changed regions touch, before or
after: a record whose region stays as it is costs nothing, and one that is replaced or
deleted leaves no row behind. A write is not atomic: it replaces folder by folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.functions import pixels as px
from orrery.functions.region import Region

DEPTH = 7
#: Folders are pixels of this depth: 128.
COARSE = 2


def overlap_rows(records: DataFrame, keys: list[str], depth: int = DEPTH, region: str = "region") -> DataFrame:
    """(keys, pixel) of every pixel that a record's region may overlap; none of records without a region."""
    return records.select(*keys, F.explode(px.envelope(f"`{region}`", depth)).alias("pixel"))


def pixels_of(spark: SparkSession, region: Region, depth: int) -> list[tuple[int, int]]:
    """Ranges of the pixels of one region, on the driver: at most 8 * 4^depth pixels."""
    found = spark.range(1).select(px.envelope(region.sql(), depth).alias("p")).first()["p"]
    return px.ranges(found)


def region_union(df: DataFrame, keys: list[str], depth: int = DEPTH, region: str = "region") -> DataFrame:
    """(keys, first, last): what the regions of a group cover together, as ranges of pixels.

    Pixels are made distinct before the shuffle, and a group is dealt out by coarse pixels,
    within which ranges are joined.
    """
    from pyspark.sql import Window

    coarse = min(COARSE, depth)
    rows = overlap_rows(df, keys, depth, region).distinct().withColumn("_coarse", px.parent(F.col("pixel"), depth - coarse))
    before = F.lag("pixel").over(Window.partitionBy(*keys, "_coarse").orderBy("pixel"))
    starts = F.sum(F.when(before == F.col("pixel") - 1, 0).otherwise(1)).over(Window.partitionBy(*keys, "_coarse").orderBy("pixel"))
    return rows.withColumn("_run", starts).groupBy(*keys, "_coarse", "_run").agg(
        F.min("pixel").alias("first"), F.max("pixel").alias("last")
    ).drop("_coarse", "_run")


@dataclass(frozen=True)
class SkyIndex:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    depth: int = DEPTH

    @classmethod
    def build(cls, records: DataFrame, keys: list[str], path: str, depth: int = DEPTH, region: str = "region") -> SkyIndex:
        if depth < COARSE:
            raise ValueError(f"an index has a depth of {COARSE} at least")
        rows = overlap_rows(records, keys, depth, region)
        out = cls(records.sparkSession, path, tuple(keys), rows.schema, depth)
        out._write(rows, path)
        return out

    def _write(self, rows: DataFrame, path: str) -> None:
        """By ranges of pixels, so that a crowded folder is written by many tasks, each in order."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.withColumn("coarse", px.parent(F.col("pixel"), self.depth - COARSE).cast("int"))
        placed = placed.repartitionByRange(n, "pixel", *self.keys).sortWithinPartitions("coarse", "pixel")
        placed.write.partitionBy("coarse").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    def frame(self) -> DataFrame:
        """(keys, pixel, coarse)."""
        read = T.StructType([*self.schema, T.StructField("coarse", T.IntegerType())])
        return self.spark.read.schema(read).parquet(self.path)

    def near(self, region: Region) -> DataFrame:
        """The keys of records that may overlap a region: all that do."""
        found = pixels_of(self.spark, region, self.depth)
        shift = 2 * (self.depth - COARSE)
        folders = sorted({c for low, high in found for c in range(low >> shift, (high >> shift) + 1)})
        rows = self.frame().where(F.col("coarse").isin(folders)).where(px.among(F.col("pixel"), found))
        return rows.select(*self.keys).distinct()

    def put(self, records: DataFrame, before: DataFrame | None = None, region: str = "region") -> None:
        """The rows of these records in place of those of their keys. Records whose region is as it was in ``before`` are left alone."""
        new = records.select(*self.keys, F.col(region).alias("_new"))
        if before is not None:
            old = before.select(*self.keys, F.col(region).alias("_old"), F.lit(True).alias("_there"))
            joined = new.join(old, list(self.keys), "left")
            new = joined.where(F.col("_there").isNull() | ~F.col("_new").eqNullSafe(F.col("_old"))).drop("_old", "_there")
        self._change(new.select(*self.keys), overlap_rows(new, list(self.keys), self.depth, "_new"))

    def remove(self, keys: DataFrame) -> None:
        self._change(keys.select(*self.keys), None)

    def _change(self, gone: DataFrame, more: DataFrame | None) -> None:
        """All rows of the keys ``gone`` go, and ``more`` come: in the folders of either."""
        keys, held = list(self.keys), self.frame()
        staged = f"{self.path}.staged-{uuid.uuid4().hex}"
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            gone.distinct().write.parquet(f"{staged}/gone")
            gone = self.spark.read.schema(gone.schema).parquet(f"{staged}/gone")
            touched = held.join(gone, keys, "left_semi").select("coarse")
            if more is not None:
                more.write.parquet(f"{staged}/more")
                more = self.spark.read.schema(more.schema).parquet(f"{staged}/more")
                touched = touched.unionByName(more.select(px.parent(F.col("pixel"), self.depth - COARSE).cast("int").alias("coarse")))
            folders = [r["coarse"] for r in touched.distinct().collect()]  # at most 8 * 4^COARSE
            if not folders:
                return
            kept = held.where(F.col("coarse").isin(folders)).join(gone, keys, "left_anti").drop("coarse")
            rows = kept if more is None else kept.unionByName(more)
            rows.write.parquet(f"{staged}/rows")
            rows = self.spark.read.schema(self.schema).parquet(f"{staged}/rows")
            left = {r["c"] for r in rows.select(px.parent(F.col("pixel"), self.depth - COARSE).alias("c")).distinct().collect()}
            self._write(rows, self.path)
            for c in set(folders) - left:  # an empty folder is not overwritten
                fs.delete(fs_path(f"{self.path}/coarse={c}"), True)
        finally:
            fs.delete(fs_path(staged), True)
