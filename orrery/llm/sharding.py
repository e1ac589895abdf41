"""Sharding by a k-d tree over metadata.

A node that stands for k shards is split where k//2 of them have their bytes to
the left, at a weighted quantile along its box's widest dimension (each dimension
is scaled to its range over all rows). Quantiles are found by histograms: over
the box, then over the bin that holds the quantile, until that bin weighs hardly
anything or can't be divided. All nodes of a level are split together. The rows are
written once; a task finds a row's node by going down the cuts so far, which it
gets by broadcast. Cuts, boxes and what is left of shards are arrays of a few numbers a shard, on
the driver, of MAX_SHARDS at most; histograms stay in Spark, and of each a node's row comes back.

The dimensions depend on text and language only, and rows of equal metadata are
told apart by a hash of the text, which is added to each dimension as a
thousandth of its range: copies of a text stay together. Groups of copies that
weigh more than ``heavy_share`` of a shard would make shards unequal; they are
given to shards whole, the largest first, back and forth, and the tree deals out
the rest by what is left of each shard. Only copies that can't fit, as they weigh
more than a shard or find none with room, are told apart by their ids, and dealt
out by the tree like other rows. Of heavy groups there are at most
shards / heavy_share.

Defined results: a null text has no bytes; every row counts ``overhead`` bytes
besides its text; rows that are equal in everything stay together unless they
can't fit; an empty table gives no rows; with fewer rows than shards some shards
are empty; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from orrery.llm import shared

BINS = 2048
SPREAD = 1e-3
HEAVY_SHARE = 0.05
#: Of a shard: the bytes by which a cut may miss its place.
TOLERANCE = 0.002
#: Their cuts are broadcast, at 20 bytes each.
MAX_SHARDS = 1 << 22
DIMS = range(3)


def _pinned(t: shared.Tables, groups: DataFrame, n: int, target: float) -> DataFrame:
    """digest and shard of heavy groups (digest, bytes); shard is null for those that don't fit."""
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), "digest")) - 1  # at most n / heavy_share rows
    fits = groups.where(F.col("bytes") <= target).withColumn("r", rank)
    place = F.col("r") % n
    dealt = fits.withColumn("to", F.when(F.floor(F.col("r") / n) % 2 == 0, place).otherwise(n - 1 - place).cast("int"))
    filled = F.sum("bytes").over(Window.partitionBy("to").orderBy("r"))
    fit = dealt.select("digest", "bytes", F.when(filled <= target, F.col("to")).alias("shard"))
    return t.write(fit.unionByName(groups.where(F.col("bytes") > target).withColumn("shard", F.lit(None).cast("int"))), "heavy")


@dataclass
class Tree:
    """Cuts by node: the children of node k are 2 k and 2 k + 1; ``dim`` is -1 where there is no cut. ``shard`` is that of a leaf."""

    dim: np.ndarray
    cut: np.ndarray
    shard: np.ndarray

    @classmethod
    def of(cls, n: int) -> Tree:
        size = 2 << max(0, (n - 1).bit_length())
        return cls(np.full(size, -1, dtype=np.int8), np.zeros(size), np.zeros(size, dtype=np.int32))

    def nodes_of(self, y: np.ndarray) -> np.ndarray:
        """The nodes that rows, with a column for each dimension, come down to."""
        node = np.ones(len(y), dtype=np.int64)
        while len(y):
            dim = self.dim[node]
            on = np.flatnonzero(dim >= 0)
            if not len(on):
                break
            right = y[on, dim[on]] >= self.cut[node[on]]
            node[on] = node[on] * 2 + right
        return node


def _places(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"y{d}").to_numpy(zero_copy_only=False) for d in DIMS], axis=1)


@dataclass
class Open:
    """A node that is to be cut: its dimension and range, the share of its bytes that goes left, and the bytes wanted there."""

    dim: int
    low: float
    high: float
    share: float
    want: float | None = None


def _cuts(points: DataFrame, tree: Tree, nodes: dict[int, Open], tolerance: float) -> dict[int, float]:
    """Where ``share`` of each node's bytes lie below. ``tolerance``: bytes."""
    spark, done, todo = points.sparkSession, {}, dict(nodes)
    while todo:
        zoom = np.full((len(tree.dim), 3), np.nan)
        for k, o in todo.items():
            zoom[k] = o.dim, o.low, o.high
        sent = spark.sparkContext.broadcast((tree, zoom))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, ranges = sent.value
            for batch in batches:
                y = _places(batch)
                node = held.nodes_of(y)
                on = np.flatnonzero(~np.isnan(ranges[node, 0]))
                at = node[on]
                low, high = ranges[at, 1], ranges[at, 2]
                v = y[on, ranges[at, 0].astype(np.int64)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    part = np.nan_to_num(np.floor((v - low) / (high - low) * BINS), nan=0.0, posinf=0.0, neginf=0.0)
                # what rounding puts outside of the bin that was zoomed into counts as before or behind it
                part = np.where(v < low, -1, np.where(v >= high, BINS, np.clip(part, 0, BINS - 1)))
                size = batch.column("size").to_numpy(zero_copy_only=False)[on]
                columns = [pa.array(at), pa.array(part.astype(np.int32)), pa.array(size), pa.array(v)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "bin", "size", "v"])

        bins = points.select("size", *(f"y{d}" for d in DIMS)).mapInArrow(binned, "node long, bin int, size long, v double")
        bins = bins.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("least"), F.max("v").alias("most"))
        wants = [(k, o.share, o.want) for k, o in todo.items()]
        wants = F.broadcast(spark.createDataFrame(wants, "node long, share double, want double"))  # of MAX_SHARDS at most
        own = Window.partitionBy("node")  # of BINS + 2 rows at most
        summed = bins.withColumn("upto", F.sum("bytes").over(own.orderBy("bin"))).withColumn("total", F.sum("bytes").over(own))
        summed = summed.join(wants, "node").withColumn("want", F.coalesce("want", F.col("total") * F.col("share")))
        # the first bin that reaches the place, or else the last
        inner = F.col("bin").between(0, BINS - 1)
        row = F.struct("bin", "bytes", "upto", "least", "most")
        best = summed.groupBy("node").agg(
            F.min(F.when(inner & (F.col("upto") >= F.col("want")), row)).alias("first"),
            F.max(F.when(inner, row)).alias("last"),
            F.first("want").alias("want"),
        )
        found = {r["node"]: r for r in best.collect()}  # a row a node
        sent.unpersist()
        for k, o in list(todo.items()):
            b = k in found and (found[k]["first"] or found[k]["last"])
            if not b:  # nothing in its range: cut in the middle
                done[k] = (o.low + o.high) / 2
                del todo[k]
                continue
            o.want, width = found[k]["want"], (o.high - o.low) / BINS
            low, high = o.low + width * b["bin"], o.low + width * (b["bin"] + 1)
            if b["bytes"] <= tolerance or b["least"] == b["most"] or low >= high or width <= 0:
                behind = o.want > b["upto"] - b["bytes"] / 2  # cut at the edge of the bin that is nearer
                done[k] = b["most"] + abs(b["most"]) * 1e-15 + 1e-300 if behind else b["least"]
                del todo[k]
            else:
                o.low, o.high = low, high
    return done


def dealt(t: shared.Tables, points: DataFrame, caps: DataFrame, n: int, target: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``points`` (size, y0, y1, y2 and more) with their shard; ``caps``: shard, cap (the bytes it may take)."""
    if n > MAX_SHARDS:
        raise ValueError(f"at most {MAX_SHARDS} shards are made at once")
    found = points.agg(*(f(f"y{d}") for d in DIMS for f in (F.min, F.max))).first()
    box = [(found[2 * d] or 0.0, (found[2 * d + 1] or 0.0)) for d in DIMS]
    scale = [max(1e-12, high - low) for low, high in box]
    room = np.zeros(n)
    for r in caps.collect():  # a row a shard
        room[r["shard"]] = r["cap"]
    tree = Tree.of(n)
    level = {1: (0, n, [(low, high + abs(high) * 1e-9 + 1e-9) for low, high in box])}
    while level:
        nodes: dict[int, Open] = {}
        for k, (first, parts, ends) in level.items():
            if parts == 1:
                tree.shard[k] = first
                continue
            total, left = float(room[first : first + parts].sum()), float(room[first : first + parts // 2].sum())
            # the first of the widest dimensions; the last bits of a width, from the box's open upper end, don't count
            dim = max(DIMS, key=lambda d: round((ends[d][1] - ends[d][0]) / scale[d], 6))
            nodes[k] = Open(dim, *ends[dim], left / total if total else 0.5)
        cuts = _cuts(points, tree, nodes, tolerance * target)
        below = {}
        for k, cut in cuts.items():
            first, parts, ends = level[k]
            dim = nodes[k].dim
            tree.dim[k], tree.cut[k] = dim, cut
            for side, (at, m) in enumerate(((first, parts // 2), (first + parts // 2, parts - parts // 2))):
                new = (ends[dim][0], cut) if side == 0 else (cut, ends[dim][1])
                below[2 * k + side] = (at, m, [*ends[:dim], new, *ends[dim + 1 :]])
        level = below
    sent = points.sparkSession.sparkContext.broadcast(tree)
    at = T.StructType([*points.schema, T.StructField("shard", T.IntegerType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = sent.value.shard[sent.value.nodes_of(_places(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=at.names)

    return points.mapInArrow(placed, at)


def numbered(rows: DataFrame, group: str, order: Sequence[str], n_rows: int, per_task: int = 100_000) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each group, without a task that holds a whole group.

    Rows are ranked within cells of a group, by a hash of their order; the cells'
    sizes are summed up to where each begins.
    """
    cells = max(1, n_rows // per_task)
    cell = rows.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    ranked = cell.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)).cast("long") - 1
    )
    up_to = F.sum("_n").over(Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    begins = (
        cell.groupBy(group, "_cell")
        .agg(F.count("*").alias("_n"))
        .select(group, "_cell", F.coalesce(up_to, F.lit(0)).alias("_begin"))
    )
    return (
        ranked.join(begins, [group, "_cell"])
        .withColumn("slot", F.col("_rank") + F.col("_begin"))
        .drop("_cell", "_rank", "_begin")
    )


def shard(
    docs: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    overhead: int = 8,
    heavy_share: float = HEAVY_SHARE,
) -> DataFrame:
    """A row for each document: id_col, size, text_crc32, shard and slot.

    Give the number of shards, or the bytes that a shard should come near.
    """
    t = shared.Tables(docs.sparkSession)
    text = F.coalesce(shared.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    base = t.write(
        docs.select(
            shared.col(id_col).alias("id"),
            (size + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shared.key_of(text.cast("binary")).alias("digest"),
            F.log2(size + F.lit(1.0)).alias("x0"),
            (size / F.greatest(F.length(text), F.lit(1))).cast("double").alias("x1"),
            (F.pmod(F.xxhash64(shared.col(lang_col)), F.lit(1 << 20)) / (1 << 20) if lang_col else F.lit(0.0)).alias("x2"),
        ),
        "sizes",
    )
    n_rows, total, *wide = base.agg(
        F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), *(F.max(f"x{d}") - F.min(f"x{d}") for d in DIMS)
    ).first()
    n = n_shards or max(1, round(total / target_bytes))
    target = total / n
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("c"))
    heavy = _pinned(t, groups.where((F.col("bytes") > heavy_share * target) & (F.col("c") > 1)).select("digest", "bytes"), n, target)
    fraction = lambda *c: F.pmod(F.xxhash64(F.lit(7), *c), F.lit(1 << 40)) / (1 << 40)
    tie = F.when(F.col("bytes").isNotNull(), fraction("id", "digest")).otherwise(fraction("digest"))
    all_rows = base.join(heavy, "digest", "left")
    points = all_rows.where("shard IS NULL").select(
        "id", "size", "text_crc32", *((F.col(f"x{d}") + tie * (SPREAD * max(wide[d] or 0.0, 1e-6))).alias(f"y{d}") for d in DIMS)
    )
    points = t.write(points, "points")
    taken = heavy.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("bytes").alias("taken"))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    caps = every.join(taken, "shard", "left").select("shard", F.greatest(F.lit(0.0), F.lit(target) - F.coalesce("taken", F.lit(0))).alias("cap"))
    placed = dealt(t, points, caps, n, target).select("id", "size", "text_crc32", "shard")
    placed = t.write(placed.unionByName(all_rows.where("shard IS NOT NULL").select("id", "size", "text_crc32", "shard")), "placed")
    t.keep_only(placed)
    out = numbered(placed, "shard", ["id", "text_crc32", "size"], n_rows)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
