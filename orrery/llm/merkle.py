"""A Merkle manifest of a dataset, and the proof of every row by pointer jumping.

Rows are leaves: the digest of their fields. The leaves of a group (a source),
in order, and then the digests above them, go in runs of ``fan`` consecutive ones
into one digest each until one is left, the group's subroot; the subroots, in
order of their groups, likewise give the root. Digests are lower-case hex sha256
of what they cover, put together as text.

Ranks of rows come from a sort by ranges, so a group of a third of all rows is
work for a third of the tasks. A run is a row with its digests; the leaves stay
in the rows of their runs, which are all that takes part in the jumps.

Proofs: every node above the leaves starts with a segment, its siblings on the way
to its parent, left and right of it. A self-join by the ancestor reached so far
joins its segments and doubles the distance; after log2(height) rounds every
node has its path to the root, and each leaf that of its run, with the run's other
leaves before it. In the later rounds few rows are ancestors of very many: these
are broadcast if their rows, times what a path can be long, stay below
BROADCAST_BYTES, and else repeated under SALTS salts.

Defined results: an empty table has no rows; a null field counts as one; rows
of one group and order are put in order by their digests, so that repeated rows
make the same tree however they lie; a null group comes first, and null orders
come first in their group. Columns carried besides go into a struct: no name can
clash. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm import shared

FAN = 16
BROADCAST_BYTES = 8 << 20
SALTS = 64
_SEGMENT = "struct<left: string, right: string>"


def leaf(*fields: Column) -> Column:
    """The digest of fields: each ``-`` if null, else its bytes in UTF-8, ``:``, and itself."""
    texts = (f.cast("string") for f in fields)
    listed = (F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)
    return F.sha2(F.concat(*listed), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, as one text: level by level, left to right."""
    return F.concat_ws("", F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def _node(tree: Column, level: int | Column, place: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.alias("tree"), level.cast("int").alias("level"), place.alias("place"))


def _runs(nodes: DataFrame, fan: int, *more: str) -> DataFrame:
    """Each run of (tree, place, digest, ...): its nodes, and its digest. A first run of one is the whole tree: ``done``, and not hashed."""
    kids = F.array_sort(F.collect_list(F.struct("place", "digest", *more)))
    grouped = nodes.groupBy("tree", F.floor(F.col("place") / fan).cast("long").alias("run")).agg(kids.alias("kids"))
    done = (F.col("run") == 0) & (F.size("kids") == 1)
    whole = F.concat_ws("", F.col("kids.digest"))
    digest = F.when(done, F.col("kids")[0]["digest"]).otherwise(F.sha2(whole, 256))
    return grouped.select("tree", F.col("run").alias("place"), digest.alias("digest"), done.alias("done"), "kids")


def _height(n: int, fan: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def _beside(kids: Column, i: Column) -> Column:
    """The segment of the i-th of a run."""
    digests = F.transform(kids, lambda k: k["digest"])
    left = F.concat_ws("", F.slice(digests, F.lit(1), i))
    right = F.concat_ws("", F.slice(digests, i + 2, F.size(kids)))
    return F.struct(left.alias("left"), right.alias("right"))


def _first_steps(runs: DataFrame, level: int, node: Column) -> DataFrame:
    """(node, ancestor, segments, subroot) of the nodes of runs, to their parents."""
    out = runs.where(~F.col("done")).select("tree", "place", "kids", F.posexplode("kids").alias("i", "kid"))
    return out.select(
        node.alias("node"),
        _node(F.col("tree"), level, F.col("place")).alias("ancestor"),
        F.array(_beside(F.col("kids"), F.col("i"))).alias("segments"),
        F.when(F.col("tree") == -1, F.col("kid.digest") if level == 1 else F.lit(None)).cast("string").alias("subroot"),
    )


def _jumped(steps: DataFrame, distance: int, fan: int) -> DataFrame:
    """Twice the distance: each row with the segments of its ancestor's row."""
    far = steps.where((F.col("node.tree") == -1) | (F.col("node.level") > distance)).select(
        F.col("node").alias("ancestor"),
        F.col("ancestor").alias("_ancestor"),
        F.col("segments").alias("_segments"),
        F.col("subroot").alias("_subroot"),
    )
    keys, near = ["ancestor"], steps
    if far.count() * distance * (fan - 1) * 64 <= BROADCAST_BYTES:
        far = F.broadcast(far)
    elif distance > 2:  # an ancestor of very many: fan to the power of the distance
        near = near.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        far = far.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keys = ["ancestor", "_salt"]
    return near.join(far, keys, "left").select(
        "node",
        F.coalesce("_ancestor", "ancestor").alias("ancestor"),
        F.concat("segments", F.coalesce("_segments", F.array().cast(f"array<{_SEGMENT}>"))).alias("segments"),
        F.coalesce("subroot", "_subroot").alias("subroot"),
    )


def proofs(
    docs: DataFrame, fields: Sequence[str], group: str, order: str, carried: Mapping[str, Column] | None = None, fan: int = FAN
) -> DataFrame:
    """Each row's ``leaf``, ``subroot``, ``root`` and ``proof`` (segments of left and right siblings, from the leaf on), with ``carried``.

    ``carried`` are expressions over ``docs``; without it, all columns are carried, in the struct ``doc``.
    """
    spark = docs.sparkSession
    tables = shared.Tables(spark)
    doc = F.struct(*(c.alias(n) for n, c in (carried or {}).items())) if carried else F.struct(*map(shared.col, docs.columns))
    leaves = docs.select(
        shared.col(group).alias("group"),
        shared.col(order).alias("order"),
        leaf(*map(shared.col, fields)).alias("digest"),
        doc.alias("doc"),
        F.monotonically_increasing_id().alias("row"),  # so that very many equal rows can be dealt out
    )
    leaves = tables.write(leaves, "leaves")
    placed, n_trees, largest = shared.ranked(leaves, "group", "order", "digest", "row")
    # the bottom, with the leaves themselves
    bottom = tables.write(_runs(placed, fan, "doc"), "runs")
    tables.drop(leaves)
    steps, level, done = [], bottom, []
    for k in range(1, _height(largest, fan) + 1):
        done.append(level.where("done").select("tree", "digest", F.lit(k - 1).alias("level")))
        level = tables.write(_runs(level.where(~F.col("done")).select("tree", "place", "digest"), fan), "runs")
        steps.append(_first_steps(level, k + 1, _node(F.col("tree"), k, F.col("kid.place"))))
    done.append(level.where("done").select("tree", "digest", F.lit(_height(largest, fan)).alias("level")))
    subroots = done[0]
    for d in done[1:]:
        subroots = subroots.unionByName(d)
    top = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), "digest", "level")
    top = tables.write(_runs(top, fan, "level"), "runs")
    steps.append(_first_steps(top, 1, _node(F.col("kid.place"), F.col("kid.level"), F.lit(0).cast("long"))))
    for k in range(1, _height(n_trees, fan)):
        top = tables.write(_runs(top.select("tree", "place", "digest"), fan), "runs")
        steps.append(_first_steps(top, k + 1, _node(F.col("tree"), k, F.col("kid.place"))))
    root = F.lit(next((r["digest"] for r in top.select("digest").take(1)), None)).cast("string")
    paths = steps[0]
    for s in steps[1:]:
        paths = paths.unionByName(s)
    paths = tables.write(paths, "paths")
    distance = 1
    while distance < max(0, _height(largest, fan) - 1) + _height(n_trees, fan):
        longer = tables.write(_jumped(paths, distance, fan), "paths")
        tables.drop(paths)
        paths, distance = longer, distance * 2
    tables.keep_only(bottom, paths)
    own = F.when(F.col("done"), _node(F.col("tree"), 0, F.lit(0).cast("long"))).otherwise(_node(F.col("tree"), 1, F.col("place")))
    found = bottom.withColumn("node", own).join(paths, "node", "left")
    none = F.array().cast(f"array<{_SEGMENT}>")
    found = found.select("done", "kids", F.coalesce("segments", none).alias("above"), F.coalesce("subroot", root).alias("subroot"))
    each = found.select("done", "kids", "above", "subroot", F.posexplode("kids").alias("i", "kid"))
    first = F.when(F.col("done"), none).otherwise(F.array(_beside(F.col("kids"), F.col("i"))))
    return each.select(
        *(F.col("kid.doc")[n].alias(n) for n in carried or ()),
        *([] if carried else [F.col("kid.doc").alias("doc")]),
        F.col("kid.digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.concat(first, "above").alias("proof"),
    )
