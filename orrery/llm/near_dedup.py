"""Near-duplicate documents by bottom-k sketches.

A document's set is the distinct hashes of its five-word shingles; documents of
equal sets (by 128 bits) are one set from then on. The sketch of a set is its
smallest hashes: ``k`` of them, or the share of the set that makes candidates
certain if that is more (twice what a similar set may lack). Two similar sets
then share at least ``least_shared`` values of their sketches, so in any order
of values the first that they share has that many of each sketch from it on. The
order taken is from the rarest value to the commonest: only those with enough
after them go to the inverted lists, and values that very many documents hold
are looked up only by documents that hold hardly anything else.

Pairs come from the lists in rounds. In the first, each set meets one other, the
one in its lists with fewest shingles of its own; what is confirmed joins
components. Then the pairs of a list that are in different components are left:
those of sets outside of its largest component with any other. While these are
very many and each round leaves half of them or less, another round of single
partners is taken before them. At last the sets that are open meet all in the
lists of their largest component. A group of near copies that hang together so
costs its size and not its square, and no pair that could be similar is left
out. Sets of pairs meet in cells of bounded size, where pairs are filtered by the
sketch of their union (if it shows more values that one has and the other lacks
than a similar pair can have, they aren't), and confirmed on full sets. What
stays quadratic are sets of one list of which no two are linked although they
share all that is rare of them; it is spread over cells. Components come from
alternating star contractions. The driver gets counts, and a filter of bounded
size.

Defined results: words are runs of bytes other than ASCII white space, A-Z as
a-z; a null or empty text, or one without words, has no shingles and is linked
with nothing; rows that repeat a text are linked; a null id is never the
smallest of a component unless all its ids are null; an empty table gives an
empty table; ``link`` carries only the id, ``representatives`` all columns,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.llm import rolling, shared

SHINGLE = 5
SKETCH = 64
BLOCK = 1 << 20
#: Another round of single partners is taken while pairs are more than so many times the entries of the lists.
DENSE = 64
#: Sets of both sides of a cell.
OPEN, BESIDE = 256, 512
#: Edges that one task of the star contractions takes at least.
EDGES = 100_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = rolling.TABLE.copy()
_LOWER[65:91] = _LOWER[97:123]
_MULTIPLIERS = np.random.default_rng(0xC0FFEE).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of each word (maximal run of bytes other than ASCII white space), A-Z as a-z."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end]]:  # a word isn't cut
            gap = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK)
        part = data[at:end]
        inside = np.concatenate(([False], ~_SPACE[part], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(rolling.Hashed(part, _LOWER).of(edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(data: np.ndarray) -> np.ndarray:
    """The distinct hashes, in order, of five words in a row; of all words if they are fewer; none without words."""
    words = word_hashes(data)
    n = min(SHINGLE, len(words))
    if not n:
        return words.view(np.int64)
    count = len(words) - n + 1
    h = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        h += words[k : k + count] * _MULTIPLIERS[k]
    return np.unique(rolling.mixed(h).view(np.int64))


def sketch_size(n: int, percent: int, k: int = SKETCH) -> int:
    """How many of its smallest values stand for a set of ``n``."""
    return min(n, max(k, -(-2 * (100 - percent) * n // 100)))


def must_share(a: int, b: int, percent: int) -> int:
    """How many shingles sets of sizes ``a`` and ``b`` share at least if they are similar."""
    return -(-percent * (a + b) // (100 + percent))


def least_shared(a: int, b: int, percent: int, k: int = SKETCH) -> int:
    """How many values the sketches of similar sets of sizes ``a`` and ``b`` share at least; 1 or more.

    Of the sketch that reaches less far, only what the other set lacks isn't in the other sketch.
    """
    return must_share(a, b, percent) + min(sketch_size(a, percent, k) - a, sketch_size(b, percent, k) - b)


def _must_share(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def sketched(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int = SKETCH) -> DataFrame:
    """id, text_key, n, set_key (equal for equal sets; null without shingles) and sketch of each document."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            *T.StructType.fromDDL("text_key binary, n long, set_key binary, sketch array<long>").fields,
        ]
    )
    arrow = to_arrow_schema(schema)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, sets, lows, offsets = [], [], [], [0]
                for value in part.column("text"):
                    found = shingles(np.frombuffer(value.as_buffer(), dtype=np.uint8))
                    sizes.append(len(found))
                    sets.append(hashlib.blake2b(found, digest_size=16).digest() if len(found) else None)
                    lows.append(found[: sketch_size(len(found), percent, k)])
                    offsets.append(offsets[-1] + len(lows[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").cast(arrow.field("id").type),
                        part.column("text_key"),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(sets, type=pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(np.concatenate(lows))),
                    ],
                    schema=arrow,
                )

    text = shared.text_of(text_col)
    rows = docs.select(shared.col(id_col).alias("id"), shared.key_of(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(sketch, schema)


def _full_sets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """set_id and all shingles of the sets in ``wanted`` (set_id, text_key): one text for each is hashed again."""
    text = shared.text_of(text_col)
    texts = docs.select(shared.key_of(text).alias("text_key"), text.alias("text"))
    one = shared.likely(texts, wanted, "text_key").dropDuplicates(["text_key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(np.frombuffer(t.as_buffer(), dtype=np.uint8)) for t in part.column("text")]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))],
                    names=["set_id", "shingles"],
                )

    return one.join(wanted, "text_key").select("set_id", "text").mapInArrow(hashed, "set_id long, shingles array<long>")


def spread(df: DataFrame, rows: int):
    """What writes tables of up to so many rows by as many tasks as they need, not by one for each shuffle partition."""
    n = max(1, rows // EDGES)
    return (lambda x: x.coalesce(n)) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda x: x)


def components(edges: DataFrame, tables: shared.Tables | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, as one of ``tables``.

    Alternates large-star and small-star steps until neither changes an edge; a
    step is an aggregation and a join of the edges, and reads a table of its own.
    """
    t = shared.Tables(edges.sparkSession)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
    now = t.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = mark(now)
    most = spread(now, before[0])
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = t.write(most(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), "least")
        large = t.write(
            most(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "large"
        )
        lower = t.write(most(large.groupBy("u").agg(F.min("v").alias("m"))), "lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, t.write(most(small), "small")
        t.drop(last, least, large, lower)
        after = mark(now)
        if after == before:
            break
        before = after
    out = (tables or t).write(
        now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
            now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        ),
        "components",
    )
    t.keep_only(out)
    return out


def _lists(t: shared.Tables, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The inverted lists: value, set_id, n, slack (of the sketch, less n), left and own.

    ``left`` counts the values of the sketch from this one on, from rare to common; ``own`` is the share of values
    that no other sketch holds.
    """
    values = sets.select(F.explode("sketch").alias("value"))
    common = t.write(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "common")
    known = shared.Filter.of(common.select("value"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sketch = part.column("sketch")
                sizes, values = sketch.value_lengths().to_numpy(), sketch.flatten().to_numpy()
                kept = known.test(values)
                row = pa.array(np.repeat(np.arange(len(sizes)), sizes)[kept])
                yield pa.RecordBatch.from_arrays(
                    [part.column("set_id").take(row), part.column("n").take(row), pa.array(sizes.astype(np.int64)).take(row), pa.array(values[kept])],
                    names=["set_id", "n", "s", "value"],
                )

    ranked = (
        sets.select("set_id", "n", "sketch")
        .mapInArrow(likely, "set_id long, n long, s long, value long")
        .join(common, "value")
        .groupBy("set_id", "n", "s")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("listed"))
    )
    n, slack = F.col("n"), F.col("s") - F.col("n")
    most = F.floor(100 * n / percent)
    fewest = F.ceil(percent * n / 100)
    # at the sizes a partner may have, at the ends of which it is least; two less for what is rounded between them
    need = F.least(
        _must_share(n, n, percent) + slack,
        _must_share(n, most, percent) + F.least(most, F.greatest(F.lit(k), F.ceil(2 * (100 - percent) * most / 100))) - most,
        _must_share(n, fewest, percent) + slack,
    ) - 2
    size = F.size("listed")
    kept = ranked.withColumn("take", (size - F.greatest(need, F.lit(1)) + 1).cast("int")).where("take > 0")
    first = F.slice("listed", F.lit(1), F.col("take"))
    return t.write(
        kept.select(
            "set_id", "n", slack.alias("slack"), size.alias("m"), (1 - size / F.col("s")).alias("own"), F.posexplode(first).alias("pos", "v")
        ).select(F.col("v.value").alias("value"), "set_id", "n", "slack", (F.col("m") - F.col("pos")).alias("left"), "own"),
        "lists",
    )


def _may_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether entries a and b of a list may be the first value that similar sets share."""
    c = lambda x, name: F.col(f"{x}.{name}")
    sizes = 100 * F.least(c(a, "n"), c(b, "n")) >= percent * F.greatest(c(a, "n"), c(b, "n"))
    need = _must_share(c(a, "n"), c(b, "n"), percent) + F.least(c(a, "slack"), c(b, "slack"))
    return sizes & (need <= F.least(c(a, "left"), c(b, "left")))


_EDGES = "a long, b long"


def _tested(percent: int, k: int):
    """The links between the sets of both sides of a cell: as few as keep them connected."""

    def test(table: pa.Table) -> pa.Table:
        ids, side, shingled = (table.column(c).combine_chunks() for c in ("set_id", "side", "shingles"))
        ids, side = ids.to_numpy(), side.to_numpy()
        flat, ends = shingled.flatten().to_numpy(), np.cumsum(shingled.value_lengths().to_numpy())
        sets = np.split(flat, ends[:-1])
        own = [i for i in np.argsort(ids, kind="stable").tolist() if side[i] == 0]
        edges: list[tuple[int, int]] = []
        if own:
            n_own = np.array([len(sets[i]) for i in own])
            s_own = np.array([sketch_size(n, percent, k) for n in n_own.tolist()])
            upto = np.array([sets[i][s - 1] if s < len(sets[i]) else np.iinfo(np.int64).max for i, s in zip(own, s_own.tolist(), strict=True)])

            def indexed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                values = np.concatenate(parts)
                order = np.argsort(values, kind="stable")
                return values[order], np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]

            def shared_with(index: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
                lo, hi = np.searchsorted(index[0], x, "left"), np.searchsorted(index[0], x, "right")
                c = hi - lo
                at = np.repeat(lo - (np.cumsum(c) - c), c) + np.arange(c.sum())
                return np.bincount(index[1][at], minlength=len(own))

            sketches = indexed([sets[i][:s] for i, s in zip(own, s_own.tolist(), strict=True)])
            whole = indexed([sets[i] for i in own])
            root = list(range(len(ids)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for j in np.argsort(ids, kind="stable").tolist():
                x = sets[j]
                s, n = sketch_size(len(x), percent, k), len(x)
                # up to where both sketches reach they hold all of their sets: what one lacks there, it lacks
                end = np.minimum(upto, x[s - 1] if s < n else np.iinfo(np.int64).max)
                both, need = shared_with(sketches, x[:s]), -(-percent * (n_own + n) // (100 + percent))
                seen_x = np.searchsorted(x[:s], end, "right")
                seen_own = np.array([np.searchsorted(sets[i][:m], e, "right") for i, m, e in zip(own, s_own.tolist(), end, strict=True)])
                may = (both > 0) & (seen_x - both <= n - need) & (seen_own - both <= n_own - need)
                if not may.any():
                    continue
                common = shared_with(whole, x)
                for i in np.flatnonzero(may & (100 * common >= percent * (n_own + n - common))).tolist():
                    p, q = find(own[i]), find(j)
                    if p != q:
                        root[p] = q
                        edges.append((int(ids[own[i]]), int(ids[j])))
        columns = zip(*edges, strict=True) if edges else ((), ())
        return pa.table([pa.array(c, type=pa.int64()) for c in columns], names=["a", "b"])

    return test


class _Sets:
    """Full sets by set_id, of texts that are hashed again when they are asked for first."""

    def __init__(self, t: shared.Tables, docs: DataFrame, text_col: str, sets: DataFrame) -> None:
        self.t, self.docs, self.text_col, self.sets = t, docs, text_col, sets
        self.held: DataFrame | None = None

    def of(self, ids: DataFrame) -> DataFrame:
        new = ids if self.held is None else ids.join(self.held.select("set_id"), "set_id", "left_anti")
        wanted = self.t.write(new.join(self.sets.select("set_id", "text_key"), "set_id"), "wanted")
        if self.held is None or not wanted.isEmpty():
            made = self.t.write(_full_sets(self.docs, self.text_col, wanted), "full", compression="zstd")
            self.held = made if self.held is None else self.held.unionByName(made)
        self.t.drop(wanted)
        return self.held


def _confirmed(t: shared.Tables, full: _Sets, ends: DataFrame, percent: int, k: int) -> DataFrame:
    """Links (a, b) that connect what is similar between the two sides of each family: ``ends`` (family, set_id, side).

    The sets of a family meet in cells of bounded numbers of both sides, so a set is copied once for each cell and
    not for each pair. In a cell pairs are filtered by the sketch of their union, and confirmed on full sets.
    """
    ends = t.write(ends.distinct(), "ends")
    sets = full.of(ends.select("set_id").distinct())
    count = lambda side, most: F.ceil(F.count_if(F.col("side") == side) / most).cast("int")
    grid = t.write(ends.groupBy("family").agg(count(0, OPEN).alias("rows"), count(1, BESIDE).alias("cols")).where("rows > 0"), "grid")
    cell = lambda size: F.pmod(F.xxhash64("set_id"), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    dealt = ends.join(grid, "family")
    cells = dealt.where("side = 0").select("family", "set_id", "side", cell("rows").alias("i"), every("cols").alias("j")).unionByName(
        dealt.where("side = 1").select("family", "set_id", "side", every("rows").alias("i"), cell("cols").alias("j"))
    )
    held = cells.join(sets, "set_id").groupBy("family", "i", "j")
    out = t.write(held.applyInArrow(_tested(percent, k), _EDGES), "links")
    t.drop(ends, grid)
    return out


def _linked_sets(t: shared.Tables, docs: DataFrame, text_col: str, sets: DataFrame, percent: int, k: int, dense: int) -> DataFrame:
    """(node, root) for the sets that are linked to others."""
    lists = _lists(t, sets, percent, k)
    n_entries = lists.count()
    edges, found, before, full = None, None, None, _Sets(t, docs, text_col, sets)
    hubs = lists.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("own", "set_id", "n", "slack", "left")).alias("hub"))
    labelled = lists
    while True:
        hubs = t.write(hubs.where("size > 1").select("value", "hub.*"), "hubs")
        meet = labelled.alias("x").join(hubs.alias("h"), "value")
        meet = meet.where((F.col("x.set_id") != F.col("h.set_id")) & _may_be_similar("x", "h", percent))
        if found is not None:
            meet = meet.where(F.col("x.root") != F.col("h.root"))
        one = meet.groupBy(F.col("x.set_id").alias("x")).agg(F.min(F.struct("h.own", "h.set_id")).alias("h"))
        pairs = t.write(one.select(F.col("h.set_id").alias("family"), "x"), "pairs")
        hub_side = pairs.select("family", F.col("family").alias("set_id"), F.lit(0).alias("side"))
        made = _confirmed(t, full, hub_side.unionByName(pairs.select("family", F.col("x").alias("set_id"), F.lit(1).alias("side"))), percent, k)
        edges = made if edges is None else edges.unionByName(made)
        found = components(edges, t)
        labelled = lists.join(found.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
        labelled = t.write(labelled.withColumn("root", F.coalesce("root", "set_id")), "labelled")
        shares = labelled.groupBy("value", "root").agg(F.count("*").alias("c"))
        mains = shares.groupBy("value").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("main"))
        mains = t.write(mains.where("size > main.c").select("value", "size", F.col("main.c").alias("c"), F.col("main.root").alias("main")), "mains")
        left = mains.agg(F.coalesce(F.sum((F.col("size") - F.col("c")) * F.col("size")), F.lit(0))).first()[0]
        labelled = t.write(labelled.join(mains.select("value", "size", "main"), "value"), "open")
        if left <= dense * n_entries or before is not None and 2 * left > before:
            break
        before = left
        others = labelled.where("root <> main")
        hubs = others.groupBy("value").agg(F.max("size").alias("size"), F.min(F.struct("own", "set_id", "n", "slack", "left", "root")).alias("hub"))
    if left:
        # a family is all lists of one largest component: their open sets meet all that are in them
        side = lambda rows, n: rows.select(F.col("main").alias("family"), "set_id", F.lit(n).alias("side"))
        made = _confirmed(t, full, side(labelled.where("root <> main"), 0).unionByName(side(labelled, 1)), percent, k)
        found = components(edges.unionByName(made), t)
    return found


def _linked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = SKETCH, dense: int = DENSE
) -> DataFrame:
    """id, text_key, n and best of each document: the first (id, nulls last, then text_key) that it is linked to.

    best is null without shingles.
    """
    t = shared.Tables(docs.sparkSession)
    rows = t.write(sketched(docs, id_col, text_col, percent, k), "sketches", compression="zstd")
    held = rows.where("set_key IS NOT NULL")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    copies = t.write(held.groupBy("set_key").agg(F.count("*").alias("c")).where("c > 1").select("set_key"), "copies")
    # only rows of sets that several documents have are shuffled with their sketches
    among = shared.among(copies, "set_key")
    once = held.where(~among).select("set_key", first.alias("best"), "n", "sketch")
    more = held.where(among).groupBy("set_key").agg(F.min(first).alias("best"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = once.unionByName(more).withColumn("set_id", F.monotonically_increasing_id()).withColumn("text_key", F.col("best.text_key"))
    sets = t.write(sets, "sets", compression="zstd")
    found = _linked_sets(t, docs, text_col, sets, percent, k, dense)
    # labels that aren't the row's own: of sets linked to others, and of sets that several documents have
    rooted = t.write(found.join(sets.select(F.col("set_id").alias("node"), "set_key", "best"), "node"), "rooted")
    lowest = t.write(rooted.groupBy("root").agg(F.min("best").alias("lowest")), "lowest")
    linked = rooted.join(lowest, "root").select("set_key", F.col("lowest").alias("best"))
    alike = sets.join(copies, "set_key").join(linked.select("set_key"), "set_key", "left_anti").select("set_key", "best")
    label = t.write(linked.unionByName(alike), "labels")
    label_of = rows.select("id", "text_key", "n", "set_key").join(label, "set_key", "left")
    best = F.coalesce("best", F.when(F.col("set_key").isNotNull(), first))
    out = t.write(label_of.select("id", "text_key", "n", best.alias("best")), "linked")
    t.keep_only(out)
    return out


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **options: int) -> DataFrame:
    """A row for each document: id_col, text_key (128 bits of its text), n_shingles and component_id,

    the smallest id that it is linked to.
    """
    return _linked(docs, id_col, text_col, percent, **options).select(
        F.col("id").alias(id_col),
        "text_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("best.id", "id").alias("component_id"),
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents that stay: one of each component, that with the smallest id (nulls last), then text_key.

    Of rows that repeat it one stays, the first by the digest of all its columns.
    """
    stays = F.col("best").isNull() | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key")))
    found = _linked(docs, id_col, text_col, percent).select("id", "text_key", (~stays).alias("gone"))
    rows = found.groupBy("id", "text_key").agg(F.bool_or("gone").alias("gone"), F.count("*").alias("n"))
    touched = shared.written(rows.where("gone OR n > 1").select("id", "text_key", "gone"), "touched")
    keyed = shared.whole(docs, id=shared.col(id_col), text_key=shared.key_of(shared.text_of(text_col)))
    # the filter is asked once for each row, and rows that can't be touched are not shuffled
    asked = keyed.withColumn("near", shared.among(touched, "id", "text_key"))
    same = F.col("k.id").eqNullSafe(F.col("t.id")) & (F.col("k.text_key") == F.col("t.text_key"))
    near = asked.where("near").alias("k").join(touched.alias("t"), same, "left").select("k.doc", "k.id", "k.text_key", "t.gone")
    near = near.where("gone IS NULL OR NOT gone")
    again = near.where("gone IS NOT NULL").groupBy("id", "text_key").agg(F.min_by("doc", F.sha2(F.to_json("doc"), 256)).alias("doc"))
    stay = again.select("doc").unionByName(near.where("gone IS NULL").select("doc")).unionByName(asked.where("NOT near").select("doc"))
    return shared.unwrapped(stay, docs)
