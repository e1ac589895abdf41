"""Repeated substrings by enhanced suffix arrays over buckets.

A string of ``length`` bytes goes to the bucket of its minimizer, the n-gram of
the smallest hash in it, so equal strings meet in one bucket. Consecutive
strings of a document with the same minimizer are one stretch; stretches are
what is stored and shuffled, about two in a hundred bytes, and only those of
buckets that have several. Equal stretches are one content from then on.

Of buckets with several contents the bytes are fetched, and the part of an
enhanced suffix array that matters is built over them: the suffixes whose first
``length`` bytes occur twice, in lexicographic order, with the common prefixes
of neighbours. A stack scan gives its intervals; those whose suffixes are
preceded by different bytes are the maximal repeats, with all their occurrences.
A content that several stretches have is one in itself. A bucket of more
contents than one scan takes is dealt to buckets anew, by minimizers of longer
n-grams, up to the strings themselves, whose buckets have one content: so no
bucket is too large, and there is one method.

``groups`` gives the repeats of the corpus with all occurrences: those of a
stretch, expanded to all its places, and joined to the next ones along the texts
while they have the same occurrences. A repeat longer than a stretch so comes
out whole; if a part of it occurs in further places, it comes out in parts, each
with all its occurrences. ``dedup`` removes what the repeats cover.

Hashes are used in pairs of 64 bits where equality counts (bucket and content);
texts are known by 128 bits. Positions are bytes of the UTF-8 text.

Defined results: a null or empty text is zero bytes, nothing removed; texts
shorter than ``length`` lose nothing; repeated rows and null ids are texts like
any other, so each copy of a long enough text is removed whole; an empty table
gives an empty table; only the id is carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.llm import rolling, shared

LENGTH = 200
#: Lengths of the minimizers' n-grams: the first deal, and those for buckets of too many contents.
GRAMS = (40, 120)
CHUNK = 4 << 20
SCAN_BYTES = 1 << 20
CROWD = SCAN_BYTES // 350  # contents have 360 bytes at most with the sizes above: more than this is more than a scan

def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, run, bucket, content) of the stretches of one text, a chunk at a time.

    A stretch is ``run`` strings of ``length`` bytes, at start, start + 1, ...
    """
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        hashed = rolling.Hashed(part)
        grams = hashed.grams(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        # upper bits of the hash, then the last position first among equals
        keyed = (grams & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - place)
        least = rolling.sliding_minimum(keyed, width)
        begin = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        end = np.append(begin[1:], len(least))
        minimizer = (np.uint64((1 << 24) - 1) - (least[begin] & np.uint64((1 << 24) - 1))).astype(np.int64)
        yield (
            at + begin,
            end - begin,
            grams[minimizer].view(np.int64),
            hashed.of(begin, end + length - 1).view(np.int64),
        )


def _bytes(scalar: pa.Scalar) -> np.ndarray:
    data = scalar.as_buffer()
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_STRETCH = "key binary, start long, run int, bucket long, content long"
_STRETCH_ARROW = pa.schema(
    [("key", pa.binary()), ("start", pa.int64()), ("run", pa.int32()), ("bucket", pa.int64()), ("content", pa.int64())]
)


def _stretched(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[pa.Scalar] = []
        n = 0

        def emit() -> pa.RecordBatch:
            sizes = np.array([len(h[0]) for h in held])
            key = pa.array(keys, type=pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            return pa.RecordBatch.from_arrays(
                [key, *(pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*held, strict=True), list(_STRETCH_ARROW)[1:], strict=True))],
                schema=_STRETCH_ARROW,
            )

        for batch in batches:
            texts = batch.column("text")
            for i, key in enumerate(batch.column("key").to_pylist()):
                for got in stretches(_bytes(texts[i]), length, gram):
                    held.append(got)
                    keys.append(key)
                    n += len(got[0])
                if n > 50_000:
                    yield emit()
                    held.clear()
                    keys.clear()
                    n = 0
        if held:
            yield emit()

    return scan


Repeat = tuple[int, np.ndarray, np.ndarray]


def suffixes(data: np.ndarray, room: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes of ``data`` whose first ``length`` bytes occur twice, and the common prefix of each with the one before.

    ``room[i]`` is how many bytes the suffix at i has, ``left[i]`` what precedes it. Suffixes with the same first
    ``length`` bytes stand together, in lexicographic order; before the first of them the common prefix is 0. Those
    that are all preceded by the same byte are left out: they are part of longer repeats that begin before them.
    """
    at = np.flatnonzero(room >= length)
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return none, none
    strings = rolling.Hashed(data).grams(length)[at]
    by = np.argsort(strings, kind="stable")
    at, strings = at[by], strings[by]
    begins = np.flatnonzero(np.concatenate(([True], strings[1:] != strings[:-1])))
    many = np.minimum.reduceat(left[at], begins) != np.maximum.reduceat(left[at], begins)
    sizes = np.diff(np.append(begins, len(at)))
    keep = np.repeat(many, sizes)
    at, group = at[keep], np.repeat(np.arange(len(begins)), sizes)[keep]
    if not len(at):
        return none, none
    width = -(-(int(room[at].max()) - length) // 8) * 8
    padded = np.concatenate((data, np.zeros(length + width, dtype=np.uint8)))
    tails = np.lib.stride_tricks.sliding_window_view(padded, width)[at + length] if width else np.zeros((len(at), 0), dtype=np.uint8)
    tails = np.where(np.arange(length, length + width, dtype=np.int32)[None, :] < room[at].astype(np.int32)[:, None], tails, np.uint8(0))
    words = tails.view(">u8").astype(np.uint64) if width else tails
    order = np.lexsort((room[at], *words.T[::-1], group))
    at, group, tails = at[order], group[order], tails[order]
    unequal = tails[1:] != tails[:-1]
    first = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width) if width else np.zeros(len(at) - 1, dtype=np.int64)
    common = np.minimum(length + first, np.minimum(room[at[1:]], room[at[:-1]]))
    return at, np.concatenate(([0], np.where(group[1:] == group[:-1], common, 0)))


def repeats(data: np.ndarray, sizes: np.ndarray, length: int) -> Iterator[Repeat]:
    """(size, occurrences, new) of each maximal repeat of ``length`` bytes or more in contents of these sizes, one after the other.

    ``occurrences`` are all places where it starts; ``new`` are those of them in
    no longer repeat. The intervals of common prefixes nest; the stack holds those
    that are open, (size, first rank, left byte or -1 if there are several, ranks
    that are new). The start of a content is preceded by a byte of its own.
    """
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    room = np.repeat(ends, sizes) - np.arange(n)
    left = np.concatenate(([0], data[:-1].astype(np.int64)))[:n]
    starts = (ends - sizes)[sizes > 0]
    left[starts] = 256 + starts
    order, lcp = suffixes(data, room, left, length)
    edges = np.append(np.flatnonzero(lcp == 0), len(order))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        sizes_in, lefts = lcp[lo + 1 : hi].tolist(), left[order[lo:hi]].tolist()
        stack: list[list] = []
        for i, size in enumerate([*sizes_in, 0]):
            first, mark, new = lo + i, lefts[i], [lo + i]
            while stack and stack[-1][0] > size:
                top = stack.pop()
                top[2] = top[2] if top[2] == mark and mark < 256 else -1
                top[3] += new
                if top[2] == -1:
                    yield top[0], order[top[1] : lo + i + 1], order[top[3]]
                    new = []
                else:  # what stands to the left is part of a longer repeat that covers these too
                    new = top[3]
                first, mark = top[1], top[2]
            if size >= length:
                if stack and stack[-1][0] == size:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == mark and mark < 256 else -1
                    stack[-1][3] += new
                else:
                    stack.append([size, first, mark, new])


def runs(inside: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "bucket long, content long, spans array<struct<begin: int, end: int>>"
_FOUND_ARROW = pa.schema(
    [("bucket", pa.int64()), ("content", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
)
_GROUP = "bucket long, number int, size int, content long, at int"
_GROUP_ARROW = pa.schema(
    [("bucket", pa.int64()), ("number", pa.int32()), ("size", pa.int32()), ("content", pa.int64()), ("at", pa.int32())]
)


def _covered(held: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """The spans that the repeats among these (bucket, content, bytes) cover of each."""
    data = np.frombuffer(b"".join(c for _, _, c in held), dtype=np.uint8)
    sizes = np.array([len(c) for _, _, c in held])
    step = np.zeros(len(data) + 1, dtype=np.int64)
    for size, _, new in repeats(data, sizes, length):
        np.add.at(step, new, 1)
        np.add.at(step, new + size, -1)
    inside = np.cumsum(step)[:-1] > 0
    rows, at = [], 0
    for (bucket, content, _), n in zip(held, sizes.tolist(), strict=True):
        if spans := runs(inside[at : at + n]):
            rows.append((bucket, content, [{"begin": s, "end": e} for s, e in spans]))
        at += n
    return _batch(list(zip(*rows, strict=True)) or [()] * 3, _FOUND_ARROW)


def _grouped(held: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """The occurrences of each repeat among these: a row for each, of the repeat's bucket and number."""
    data = np.frombuffer(b"".join(c for _, _, c in held), dtype=np.uint8)
    sizes = np.array([len(c) for _, _, c in held])
    begins = np.cumsum(sizes) - sizes
    rows = []
    for number, (size, places, _) in enumerate(repeats(data, sizes, length)):
        for p in places.tolist():
            i = int(np.searchsorted(begins, p, "right")) - 1
            rows.append((held[i][0], number, size, held[i][1], p - int(begins[i])))
    return _batch(list(zip(*rows, strict=True)) or [()] * 5, _GROUP_ARROW)


def _scanned(made, length: int):
    """``made`` of contents; rows come sorted by bucket, and whole buckets at a time are scanned."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "content", "data"))
            for row in zip(*columns, strict=True):
                if size > SCAN_BYTES // 2 and row[0] != held[-1][0]:
                    yield made(held, length)
                    held.clear()
                    size = 0
                held.append(row)
                size += len(row[2])
        if held:
            yield made(held, length)

    return scan


def _fetched(length: int):
    """The bytes of the stretches wanted of each text."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _bytes(batch.column("text")[i])
                rows = batch.column("wanted")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["bucket"] for w in rows], type=pa.int64()),
                        pa.array([w["content"] for w in rows], type=pa.int64()),
                        pa.array([data[w["start"] : w["start"] + w["run"] + length - 1].tobytes() for w in rows], type=pa.binary()),
                    ],
                    names=["bucket", "content", "data"],
                )

    return fetch


def _dealt(
    t: shared.Tables, texts: DataFrame, made, schema: str, length: int, grams: Sequence[int], crowd: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(places, contents, rows, pieces) of texts (key, text).

    places: key, start, run, bucket, content of each stretch whose bucket has
    several. contents: bucket, content, n (its stretches), run. rows: what
    ``made`` finds in buckets of several contents. pieces: key, text, bucket,
    content of what is in buckets of more than ``crowd``; None if nothing is.
    """
    found = t.write(texts.mapInArrow(_stretched(length, grams[0]), _STRETCH), "stretches", compression="zstd")
    buckets = t.write(found.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    # read from tables, both sides of this join are plain exchanges, and a bucket that very many share can be split
    places = t.write(shared.likely(found, buckets, "bucket").join(buckets, "bucket").select(*found.columns), "places", compression="zstd")
    t.drop(found)
    contents = t.write(
        places.groupBy("bucket", "content").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "run")).alias("one")).select("bucket", "content", "n", "one.*"),
        "contents",
    )
    sizes = t.write(contents.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "mixed")
    by_text = contents.join(sizes, "bucket").groupBy("key").agg(F.collect_list(F.struct("bucket", "content", "start", "run")).alias("wanted"))
    by_text = t.write(by_text, "wanted", compression="zstd")
    one_each = shared.likely(texts, by_text, "key").dropDuplicates(["key"])
    data = t.write(one_each.join(by_text, "key").select("text", "wanted").mapInArrow(_fetched(length), "bucket long, content long, data binary"), "data", compression="zstd")
    crowds = t.write(sizes.where(F.col("k") > crowd).select("bucket"), "crowds")
    rows = data.join(crowds, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_scanned(made, length), schema)
    rows = t.write(rows, "rows")
    if crowds.isEmpty():
        return places, contents, rows, None
    # each content is a text of its own in the next deal
    pair = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("bucket", "content")))
    pieces = data.join(crowds, "bucket").select(pair.alias("key"), F.col("data").alias("text"), "bucket", "content")
    return places, contents, rows, t.write(pieces, "pieces", compression="zstd")


def _levels(t: shared.Tables, texts: DataFrame, length: int, grams: Sequence[int], crowd: int) -> DataFrame:
    """(key, start, spans) of what repeats cover in texts (key, text): spans after a start. They may overlap."""
    places, contents, spans, pieces = _dealt(t, texts, _covered, _FOUND, length, grams, crowd)
    if pieces is not None:
        deeper = _levels(t, pieces.select("key", "text"), length, grams[1:] or [length], crowd)
        moved = F.transform("spans", lambda s: F.struct(*((s[e] + F.col("start")).cast("int").alias(e) for e in ("begin", "end"))))
        deeper = deeper.select("key", F.explode(moved).alias("s")).groupBy("key").agg(F.collect_set("s").alias("spans"))
        spans = spans.unionByName(deeper.join(pieces.select("key", "bucket", "content"), "key").select("bucket", "content", "spans"))
    all_of_it = F.array(F.struct(F.lit(0).alias("begin"), (F.col("run") + (length - 1)).cast("int").alias("end")))
    whole = contents.where("n > 1").select("bucket", "content", all_of_it.alias("spans"))
    partly = spans.join(contents.where("n = 1").select("bucket", "content"), ["bucket", "content"], "left_semi")
    found = t.write(whole.unionByName(partly), "found")
    return places.join(found, ["bucket", "content"]).select("key", "start", "spans")


def _texts(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    text = shared.text_of(text_col)
    return docs.select(shared.key_of(text).alias("key"), text.alias("text")).where(F.octet_length("text") >= length)


def repeated(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, grams: Sequence[int] = GRAMS, crowd: int = CROWD
) -> DataFrame:
    """(key, found): for each text with repeats, by 128 bits of it, their spans (begin, end) after a start.

    They are not in order, and may overlap.
    """
    t = shared.Tables(docs.sparkSession)
    spans = _levels(t, _texts(docs, text_col, length), length, grams, crowd)
    out = t.write(spans.groupBy("key").agg(F.collect_set(F.struct("start", "spans")).alias("found")), "covered", compression="zstd")
    t.keep_only(out)
    return out


def _occurrences(t: shared.Tables, texts: DataFrame, length: int, grams: Sequence[int], crowd: int) -> DataFrame:
    """(group, size, key, start): all places of the repeats within stretches of texts (key, text)."""
    places, contents, rows, pieces = _dealt(t, texts, _grouped, _GROUP, length, grams, crowd)
    places = t.write(places.select("key", "start", "bucket", "content").distinct(), "once", compression="zstd")
    level = F.lit(str(grams[0]))
    name = lambda *c: F.concat_ws(":", level, *(F.hex(x) for x in c)).alias("group")
    at = lambda c: (F.col("start") + c).alias("start")
    out = places.join(rows, ["bucket", "content"]).select(name("bucket", "number", "size"), "size", "key", at(F.col("at")))
    alone = contents.where("n > 1").select("bucket", "content", (F.col("run") + (length - 1)).cast("int").alias("size"))
    # a content that others hold within them is among the repeats found
    alone = alone.join(rows.where("at = 0").select("bucket", "content", "size"), ["bucket", "content", "size"], "left_anti")
    out = out.unionByName(places.join(alone, ["bucket", "content"]).select(name("bucket", "content"), "size", "key", "start"))
    if pieces is not None:
        deeper = _occurrences(t, pieces.select("key", "text"), length, grams[1:] or [length], crowd)
        deeper = deeper.withColumnsRenamed({"key": "piece", "start": "begin"}).join(pieces.select(F.col("key").alias("piece"), "bucket", "content"), "piece")
        out = out.unionByName(places.join(deeper, ["bucket", "content"]).select("group", "size", "key", at(F.col("begin"))))
    return t.write(out.distinct(), "every", compression="zstd")


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grams: Sequence[int] = GRAMS, crowd: int = CROWD
) -> DataFrame:
    """The repeats of ``length`` bytes or more with all their occurrences, a row for each: group, size, id_col, start.

    ``group`` is text; documents with equal texts each have their occurrences.
    """
    t = shared.Tables(docs.sparkSession)
    every = _occurrences(t, _texts(docs, text_col, length), length, grams, crowd)
    # occurrences count documents, places texts: a text that several documents have occurs as often
    texts = docs.select(shared.col(id_col).alias("id"), shared.key_of(shared.text_of(text_col)).alias("key"))
    first = every.groupBy("group", "size").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n"))
    shaped = every.join(t.write(first, "first"), ["group", "size"])
    shift = F.col("start") - F.col("first.start")
    shape = shaped.groupBy("group", "size", "first", "n").agg(
        *(F.sum(F.shiftright(F.xxhash64(F.lit(k), "key", shift), 20)).alias(f"shape{k}") for k in (1, 2))
    )
    # along the first text, repeats with the same occurrences that meet are one
    along = Window.partitionBy("first.key", "n", "shape1", "shape2").orderBy("first.start", F.desc("size"))
    upto = F.max(F.col("first.start") + F.col("size")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = shape.withColumn("begins", F.coalesce(F.col("first.start") > upto, F.lit(True)))
    island = marked.withColumn("island", F.sum(F.col("begins").cast("int")).over(along))
    joined = island.groupBy("first.key", "n", "shape1", "shape2", "island").agg(
        F.min_by("group", F.struct("first.start", -F.col("size"))).alias("group"),
        F.min_by("size", F.struct("first.start", -F.col("size"))).alias("size"),
        F.min("first.start").alias("begin"),
        (F.max(F.col("first.start") + F.col("size")) - F.min("first.start")).alias("whole"),
    )
    # of groups of one string the one with most occurrences has all
    most = joined.groupBy("key", "begin", "whole").agg(F.max_by(F.struct("group", "size"), F.struct("n", "group")).alias("g"))
    most = t.write(most.select("g.*", "whole"), "most")
    out = every.join(most, ["group", "size"])
    out = out.join(texts, "key").select("group", F.col("whole").cast("long").alias("size"), F.col("id").alias(id_col), F.col("start").cast("long").alias("start"))
    out = t.write(out, "groups")
    t.keep_only(out)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each document: id_col, n_bytes, removed (array of begin, end), kept_sha256."""
    found = repeated(docs, text_col, length)
    text = shared.text_of(text_col)
    rows = docs.select(shared.col(id_col).alias("id"), shared.key_of(text).alias("key"), text.alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *T.StructType.fromDDL(
                "n_bytes long, removed array<struct<begin: bigint, end: bigint>>, kept_sha256 string"
            ).fields,
        ]
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (key, found) in enumerate(zip(batch.column("id").to_pylist(), batch.column("found").to_pylist(), strict=True)):
                data = _bytes(batch.column("text")[i])
                gone = merged([(f["start"] + s["begin"], f["start"] + s["end"]) for f in found for s in f["spans"]])
                digest, at = hashlib.sha256(), 0
                for begin, end in [*gone, (len(data), len(data))]:
                    digest.update(data[at:begin])
                    at = end
                out.append((key, len(data), [{"begin": b, "end": e} for b, e in gone], digest.hexdigest()))
            yield _batch(list(zip(*out, strict=True)) or [()] * 4, arrow)

    plain = lambda df: df.select(
        F.col("id").alias(id_col),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast(schema["removed"].dataType).alias("removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    # the filter is asked once for each row
    asked = rows.withColumn("near", shared.among(found, "key"))
    near = asked.where("near")
    none = F.array().cast(found.schema["found"].dataType)
    joined = near.join(found, "key", "left").select("id", "text", F.coalesce("found", none).alias("found"))
    out = joined.mapInArrow(cut, schema)
    return out.unionByName(plain(asked.where("NOT near")))
