"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``min_match`` words. Those of the benchmark make a table; the
documents' that pass a filter of bounded size are joined with it, which gives
pairs of a text and an item. For each pair running Karp-Rabin tiles the text: of
a search length that falls from the item's to ``min_match``, runs that are not
marked in either are hashed and matched, matches are extended, and the longest
are marked, as tiles that overlap neither in the text nor in the item, until none
of ``min_match`` words is left. The share of the item's words under tiles is its
coverage: the order of the tiles plays no part, so passages that were reordered
are caught.

To cover ``threshold`` of an item, tiles of ``min_match`` words or more hold at
least a known number of its seeds. So the item's commonest seeds, up to one less
than that number, can be left out of the table: a phrase that many items share
makes no pairs by itself. Equal texts are tiled once. Nothing of the benchmark
or of the documents is collected but the filter's bits.

A pair costs its text's words for each search length, and for each length a tile
has; matches start only where the words before differ, so repeated words don't
multiply. Memory is bounded by the pair's texts and blocks of matches.

Defined results: words are maximal runs of letters, digits and _, in lower case;
an item of fewer than ``min_match`` words must occur whole, and is reported, but
``clean`` drops no document for such items unless they make up most of its words;
a null or empty text or item matches nothing; repeated items are reported each,
repeated documents and null ids are looked at like any other; empty tables give
no matches; input columns are kept, whatever their names, and one named like the
output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm import rolling, shared

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK = 1 << 20
_PAIRS = 1_000_000
_words = re.compile(r"\w+").findall
_gap = re.compile(r"\W").search


@lru_cache(maxsize=1 << 18)
def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def coded(text: str | None) -> np.ndarray:
    """64 bits for each word of a text, which is split a block at a time."""
    parts, at, text = [], 0, text or ""
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            gap = _gap(text, end)
            end = gap.start() if gap else len(text)
        found = _words(text[at:end].lower())
        parts.append(np.fromiter(map(_code, found), np.uint64, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def seeds_of(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words."""
    return rolling.Hashed(codes, None).grams(n) if len(codes) >= n else np.zeros(0, dtype=np.uint64)


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small equal numbers for equal values of both, from 1 on."""
    found, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    number = number.astype(np.int64) + 1
    return number[: len(a)], number[len(a) :]


class _Matches:
    """Matches of ``n`` words or more between what is unmarked in a text and in an item, from where they begin on.

    Marked words have negative numbers, all different.
    """

    def __init__(self, doc: np.ndarray, item: np.ndarray, n: int) -> None:
        self.doc, self.item, self.n = doc, item, n
        spread = [rolling.mixed(x.view(np.uint64) * np.uint64(2) + np.uint64(1)) for x in (doc, item)]
        self.hashed = [rolling.Hashed(x, None) for x in spread]
        grams = [h.grams(n) for h in self.hashed]
        free = [np.flatnonzero(np.convolve(x < 0, np.ones(n, dtype=np.int64), "valid") == 0) for x in (doc, item)]
        before = [np.concatenate((edge, x[:-1])) for x, edge in zip((doc, item), ([-1 << 61], [-1 << 62]), strict=True)]
        # the item's runs by hash, and among equal ones by the word before
        hashes, left = grams[1][free[1]], before[1][free[1]]
        order = np.lexsort((left, hashes))
        self.at_item, hashes, left = free[1][order], hashes[order], left[order]
        t = free[0]
        lo, hi = np.searchsorted(hashes, grams[0][t], "left"), np.searchsorted(hashes, grams[0][t], "right")
        some = hi > lo
        t, lo, hi = t[some], lo[some], hi[some]
        # of those, the ones with the same word before are inside of a longer match
        known = np.unique(left)
        rank = np.searchsorted(known, left)
        mine = np.searchsorted(known, before[0][t])
        mine = np.where((mine < len(known)) & (known[np.minimum(mine, len(known) - 1)] == before[0][t]), mine, -1) if len(known) else mine
        group = np.cumsum(np.concatenate(([0], hashes[1:] != hashes[:-1]))) if len(hashes) else hashes.astype(np.int64)
        key, asked = group * (len(known) + 1) + rank, group[lo] * (len(known) + 1) + mine
        skip_lo, skip_hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
        none = mine < 0
        skip_lo, skip_hi = np.where(none, hi, skip_lo), np.where(none, hi, skip_hi)
        self.t = np.concatenate((t, t))
        self.lo, self.hi = np.concatenate((lo, skip_hi)), np.concatenate((skip_lo, hi))
        some = self.hi > self.lo
        self.t, self.lo, self.hi = self.t[some], self.lo[some], self.hi[some]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start in the text, start in the item, words) of all matches, a block at a time."""
        counts = self.hi - self.lo
        upto = np.cumsum(counts)
        edges = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(_PAIRS, (upto[-1] if len(upto) else 0) + _PAIRS, _PAIRS)) + 1)))
        for a, b in zip(edges[:-1].tolist(), np.minimum(edges[1:], len(counts)).tolist(), strict=True):
            c = counts[a:b]
            if not c.sum():
                continue
            t = np.repeat(self.t[a:b], c)
            p = self.at_item[np.repeat(self.lo[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            yield t, p, self._lengths(t, p)

    def _lengths(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """By bisection on hashes: how far the words from t and p on are equal."""
        low = np.full(len(t), self.n)
        high = np.minimum(len(self.doc) - t, len(self.item) - p)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashed[0].of(t, t + mid) == self.hashed[1].of(p, p + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the greedy tiles; equal words have equal numbers."""
    doc, item = _classes(doc, item)
    least = min(min_match, len(item))
    found: list[tuple[int, int, int]] = []
    if not least or len(doc) < least:
        return found
    unmarked, marks = len(item), 0
    n = min(len(doc), len(item))
    while unmarked >= least:
        n = max(least, min(n, unmarked))
        longest, t, p = 0, [], []
        for a, b, size in _Matches(doc, item, n).blocks():
            top = int(size.max())
            if top > longest:
                longest, t, p = top, [], []
            if top == longest:
                t.append(a[size == top])
                p.append(b[size == top])
        if not longest:
            if n == least:
                break
            n = max(least, n // 2)
            continue
        t, p = np.concatenate(t), np.concatenate(p)
        order = np.lexsort((p, t))
        t, p = t[order], p[order]
        while len(t):  # what overlaps the first of the longest goes with it
            i, j = int(t[0]), int(p[0])
            found.append((i, j, longest))
            doc[i : i + longest] = -2 * (marks + np.arange(longest)) - 1
            item[j : j + longest] = -2 * (marks + np.arange(longest)) - 2
            marks += longest
            unmarked -= longest
            apart = (np.abs(t - i) >= longest) & (np.abs(p - j) >= longest)
            t, p = t[apart], p[apart]
    return found


def _items(t: shared.Tables, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_no, item_id and codes (little-endian, of the words) of the items that have words."""
    rows = benchmark.select(shared.col(id_col).alias("item_id"), shared.text_of(text_col).cast("string").alias("text"))

    @F.arrow_udf(T.BinaryType())
    def codes(column: pa.Array) -> pa.Array:
        return pa.array([coded(x.as_py()).tobytes() for x in column], type=pa.binary())

    return t.write(
        rows.select("item_id", codes("text").alias("codes")).where(F.octet_length("codes") > 0).withColumn("item_no", F.monotonically_increasing_id()),
        "items",
    )


def _seeds(t: shared.Tables, items: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """n, seed and item_no: what a text must share with an item to cover enough of it."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, codes in zip(batch.column("item_no").to_pylist(), batch.column("codes"), strict=True):
                item = np.frombuffer(codes.as_buffer(), dtype=np.uint64)
                n = min(min_match, len(item))
                hashes, times = np.unique(seeds_of(item, n).view(np.int64), return_counts=True)
                need = -(-max(1, int(np.ceil(threshold * len(item)))) // n)
                k = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, number)), pa.array(np.full(k, n)), pa.array(hashes), pa.array(times), pa.array(np.full(k, need))],
                    names=["item_no", "n", "seed", "times", "need"],
                )

    every = t.write(items.mapInArrow(seeded, "item_no long, n long, seed long, times long, need long"), "seeds")
    spread = every.groupBy("seed").agg(F.count("*").alias("df"))
    # from the commonest on, seeds are left out while fewer places than needed go with them
    commonest = Window.partitionBy("item_no").orderBy(F.desc("df"), "seed")
    kept = every.join(t.write(spread, "spread"), "seed").withColumn("gone", F.sum("times").over(commonest))
    return t.write(kept.where("gone >= need").select("n", "seed", "item_no"), "index")


_TILE = "array<struct<doc_word: bigint, item_word: bigint, n_words: bigint>>"
_FOUND = f"key binary, item_no long, coverage double, n_words long, n_tiles int, longest_tile int, tiles {_TILE}"


def _tiled(min_match: int, threshold: float):
    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, codes = None, None
        for batch in batches:
            rows = []
            for i, (key, number) in enumerate(zip(batch.column("key").to_pylist(), batch.column("item_no").to_pylist(), strict=True)):
                if key != last:
                    last, codes = key, coded(batch.column("text")[i].as_py())
                item = np.frombuffer(batch.column("codes")[i].as_buffer(), dtype=np.uint64)
                made = tiles(codes, item, min_match)
                covered = sum(x[2] for x in made)
                if made and covered >= threshold * len(item):
                    rows.append(
                        {
                            "key": key,
                            "item_no": number,
                            "coverage": covered / len(item),
                            "n_words": len(codes),
                            "n_tiles": len(made),
                            "longest_tile": max(x[2] for x in made),
                            "tiles": [{"doc_word": a, "item_word": b, "n_words": k} for a, b, k in sorted(made)],
                        }
                    )
            yield pa.RecordBatch.from_pylist(rows, schema=_found_schema())

    return tile


def _found_schema() -> pa.Schema:
    place = pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
    return pa.schema(
        [("key", pa.binary()), ("item_no", pa.int64()), ("coverage", pa.float64()), ("n_words", pa.int64()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32()), ("tiles", pa.list_(place))]
    )


def found(
    t: shared.Tables, docs: DataFrame, benchmark: DataFrame, text_col: str, item_id_col: str, item_text_col: str, min_match: int, threshold: float
) -> DataFrame:
    """key (128 bits of a text), item_id, coverage, n_words (of the text), n_tiles, longest_tile and tiles of each text and item that it covers."""
    items = _items(t, benchmark, item_id_col, item_text_col)
    index = _seeds(t, items, min_match, threshold)
    sizes = sorted(r["n"] for r in index.select("n").distinct().collect())  # min_match at most
    known = shared.Filter.of(index.select("seed").distinct())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths, seeds = [], [], []
            for i, text in enumerate(batch.column("text")):
                codes = coded(text.as_py())
                for n in sizes:
                    hashes = seeds_of(codes, n).view(np.int64)
                    hit = np.unique(hashes[known.test(hashes)])
                    keys.append(np.full(len(hit), i))
                    lengths.append(np.full(len(hit), n))
                    seeds.append(hit)
            if seeds and any(map(len, seeds)):
                key = batch.column("key").take(pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(lengths)), pa.array(np.concatenate(seeds))], names=["key", "n", "seed"])

    text = shared.text_of(text_col)
    texts = docs.select(shared.key_of(text).alias("key"), text.cast("string").alias("text"))
    hits = t.write(texts.mapInArrow(asked, "key binary, n long, seed long"), "hits")
    pairs = t.write(hits.join(index, ["n", "seed"]).select("key", "item_no").distinct(), "pairs")
    one = t.write(shared.likely(texts, pairs, "key").dropDuplicates(["key"]).join(pairs.select("key").distinct(), "key"), "texts")
    both = pairs.join(one, "key").join(items.select("item_no", "codes"), "item_no")
    made = both.sortWithinPartitions("key").mapInArrow(_tiled(min_match, threshold), _FOUND)
    return t.write(made.join(items.select("item_no", "item_id"), "item_no").drop("item_no"), "tiled")


def match(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    to: str = "matches",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
    only: bool = False,
) -> DataFrame:
    """``docs`` with an array in ``to`` of the items covered to ``threshold`` or more, and their tiles; ``only``: without others."""
    t = shared.Tables(docs.sparkSession)
    rows = found(t, docs, benchmark, text_col, item_id_col, item_text_col, min_match, threshold)
    one = F.struct("item_id", "coverage", "n_tiles", "longest_tile", "tiles")
    lists = t.write(rows.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("matches")), "matches")
    t.keep_only(lists)
    asked = shared.whole(docs, key=shared.key_of(shared.text_of(text_col))).withColumn("near", shared.among(lists, "key"))
    kept = [c for c in docs.columns if c != to]
    shaped = lambda df: df.select(*(F.col("doc")[c].alias(c) for c in kept), F.col("matches").alias(to))
    near = asked.where("near").join(lists, "key", "inner" if only else "left")
    if only:
        return shaped(near)
    none = F.array().cast(lists.schema["matches"].dataType)
    return shaped(near.withColumn("matches", F.coalesce("matches", none))).unionByName(shaped(asked.where("NOT near").withColumn("matches", none)))


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that cover no item of the benchmark, and don't consist mostly of items of under ``min_match`` words."""
    t = shared.Tables(docs.sparkSession)
    rows = found(t, docs, benchmark, text_col, item_id_col, item_text_col, min_match, threshold)
    under: Column = F.flatten(F.transform("tiles", lambda x: F.sequence(x["doc_word"], x["doc_word"] + x["n_words"] - 1)))
    covers = rows.where(F.col("longest_tile") >= min_match).select("key").distinct()
    short = rows.where(F.col("longest_tile") < min_match).select("key", "n_words", F.explode(under).alias("word"))
    short = short.groupBy("key", "n_words").agg(F.count_distinct("word").alias("covered")).where("covered * 2 > n_words").select("key")
    bad = t.write(covers.unionByName(short).distinct(), "bad")
    t.keep_only(bad)
    asked = shared.whole(docs, key=shared.key_of(shared.text_of(text_col))).withColumn("near", shared.among(bad, "key"))
    stay = asked.where("near").join(bad, "key", "left_anti").select("doc").unionByName(asked.where("NOT near").select("doc"))
    return shared.unwrapped(stay, docs)
