"""Periodic runs of words: the stretches that repeat one period, by a sparse diagonal DP.

A run is a stretch with smallest period q (words q apart are the same), at least
MIN_LENGTH and EXPONENT * q words long, that no neighbouring word extends. On the
diagonal of lag q its words match for length - q words in a row.

The DP goes along the words. Where a word has occurred before, the lag to the
earlier occurrence is active, and its match is one longer than at the word before;
a lag that is not active any more ends its diagonal, and one that was long
enough is a run. With all earlier occurrences that is quadratic, so the lags are
taken in classes c <= q <= 3c/2, and in a class an occurrence is one of the word
with the 3c - 1 words before it, of which the nearest alone counts. Nothing is
lost: a run of smallest period q matches for 3q >= 3c words; a piece of it of
3c >= 2q words can't have a smaller period (it would be one of the run as well),
so its nearest earlier occurrence is q words back. Conversely a diagonal of
nearest occurrences belongs to the smallest period of its stretch. So each word
takes part in a class once, classes number log(n), and one word a million times
over costs no more than prose.

Each class is a pass over the arrays of a batch of texts: earlier occurrences by a
stable sort of hashes, and the ends of diagonals where lags change. Texts without
a repeated stretch of a class take no part in the larger ones.

Words are what lies between white space (0x20, 0x09 to 0x0D); they are compared by
64-bit hashes of their bytes. Defined results: a null or blank text has no words
and no runs; repeated rows are texts of their own; texts are taken whole, one in a
task's memory at a time, with others up to BATCH bytes; runs may overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import from_arrow_type

from orrery.llm import rolling, shared

MIN_LENGTH = 6
EXPONENT = 4
#: Bytes of text that are looked at together.
BATCH = 2 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = np.array([0x20], dtype=np.uint8)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of bytes."""
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _diagonals(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of ``size`` words of one text, by its last word, the lag to its nearest earlier occurrence there.

    ``words`` are hashes, ``first`` each word's place in its text's words.
    """
    ends = np.flatnonzero(first >= size - 1)
    if len(ends) < 2:
        return ends, np.zeros(len(ends), dtype=np.int64)
    grams = rolling.Hashed(words, None).of(ends - (size - 1), ends + 1)
    text = (ends - first[ends]).astype(np.uint64)  # where its text begins
    keys = rolling.mixed(grams ^ rolling.mixed(text + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    lag = np.zeros(len(ends), dtype=np.int64)
    lag[order[1:][same]] = (ends[order[1:]] - ends[order[:-1]])[same]
    return ends, lag


def find(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs in texts of ``counts`` words each, whose hashes lie one after another."""
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts)
    out, c = [], 1
    while len(words):
        top = c * 3 // 2
        ends, lag = _diagonals(words, first, 3 * c)
        if not lag.any():
            break
        active = np.where((lag >= c) & (lag <= top), lag, 0)
        # a diagonal goes on while the next word of the same text has the same lag
        breaks = np.ones(len(ends), dtype=bool)
        breaks[1:] = (active[1:] != active[:-1]) | (ends[1:] != ends[:-1] + 1)
        begins = np.flatnonzero(breaks)
        matched = np.diff(np.append(begins, len(ends))) + 3 * c - 1
        q = active[begins]
        length = matched + q
        found = (q > 0) & (length >= np.maximum(MIN_LENGTH, EXPONENT * q))
        if found.any():
            at = ends[begins[found]]
            out.append((text[at], first[at] - (3 * c - 1) - q[found], length[found], q[found]))
        c = top + 1
        # texts with a repeated stretch and words enough for the next class
        again = np.zeros(len(counts), dtype=bool)
        again[text[ends[lag > 0]]] = True
        keep = again[text] & (left >= EXPONENT * c)
        words, text, first, left = words[keep], text[keep], first[keep], left[keep]
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    t, s, n, q = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((q, s, t))
    return t[order], s[order], n[order], q[order]


def _looked_at(texts: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of each text the number of words, the runs, and the text without what repeats."""
    data = np.concatenate([x for t in texts for x in (t, _SPACE)])  # a blank ends each text
    begin, end = words_of(data)
    counts = np.diff(np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    words = rolling.Hashed(data).of(begin, end)
    t, s, n, q = find(words, counts)
    past = np.cumsum(counts)
    bounds = np.searchsorted(t, np.arange(len(texts) + 1))
    fields = pa.StructArray.from_arrays([pa.array(s), pa.array(n), pa.array(q)], fields=list(_RUN))
    runs = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), fields)
    steps = np.zeros(len(words) + 1, dtype=np.int64)  # +1 where the dropped part of a run begins, -1 where it ends
    np.add.at(steps, (past - counts)[t] + s + q, 1)
    np.add.at(steps, (past - counts)[t] + s + n, -1)
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    # each kept word goes with the blank after it, but for a text's last
    text = np.searchsorted(past, kept, side="right")
    last = np.append(text[1:] != text[:-1], True)[: len(kept)]
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    edges[begin[kept]] += 1
    edges[end[kept] + ~last] -= 1
    raw = np.where(_BLANK[data], np.uint8(0x20), data)[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    sizes = np.bincount(text, weights=end[kept] - begin[kept] + ~last, minlength=len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return counts, runs, pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw))


def _found(texts: pa.Array) -> pa.Array:
    """A struct for each text, which are looked at in batches of some BATCH bytes."""
    out, held, size = [], [], 0
    for i, x in enumerate(texts):
        raw = x.as_buffer()
        held.append(np.frombuffer(raw if raw is not None else b"", dtype=np.uint8))
        size += len(held[-1])
        if size >= BATCH or i == len(texts) - 1:
            out.append(pa.StructArray.from_arrays([pa.array(c) for c in _looked_at(held)], fields=list(_FOUND)))
            held, size = [], 0
    return pa.concat_arrays(out) if out else pa.array([], type=_FOUND)


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``found``, in the place of any column of that name.

    It has ``n_words``, the ``runs`` (start, length, period) by start and period, and
    the text ``collapsed``: a word goes if a run has it after its first period; those
    that stay are joined by single spaces.
    """
    at = docs.columns.index(text)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            found = _found(doc.field(at).cast(pa.string()).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([doc, found], names=["doc", "found"])

    held = shared.whole(docs)
    schema = T.StructType([*held.schema, T.StructField("found", from_arrow_type(_FOUND))])
    return shared.unwrapped_with(held.mapInArrow(looked, schema), docs, "found")
