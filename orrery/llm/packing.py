"""Packing token sequences by non-negative least squares over length combinations.

Every document becomes token ids and a closing id. Whole windows are cut from
its front; what is left, its tail, is shorter than the window. Documents are
taken a stretch of ids at a time. The tails of a stretch have a histogram (one
count for each length); shallow combinations of lengths that fill a window
exactly, pairs and triples, are its candidate recipes, and non-negative least
squares solves how often each is to be used. The repeat counts are rounded,
carrying what rounding leaves from one to the next so that their sum stays, and
the recipes filled from the tails; what is left has a histogram of its own, and
is solved again while that fills windows. The residual is packed greedily, the
last tail of a window cut to fill it, and the rest of it packed on. Less than
one window of a stretch remains; it becomes sequences of powers of two, which
need no padding.

It is one pass without a shuffle that holds ``stretch`` ids at a time, so memory
is bounded whatever the keys or lengths are. A very long document is cut as it
comes. A lost task packs its documents anew.

Defined results: a null or empty text has the closing id only; repeated rows and
null ids are packed like any other row; an empty table gives no pieces; columns
other than the id and the text are not carried.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from orrery.llm import shared

WINDOW = 2048
STRETCH = 4_000_000
POPULAR = 96
#: How often what is left of a stretch is solved for again.
ROUNDS = 3


@dataclass(frozen=True)
class Encoder:
    """Token ids as the ``tokenizers`` file gives them.

    ``ranks`` is the same vocabulary for the faster tiktoken, whose ids are the
    same for any text that holds no special token's string; texts that hold one
    go to ``tokenizers``.
    """

    path: str
    ranks: str | None = None
    pattern: str | None = None
    closing: int | None = 1

    @cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def _special(self) -> tuple[str, ...]:
        return tuple(x.content for x in self._slow.get_added_tokens_decoder().values())

    @cached_property
    def _fast(self):
        import tiktoken

        with open(self.ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.ranks is None or any(x in text for x in self._special):
            got = self._slow.encode(text, add_special_tokens=False).ids
        else:
            got = self._fast.encode_ordinary(text)
        if self.closing is not None:
            got.append(self.closing)
        return np.array(got, dtype="<u4")


def recipes(histogram: np.ndarray, window: int = WINDOW, popular: int = POPULAR) -> tuple[np.ndarray, np.ndarray]:
    """Length combinations filling the window, and how often least squares would use each, most used first.

    ``histogram[l]`` counts the tails of length l. Combinations have a row each,
    of up to three lengths and zeros: all exact pairs, and the exact triples with
    two of the ``popular`` most frequent lengths (other triples are too many to
    solve for; their lengths take part in pairs, and in what is packed greedily).
    Solved by accelerated projected gradient on the lengths' counts.
    """
    there = histogram > 0
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([window - a, a, np.zeros_like(a)], axis=1)
    top = np.argsort(-histogram, kind="stable")[:popular]
    x, y = (g.ravel() for g in np.meshgrid(top, top))
    z = window - x - y
    triples = np.stack([x, y, z], axis=1)[(x > 0) & (y > 0) & (z > 0)]
    combos = np.unique(np.sort(np.concatenate([pairs, triples]), axis=1)[:, ::-1], axis=0)
    combos = combos[(there[combos] | (combos == 0)).all(axis=1)]
    if not len(combos):
        return combos, np.zeros(0)
    target = np.where(np.arange(len(histogram)) > 0, histogram, 0).astype(float)

    def product(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(target))
        for k in range(3):
            out += np.bincount(combos[:, k], v, len(target))
        out[0] = 0
        return out

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue bounds the step
        u = product(v)[combos].sum(axis=1)
        v = u / np.linalg.norm(u)
    rate = 1 / max(1e-9, float(v @ product(v)[combos].sum(axis=1)))
    n = np.zeros(len(combos))
    ahead, t = n, 1.0
    for _ in range(200):
        step = np.maximum(0, ahead - rate * (product(ahead) - target)[combos].sum(axis=1))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, n, t = step + (t - 1) / t_next * (step - n), step, t_next
    order = np.argsort(-n, kind="stable")
    return combos[order], n[order]


def rounded(repeats: np.ndarray) -> np.ndarray:
    """Whole numbers near ``repeats``, with a sum near theirs: each takes on what rounding left before it."""
    return np.diff(np.floor(np.concatenate(([0.0], np.cumsum(repeats))) + 0.5)).astype(np.int64)


def packed(tails: list[tuple[int, int]], window: int = WINDOW, rounds: int = ROUNDS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, from, to) that hold every id of ``tails``, (number, length), exactly once."""
    pool: dict[int, list[tuple[int, int]]] = {}
    for number, length in tails:
        pool.setdefault(length, []).append((number, 0))
    out: list[list[tuple[int, int, int]]] = []

    def take(length: int) -> tuple[int, int, int]:
        number, start = pool[length].pop()
        return number, start, start + length

    for _ in range(rounds):
        histogram = np.zeros(window, dtype=np.int64)
        for length, have in pool.items():
            histogram[length] = len(have)
        combos, repeats = recipes(histogram, window)
        before = len(out)
        for combo, wanted in zip(combos.tolist(), rounded(repeats).tolist(), strict=True):
            lengths = [x for x in combo if x]
            for _ in range(min(wanted, *(len(pool.get(x, ())) // lengths.count(x) for x in lengths)) if wanted else 0):
                out.append([take(x) for x in lengths])
        if len(out) == before:
            break
    left = sorted(x for x, have in pool.items() for _ in have)
    while left:
        rest, row = window, []
        while rest and (k := bisect_right(left, rest)):
            row.append(take(left.pop(k - 1)))
            rest -= row[-1][2] - row[-1][1]
        if rest and left:  # the shortest that doesn't fit is cut; its end goes back
            length = left.pop(0)
            number, start = pool[length].pop()
            row.append((number, start, start + rest))
            pool.setdefault(length - rest, []).append((number, start + rest))
            insort(left, length - rest)
            rest = 0
        if not rest:
            out.append(row)
            continue
        size, line = 1 << ((window - rest).bit_length() - 1), []  # the last: powers of two
        for number, start, end in row:
            while start < end:
                cut = min(end, start + size - sum(e - s for _, s, e in line))
                line.append((number, start, cut))
                start = cut
                if sum(e - s for _, s, e in line) == size:
                    out.append(line)
                    line, done = [], size
                    rest += done
                    size = 1 << max(0, (window - rest).bit_length() - 1)
    return out


def pack(
    docs: DataFrame,
    encoder: Encoder,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    stretch: int = STRETCH,
) -> DataFrame:
    """A row for each piece: id_col, start, length, doc_tokens, sequence_id, offset and ids.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers.
    Sequence numbers are unique, not consecutive: their upper bits are the task.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40

        def emit(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held: list[tuple[object, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows, tails = [], []
            for k, (_, ids) in enumerate(held):
                rows += [(k, s, s + window, number + i, 0) for i, s in enumerate(range(0, len(ids) - window + 1, window))]
                number += len(ids) // window
                if len(ids) % window:
                    tails.append((k, len(ids) % window))
            for line in packed(tails, window):
                at = 0
                for k, start, end in line:
                    front = len(held[k][1]) // window * window
                    rows.append((k, front + start, front + end, number, at))
                    at += end - start
                number += 1
            for at in range(0, len(rows), 2000):
                yield emit(
                    [
                        (held[k][0], s, e - s, len(held[k][1]), n, o, held[k][1][s:e].tobytes())
                        for k, s, e, n, o in rows[at : at + 2000]
                    ]
                )

        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                ids = encoder.ids(text.as_py())
                held.append((key.as_py(), ids))
                size += len(ids)
                if size >= stretch:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(shared.col(id_col).alias("id"), shared.col(text_col).alias("text")).mapInArrow(place, schema)
